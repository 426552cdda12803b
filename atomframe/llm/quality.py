"""Quality classifier: a regularised quadratic discriminant over document statistics.

Every document is measured once (lengths, repetition, case, symbols, line shapes);
counts and shares are transformed so that they spread evenly. For each class a mean
and a covariance are fitted, the covariance drawn towards the pooled one and towards
its diagonal, and its Cholesky factor is kept. The score is the logistic of the
difference of the log densities (Mahalanobis distance and log determinant), with a
slope and an offset fitted on the same rows so that it reads as a probability.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the smallest
hashed ids; their ids and statistics are all that is gathered. Scoring is one pass
over the texts without a shuffle.

Defined results: null and empty texts are measured like any text (all counts 0) and
scored; null labels are not learnt from; a class with fewer labelled rows than
``LEAST`` in the sample gives every document the share of label 1 (0.5 without any
label); repeated rows are scored each, and learnt from once per id; an empty table gives no rows; further columns
of the input are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, give_back, table

#: Labelled documents a model is fitted on at most.
SAMPLE = 20_000
LEAST = 8
#: Shares of the pooled covariance and of the diagonal in a class covariance.
TO_POOLED = 0.1
TO_DIAGONAL = 0.1
#: Ridge on the fitted slope: it stays finite, and scores keep their order, where the classes separate.
RIDGE = 1.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

_ALIEN = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_SHOUT = re.compile(r"[!?]{2,}")
_ENDS = re.compile(r"[.!?][\"')\]]*(?=\s|$)")
#: 1 letter, 2 capital, 3 digit, 0 any other character of the basic plane.
_KIND = np.array([2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 0 for c in map(chr, range(0x10000))], dtype=np.int64)


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text; shares of nothing are 0."""
    words = text.split()
    n, chars = len(words), len(text)
    lowered = [w.lower() for w in words]
    seen = Counter(lowered)
    share = 1.0 / n if n else 0.0
    per_char = 1.0 / chars if chars else 0.0
    lines = text.split("\n")
    full = [line for line in lines if line.strip()]
    steps = len(set(zip(lowered, lowered[1:], lowered[2:]))) if n > 2 else 0
    kinds = np.bincount(_KIND[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), 0xFFFF)], minlength=4)
    uppers, digits = int(kinds[2]), int(kinds[3])
    letters = int(kinds[1]) + uppers
    log = lambda share_, floor: float(np.log(share_ + floor) - np.log(floor))
    return [
        float(np.log1p(n)),
        float(np.log1p(letters * share)),
        log(1 - len(seen) * share if n else 0.0, 0.02),
        log(1 - steps / (n - 2) if n > 2 else 0.0, 0.01),
        log(sum(a == b for a, b in zip(lowered, lowered[1:])) * share, 0.002),
        log(max(seen.values(), default=0) * share, 0.02),
        log(uppers / letters if letters else 0.0, 0.01),
        log(sum(w.isupper() and len(w) > 1 for w in words) * share, 0.005),
        log(len(_ALIEN.findall(text)) * share, 0.005),
        log(len(_SHOUT.findall(text)) * share, 0.005),
        log(digits * per_char, 0.002),
        log(len(_ENDS.findall(text)) * share, 0.01),
        log(text.count("|") * share, 0.005),
        log(len(full) * share, 0.005),
        float(np.log1p(len(full) - len(set(full)))),
        log(sum(text.count(c) for c in "<>{}=;/\\") * per_char, 0.002),
    ]


N_STATISTICS = len(statistics(""))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log density constants of both classes."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray
    prior: float
    slope: float = 0.0
    offset: float = 0.0

    def difference(self, rows: np.ndarray) -> np.ndarray:
        """Log density of label 1 less that of label 0, its sign kept and its size drawn in by a logarithm."""
        z = (rows - self.centre) / self.scale
        logs = [c - 0.5 * np.square((z - m) @ w.T).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constant)]
        d = logs[1] - logs[0]
        return np.sign(d) * np.log1p(np.abs(d))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Shares in (0, 1); higher means label 1 is likelier."""
        if not len(self.means):
            return np.full(len(rows), self.prior)
        return 1.0 / (1.0 + np.exp(-(self.slope * self.difference(rows) + self.offset)))



def fit(rows: np.ndarray, labels: np.ndarray) -> Discriminant:
    counts = [int((labels == k).sum()) for k in (0, 1)]
    prior = counts[1] / len(labels) if len(labels) else 0.5
    empty = np.zeros((0,))
    if min(counts) < LEAST:
        return Discriminant(empty, empty, empty, empty, empty, prior)
    centre, scale = rows.mean(axis=0), rows.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (rows - centre) / scale
    parts = [z[labels == k] for k in (0, 1)]
    means = np.stack([p.mean(axis=0) for p in parts])
    own = [np.cov(p, rowvar=False, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, own)) / len(z)
    whiten, constant = [], []
    for k in (0, 1):
        cov = (1 - TO_POOLED) * own[k] + TO_POOLED * pooled
        cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + 1e-4 * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        constant.append(np.log(counts[k] / len(labels)) - np.log(np.diag(factor)).sum())
    model = Discriminant(centre, scale, means, np.stack(whiten), np.array(constant), prior)
    slope, offset = _logistic(model.difference(rows), labels)
    return replace(model, slope=slope, offset=offset)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a ridge logistic regression in one variable, by halved Newton steps."""
    design, b = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    ridge = np.array([RIDGE, 1e-6])

    def loss(at: np.ndarray) -> float:
        return float(np.logaddexp(0.0, design @ at).sum() - y @ (design @ at) + 0.5 * ridge @ (at * at))

    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ b, -500, 500)))
        slope = design.T @ (y - p) - ridge * b
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge + 1e-9), slope)
        while np.abs(step).max() > 1e-9 and loss(b + step) > loss(b):
            step = step / 2
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(b[0]), 1e-3), float(b[1])


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled documents outside the held-out fold, one row per id.

    The chosen ids are at most ``bound`` rows, so they are broadcast; texts stay where they
    are. Of rows that share an id the smallest text and the smallest label count.
    """
    rows = labels.select(F.col("doc_id").alias("labelled"), F.col(label).cast("int").alias("label"))
    rows = rows.filter("label IS NOT NULL AND labelled IS NOT NULL").filter(fold(F.col("labelled"), folds) != held_out)
    rows = rows.orderBy(F.xxhash64("labelled"), "labelled", "label").limit(bound)
    rows = rows.groupBy("labelled").agg(F.min("label").alias("label"))
    found = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("labelled"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def measure(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of a bounded sample, in the order of ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sliced(batch.column(2), statistics)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    found = sample.select("doc_id", "label", "text").mapInArrow(work, "doc_id long, label int, x array<double>").toPandas()
    found = found.sort_values(["doc_id", "label"])
    rows = np.array(found["x"].tolist(), dtype=float).reshape(-1, N_STATISTICS)
    return rows, found["label"].to_numpy(dtype=int)


def sliced(texts: pa.Array, measured: Callable[[str], list[float]]) -> list[list[float]]:
    """``measured`` of every text (null: empty), with few texts as Python strings at a time."""
    rows = []
    for lo, hi in byte_slices(texts):
        rows += [measured(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
    give_back()
    return rows


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, bound: int = SAMPLE) -> Discriminant:
    return fit(*measure(labelled_sample(docs, labels, label, folds, held_out, bound)))


def scorer(model: Discriminant):
    """A function from a text column to its score column."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array(sliced(texts, statistics), dtype=float)
            yield pa.array(model.score(rows.reshape(-1, N_STATISTICS)), pa.float64())

    return score


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
