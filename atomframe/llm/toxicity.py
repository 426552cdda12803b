"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A labelled sample (bounded, by hashed id) is dealt by hash into two halves and a
spare part. Words and word stems that favour toxic documents make a lexicon, with
their log odds. Trees are boosted over dense features of a text: densities of strong
and weak lexicon hits, how near hits stand to a second-person word, capitals,
punctuation, and disguised words, which are also looked up after their disguise is
undone. While trees are fitted, each half is measured by the lexicon of the other
half, so no text is judged by words learnt from itself. On the spare part, an
isotonic curve turns the trees' output into a probability.

All that is gathered is the lexicon (``LEXICON`` terms at most) and the fitted models.
Scoring is one pass over the texts without a shuffle.

Defined results: null and empty texts have all-zero features and are scored; null
labels are not learnt from; where a part of the sample lacks either class, every
document gets the share of toxic rows in the sample (0 without any label); repeated
rows are scored each, and learnt from once per id; an empty table gives no rows; further columns of the input stay
untouched whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scaling import cut_lineage
from .common import table
from .quality import fold, labelled_sample, sliced

SAMPLE = 20_000
LEXICON = 4000
#: Evidence for a term is its toxic documents times its log odds; terms are counted by these tiers.
TIERS = (6.0, 12.0, 30.0, 100.0)
LEAST_DOCS = 3
#: Least log odds of a term: a common stem that is merely more frequent in toxic texts is no sign.
LEAST_ODDS = 3.0
STEMS = (4, 5, 6)
TREES, DEPTH, BINS = 60, 3, 48
#: Step of a tree, and curvature added to every leaf.
RATE, SMOOTH = 0.15, 1.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
NEAR = 6
#: Words that a task keeps looked up.
KNOWN = 100_000
#: Share of the trees' own probability in the score: it orders rows inside a step of the curve.
BLEND = 0.01
SEED = 5
COPY_SEEDS = (1, 2, 3, 4)

#: Fixed vocabulary: words that address the reader.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros tuyo".split()
)
#: Characters that stand in for letters.
_UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
_WORD = re.compile(r"[^\W_]+")
_INNER = re.compile(r"[^\W\d_][\d@$!€*.\-_]+[^\W\d_]")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_EDGE = ".,;:!?\"'()[]{}<>"


def features(text: str, lexicon: dict[str, tuple[float, float]], known: dict[str, tuple[float, float]]) -> list[float]:
    """Dense features of one whole text. ``known`` keeps looked-up words."""
    raw = text.split()
    n = max(len(raw), 1)
    words = _WORD.findall(text.lower())
    distinct: dict[str, tuple[float, float]] = {}
    hits, second = [], []
    for i, w in enumerate(words):
        found = known.get(w)
        if found is None:
            found = known[w] = find(w, lexicon)
        if found[1]:
            hits.append(i)
            distinct[w] = found
        elif w in SECOND_PERSON:
            second.append(i)
    near = 0.0
    if hits and second:
        at = np.searchsorted(second, hits)
        seconds = np.array([-(10**9), *second, 10**9])
        gap = np.minimum(np.abs(seconds[at] - hits), np.abs(seconds[at + 1] - hits))
        near = float((gap <= NEAR).sum())
    disguised = undone = 0.0
    if _INNER.search(text):
        for token in raw:
            if _INNER.search(token):
                disguised += 1
                plain = "".join(_WORD.findall(token.lower().strip(_EDGE).translate(_UNDO)))
                undone += bool(find(plain, lexicon)[1])
    if _STRETCH.search(text):
        undone += sum(bool(find(_STRETCH.sub(r"\1", w), lexicon)[1]) for w in words if _STRETCH.search(w))
    letters = sum(map(len, raw)) or 1
    capitals = sum(w.isupper() and len(w) > 1 for w in raw)
    found = distinct.values()
    tiers = [float(sum(e >= tier for _, e in found)) for tier in TIERS]
    return [
        *tiers, *[t / n for t in tiers], len(hits) / n, sum(o for o, _ in found) / n,
        float(np.log1p(max((e for _, e in found), default=0.0))), max((o for o, _ in found), default=0.0),
        near / n, float(np.log1p(near)), capitals / n, text.count("!") / n, text.count("?") / n, letters / n,
        disguised / n, undone / n, float(np.log1p(len(raw))),
    ]


def find(word: str, lexicon: dict[str, tuple[float, float]]) -> tuple[float, float]:
    """The best entry for a word, by itself or by a stem: (log odds, evidence); zeros if there is none."""
    entries = [lexicon.get(word)]
    entries += [lexicon.get(f"{n}:{word[:n]}") for n in STEMS if len(word) >= n]
    return max((e for e in entries if e is not None), default=(0.0, 0.0), key=lambda e: e[1])


def _stems(words: Column, n: int) -> Column:
    long = F.filter(words, lambda w: F.length(w) >= n)
    return F.transform(long, lambda w: F.concat(F.lit(f"{n}:"), F.substring(w, 1, n)))


def learn_lexicons(sample: DataFrame) -> list[dict[str, tuple[float, float]]]:
    """Lexicons {term: (log odds, evidence)} of half 0, of half 1 and of both; ``sample`` has (text, label, half).

    A term is a word of three letters or more, or "n:stem" of its first n letters. Terms
    are counted by document on the cluster; at most ``LEXICON`` of the best are gathered.
    """
    rows = {(r["half"], r["label"]): r["n"] for r in sample.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), " "), lambda w: F.length(w) >= 3)
    terms = sample.select("half", "label", F.explode(F.array_distinct(F.concat(words, *[_stems(words, n) for n in STEMS]))).alias("term"))
    cell = lambda half, label: F.count_if((F.col("half") == half) & (F.col("label") == label)).alias(f"n{half}{label}")
    counts = terms.groupBy("term").agg(*[cell(h, y) for h in (0, 1) for y in (0, 1)])
    n = lambda half, label: float(rows.get((half, label), 0))
    toxic, clean = F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10")
    odds = F.log((toxic + 0.5) / F.lit(n(0, 1) + n(1, 1) + 1)) - F.log((clean + 0.5) / F.lit(n(0, 0) + n(1, 0) + 1))
    best = counts.filter((toxic >= LEAST_DOCS) & (odds >= LEAST_ODDS / 2) & (toxic * odds >= TIERS[0]))
    best = best.orderBy(F.desc(toxic * odds), "term").limit(LEXICON).collect()

    def lexicon(halves: tuple[int, ...]) -> dict[str, tuple[float, float]]:
        out = {}
        for r in best:
            seen = [sum(r[f"n{h}{y}"] for h in halves) for y in (0, 1)]
            share = [(seen[y] + 0.5) / (sum(n(h, y) for h in halves) + 1) for y in (0, 1)]
            value = float(np.log(share[1] / share[0]))
            if seen[1] >= LEAST_DOCS and value >= LEAST_ODDS and seen[1] * value >= TIERS[0]:
                out[r["term"]] = (value, seen[1] * value)
        return out

    return [lexicon((0,)), lexicon((1,)), lexicon((0, 1))]


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: a feature and a bound for each inner node, a value for each leaf."""

    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.bound[node])
        return self.value[node - (2**DEPTH - 1)]


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Tree]]:
    """Second-order boosting of the logistic loss over binned features: start value and trees."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    cuts = [np.unique(np.concatenate([c, np.unique(column)[:BINS]])) for c, column in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin, trees = np.full(len(y), start), []
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, bound = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            best = 1e-6
            total = slope[here].sum(), curve[here].sum()
            own = total[0] ** 2 / (total[1] + SMOOTH)
            chosen = None
            for f in range(x.shape[1]):
                width = len(cuts[f]) + 1
                g = np.cumsum(np.bincount(binned[here, f], slope[here], width))[:-1]
                h = np.cumsum(np.bincount(binned[here, f], curve[here], width))[:-1]
                if not len(g):
                    continue
                gain = g**2 / (h + SMOOTH) + (total[0] - g) ** 2 / (total[1] - h + SMOOTH) - own
                at = int(gain.argmax())
                if gain[at] > best:
                    best, chosen = gain[at], (f, at)
            if chosen:
                feature[k], bound[k] = chosen[0], cuts[chosen[0]][chosen[1]]
                node[here] = 2 * k + 1 + (binned[here, chosen[0]] > chosen[1])
            else:
                node[here] = 2 * k + 1
        leaf = node - inner
        value = -RATE * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, curve, inner + 1) + SMOOTH)
        trees.append(Tree(feature, bound, value))
        margin = margin + value[leaf]
    return start, trees


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and heights of the non-decreasing curve nearest to ``y``, by pooling neighbours that fall."""
    levels, place = np.unique(p, return_inverse=True)
    rows, sums = np.bincount(place), np.bincount(place, y)
    pools: list[list[float]] = []
    for x, n, total in zip(levels, rows, sums):
        pools.append([total / n, float(n), float(x), float(x)])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            mean, n, _, high = pools.pop()
            last = pools[-1]
            last[0], last[1], last[3] = (last[0] * last[1] + mean * n) / (last[1] + n), last[1] + n, high
    knots = np.array([v for pool in pools for v in pool[2:]])
    return knots, np.repeat([pool[0] for pool in pools], 2)


@dataclass(frozen=True)
class Toxicity:
    """The fitted model; without trees every text gets ``share``."""

    lexicon: dict[str, tuple[float, float]]
    start: float
    trees: list[Tree]
    knots: np.ndarray
    heights: np.ndarray
    share: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(rows), self.share)
        p = self.raw(rows)
        return (1 - BLEND) * np.interp(p, self.knots, self.heights) + BLEND * p

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum(t.predict(rows) for t in self.trees))))


N_FEATURES = len(features("", {}, {}))


def _smallest_triple(words: str, seed: int) -> Column:
    """The smallest salted hash of three words in a row; ``words`` names a column of word hashes."""
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1)))
    triples = F.transform(places, lambda i: F.xxhash64(F.try_element_at(words, i), F.try_element_at(words, i + 1), F.try_element_at(words, i + 2), F.lit(seed)))
    return F.array_min(triples)


def one_of_copies(sample: DataFrame) -> DataFrame:
    """A bounded sample less near copies: of rows that share a smallest word-triple hash, the lowest id stays.

    A toxic text that was copied many times would else make all its words look toxic.
    Each of several hashes thins out what the one before it left. The ids that stay are
    at most as many as the sample has, so they are broadcast.
    """
    words = F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+")
    hashed = sample.select("doc_id", "label", F.transform(words, lambda w: F.xxhash64(w)).alias("words"))
    rows = cut_lineage(hashed.select("doc_id", "label", *[_smallest_triple("words", s).alias(f"copy{s}") for s in COPY_SEEDS]))
    for seed in COPY_SEEDS:
        place = F.row_number().over(Window.partitionBy(f"copy{seed}").orderBy("doc_id", "label"))
        rows = rows.withColumn("place", place).filter("place = 1").drop("place")
    kept = rows.select(F.col("doc_id").alias("stays")).distinct()
    return sample.join(F.broadcast(kept), F.col("doc_id") == F.col("stays"), "left_semi")


def _measured(sample: DataFrame, lexicons: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and parts of the sample; each half measured by the lexicon of the other one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = iter(batch.column(2).to_pylist())
            rows = sliced(batch.column(3), lambda t: features(t, lexicons[1 - h if (h := next(halves)) < 2 else 2], {}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "half", "x"])

    found = sample.select("doc_id", "label", "half", "text").mapInArrow(work, "doc_id long, label int, half int, x array<double>").toPandas()
    found = found.sort_values(["doc_id", "label"])
    rows = np.array(found["x"].tolist(), dtype=float).reshape(-1, N_FEATURES)
    return rows, found["label"].to_numpy(dtype=int), found["half"].to_numpy(dtype=int)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Toxicity:
    sample = cut_lineage(labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, bound))
    # Dealt by id into two halves of 40 % and a spare 20 %.
    part = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(5))
    sample = cut_lineage(one_of_copies(sample).withColumn("half", F.floor(part / 2).cast("int")))
    lexicons = learn_lexicons(sample.filter("half < 2"))
    x, y, half = _measured(sample, lexicons)
    fit, spare = half < 2, half == 2
    share = float(y.mean()) if len(y) else 0.0
    none = np.zeros(0)
    if any(len(np.unique(y[part])) < 2 for part in (fit, spare)):
        return Toxicity({}, 0.0, [], none, none, share)
    model = Toxicity(lexicons[2], *boost(x[fit], y[fit]), none, none, share)
    return replace(model, **dict(zip(("knots", "heights"), isotonic(model.raw(x[spare]), y[spare]))))


def scorer(model: Toxicity):
    """A function from a text column to its score column."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[float, float]] = {}

        def measured(text: str) -> list[float]:
            if len(known) > KNOWN:
                known.clear()
            return features(text, model.lexicon, known)

        for texts in batches:
            rows = np.array(sliced(texts, measured), dtype=float)
            yield pa.array(model.score(rows.reshape(-1, N_FEATURES)), pa.float64())

    return score


def op3_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return found.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
