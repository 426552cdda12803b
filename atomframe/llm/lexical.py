"""Ranked lexical search over impact vectors in norm buckets.

A document is the vector of its terms' impacts, an item the vector of its terms' weights
times their repeats; a score is their inner product.

1. One pass over the texts counts terms. Only terms that some item may hold are kept: a
   filter of a fixed number of bits says so, and terms it lets through by accident do no
   harm. Corpus counts (N, L, df) come from what the pass wrote.
2. Documents are ordered by the length of their impact vector into levels, each a fixed
   factor wide, and a level is cut into buckets of bounded size.
3. The longest vectors are searched first. An item's k-th score there is a proven lower
   bound for what follows.
4. By Cauchy-Schwarz a level whose longest vector times an item's length stays below
   that bound holds none of the item's best. A block of items goes only to levels that
   matter to one of its items, and the test is made again for every item and bucket.
5. Inside a bucket an item's heaviest terms are its focus coordinates: as many as it
   takes for a document without any of them to be out. A document's sum over the focus,
   plus the lengths of both remainders, bounds its score; who stays below is out.
6. Survivors are scored exactly, in 64-bit integers.

Defined results: null and empty texts have no terms and are never found; an item without
known terms has no rows; of items that share an id the smallest text stands for it, and an
item without id is left out; documents that share an id are ranked each; a document
without id comes last among equal scores; an empty table gives no rows; further columns
of the inputs are ignored whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scaling import cut_lineage, top_k
from .common import byte_slices, give_back, table

K = 20
#: Bits of the filter of terms.
BITS = 1 << 20
#: A level spans vectors whose squared lengths differ by a factor of 2 ** (1 / STEPS).
STEPS = 4
#: Documents, and term entries, of a bucket, about; items of a block; documents searched first, at least.
BUCKET_DOCS, BUCKET_ENTRIES, ITEMS, LEAD = 8192, 1_000_000, 512, 8192
KEYS = ["level", "bucket", "item_block"]
FOUND = "item_id long, doc_id long, score long"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that end a term become spaces, A-Z are lowered, all else (digits, letters, other scripts) stays.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_PLAIN).split()


def term_column(text: Column) -> Column:
    """The same terms as an array column."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def term_filter(words: DataFrame) -> bytes:
    """One byte per bit: whether a term of ``words`` (term) hashes there. Its size does not depend on the terms."""
    place = F.crc32(F.encode("term", "UTF-8")) % BITS
    cells = words.select((place % 32).alias("bit"), F.floor(place / 32).cast("int").alias("cell"))
    found = cells.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit AS int))")).alias("bits")).collect()
    out = np.zeros((BITS // 32, 32), dtype=np.uint8)
    for row in found:
        out[row["cell"]] = (row["bits"] >> np.arange(32)) & 1
    return out.tobytes()


def _count(wanted: bytes):
    mask = BITS - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo).cast(pa.binary()).to_pylist()
                sizes, ends, names, times = [], [0], [], []
                for text in texts:
                    words = terms(text) if text else []
                    sizes.append(len(words))
                    for term, n in Counter(words).items():
                        if wanted[zlib.crc32(term) & mask]:
                            names.append(term)
                            times.append(n)
                    ends.append(len(names))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(names, pa.binary()).cast(pa.string())),
                        pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
                    ],
                    names=["doc_id", "n", "terms", "times"],
                )
            give_back()

    return work


def weights(df: Column, total: int) -> Column:
    """The weight of a term that ``df`` of ``total`` documents hold."""
    return F.floor(1000 * F.log((2 * F.lit(total) + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


class Bucket:
    """Impact vectors of similar length as postings: for a term, the rows that hold it and its impacts there."""

    def __init__(self, docs: pa.Table) -> None:
        self.ids = docs.column("doc_id").to_pylist()
        lists = docs.column("terms").combine_chunks()
        flat = docs.column("impacts").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        self.rows = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.impacts = flat[order]
        self.starts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        self.code = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        self.squares = np.bincount(np.repeat(np.arange(len(sizes)), sizes), flat.astype(float) ** 2, minlength=len(sizes))
        self.longest = math.sqrt(self.squares.max(initial=0.0))

    def postings(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        at = self.code.get(term)
        if at is None:
            return self.rows[:0], self.impacts[:0]
        part = slice(self.starts[at], self.starts[at + 1])
        return self.rows[part], self.impacts[part]

    def best(self, words: list[str], q: np.ndarray, least: int, k: int) -> list[tuple[int, int]]:
        """(row, score) of the ``k`` best rows with a score of ``least`` or more."""
        if self.longest * math.sqrt(float((q.astype(float) ** 2).sum())) * (1 + 1e-9) < least:
            return []
        heavy = np.argsort(-q, kind="stable")
        rest = np.sqrt(np.cumsum((q[heavy].astype(float) ** 2)[::-1])[::-1])
        rest = np.append(rest, 0.0)
        focus = int(np.argmax(rest * self.longest * (1 + 1e-9) < least)) if least > 1 else len(heavy)
        score, used = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        for i in heavy[:focus]:
            rows, impacts = self.postings(words[i])
            score[rows] += q[i] * impacts
            used[rows] += impacts.astype(float) ** 2
        left = np.sqrt(np.maximum(self.squares - used, 0.0) + self.squares * 1e-12)
        alive = (score + rest[focus] * left) * (1 + 1e-9) >= least
        for i in heavy[focus:]:
            rows, impacts = self.postings(words[i])
            kept = alive[rows]
            score[rows[kept]] += q[i] * impacts[kept]
        rows = np.flatnonzero(alive & (score >= least))
        if len(rows) > k:
            rows = rows[score[rows] >= np.partition(score[rows], len(rows) - k)[len(rows) - k]]
        last = lambda r: (self.ids[r] is None, self.ids[r] or 0)
        return sorted(((int(r), int(score[r])) for r in rows), key=lambda p: (-p[1], last(p[0])))[:k]


def _rank(k: int):
    def work(docs: pa.Table, items: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, int]] = []
        if docs.num_rows and items.num_rows:
            bucket = Bucket(docs)
            for item in items.to_pylist():
                q = np.array(item["q"], dtype=np.int64)
                found = bucket.best(item["terms"], q, max(1, item["least"] or 1), k)
                out += [(item["item_id"], bucket.ids[row], score) for row, score in found]
        return pa.table({name: pa.array([o[i] for o in out], pa.int64()) for i, name in enumerate(("item_id", "doc_id", "score"))})

    return work


def _meet(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = items.select(*[F.col(c).alias(c) for c in items.columns])  # both sides stem from the items: set their columns apart
    left, right = (df.repartition(n, *KEYS).groupBy(*KEYS) for df in (docs, items))
    return left.cogroup(right).applyInArrow(_rank(k), FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): for each (item_id, text) of ``items`` the ``k`` best rows of (doc_id, text)."""
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = asked.filter("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    words = cut_lineage(
        asked.select("item_id", F.explode(term_column(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    counted = cut_lineage(rows.mapInArrow(_count(term_filter(words)), "doc_id long, n long, terms array<string>, times array<long>"))
    total, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    spread = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = words.join(spread, "term").select("item_id", "term", (F.col("repeats") * weights(F.col("df"), total)).alias("w")).filter("w > 0")
    vectors = weighted.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("pairs"))
    vectors = vectors.select("item_id", F.col("pairs.term").alias("terms"), F.col("pairs.w").alias("q"))
    count = vectors.agg(F.count(F.lit(1))).first()[0]
    blocks = max(1, -(-count // ITEMS))
    square = F.aggregate("q", F.lit(0.0), lambda a, w: a + w.cast("double") * w)
    vectors = vectors.withColumns({"item_block": F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"), "size": F.sqrt(square)})
    vectors = cut_lineage(vectors)

    m = F.lit(75) + F.expr(f"(25L * n * {total}L) DIV {max(length, 1)}L")
    impacts = F.transform("times", lambda t: F.call_function("div", 1_000_000_000 * t, 1000 * t + 12 * F.col("m")).cast("int"))
    shaped = counted.withColumn("m", m).select("doc_id", "terms", impacts.alias("impacts")).filter(F.size("terms") > 0)
    square = F.aggregate("impacts", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    shaped = shaped.withColumn("square", square).withColumn("level", F.floor(F.log2("square") * STEPS).cast("int"))
    shaped = cut_lineage(shaped)

    sizes = shaped.groupBy("level").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size("terms")).alias("entries"), F.max("square").alias("longest"),
    )
    levels = sorted(sizes.collect(), key=lambda r: -r["level"])  # one row per level: some hundreds at most
    lead, held = None, 0
    for row in levels:
        if held < LEAD:
            lead, held = row["level"], held + row["docs"]
    if lead is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    cuts = [(r["level"], max(1, -(-r["docs"] // BUCKET_DOCS), -(-r["entries"] // BUCKET_ENTRIES)), math.sqrt(r["longest"])) for r in levels]
    cuts = spark.createDataFrame(cuts, "level int, buckets int, longest double")
    dealt = shaped.join(cuts.select("level", "buckets"), "level")
    salt = F.xxhash64("doc_id", F.size("terms"), "terms", "impacts")
    dealt = dealt.withColumn("bucket", F.pmod(salt, F.col("buckets")).cast("int")).select("level", "bucket", "doc_id", "terms", "impacts")

    def meet(docs: DataFrame, reach: DataFrame, items: DataFrame) -> DataFrame:
        """Documents and items at the (level, item_block) of ``reach``."""
        left = docs.join(reach, "level")
        places = reach.join(cuts.select("level", "buckets"), "level").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
        right = items.join(places, "item_block").select(*KEYS, "item_id", "terms", "q", "least")
        return cut_lineage(_meet(left.select(*KEYS, "doc_id", "terms", "impacts"), right, k))

    every_level = F.explode(F.array(*[F.lit(r["level"]) for r in levels])).alias("level")
    places = vectors.select("item_block").distinct().select("item_block", every_level)
    first = meet(dealt.filter(F.col("level") >= lead), places.filter(F.col("level") >= lead), vectors.withColumn("least", F.lit(None).cast("long")))
    known = top_k(first, ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "rank")
    known = known.groupBy("item_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    bound = cut_lineage(vectors.join(known, "item_id", "left"))
    # The shortest vector that can matter to an item of the block.
    need = bound.groupBy("item_block").agg(F.min(F.coalesce("least", F.lit(0)) / F.col("size")).alias("need"))
    reach = places.filter(F.col("level") < lead).join(need, "item_block").join(cuts.select("level", "longest"), "level")
    reach = cut_lineage(reach.filter(F.col("longest") * (1 + 1e-9) >= F.col("need")).select("level", "item_block"))
    rest = meet(dealt.filter(F.col("level") < lead), reach, bound)
    best = top_k(first.unionByName(rest), ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "rank")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH items AS MATERIALIZED (
  SELECT item_id, min(coalesce(text, '')) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id
), asked AS MATERIALIZED (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM items)
  GROUP BY ALL
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS ts FROM documents
), whole AS MATERIALIZED (
  SELECT count(*) FILTER (len(ts) > 0) AS n_docs, greatest(sum(len(ts)), 1)::BIGINT AS n_terms FROM docs
), held AS MATERIALIZED (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighted AS MATERIALIZED (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole
), scored AS (
  SELECT item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weighted USING (term) JOIN held USING (term), whole GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= {K}
"""
