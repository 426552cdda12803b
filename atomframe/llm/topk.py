"""Exact top-k search by inner product, reading sorted lists only from their ends.

Every component of the vectors becomes an integer. Vectors are dealt by hashed id into
blocks, and queries too; a block of vectors against a block of queries is one group of
bounded size, whatever the table holds. Inside a group every dimension is a list sorted
by its component, and a query is answered by no-random-access aggregation:

1. Lists are read by ever deeper strides, each from the end that adds most to the query's
   score. All queries of a group read together. What was read of a row is summed.
2. What a list still holds adds at most the last value read and at least the value at
   its far end, which bounds every row's score from above and below, also of rows that
   no list has shown yet.
3. Rows whose upper bound stays below the k-th best lower bound are out. Reading stops
   once few rows are left, or when the lists are read out.
4. The rows left get their exact score in integers.

One block of vectors is searched first, and every pass searches four times as many as all
before it. The k-th score found so far is a proven lower bound, which the groups of the
next pass start from.

Defined results: vectors that are null, hold a null or non-finite component or one of
``LIMIT`` or more in size (its score could exceed 64 bits) take no part, nor do rows
without id; of rows that share an id the smallest vector stands for it; vectors of
different lengths are not compared; equal scores are ranked by id; an empty table gives
no rows; further columns of the input are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scaling import cut_lineage, top_k, union_all
from .common import table

K = 5
EVERY = 50
UNIT = 256
#: Vectors of a block, and queries of a block, about.
BLOCK, QUERIES = 4096, 256
#: Shares of the lists after which bounds are drawn.
STRIDES = (1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 1.0)
#: Reading stops when at most this share of a block's rows is left.
FEW = 1 / 32
LIMIT = 2.0**16
#: The first pass searches one block of vectors, all passes up to the next one so many times as many.
GROWTH = 4
KEYS = ["dim", "block", "query_block"]
FOUND = "query_id long, vec_id long, score long"


class SortedLists:
    """The rows of a block as one list per dimension, in ascending order of the component, read from both ends.

    What one end has shown is kept as a matrix of rows and dimensions, since all queries of
    a group read the same lists: a query uses the upper end of a list where its own
    component is positive and the lower end where it is negative.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.rows = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.rows, axis=0).astype(np.float32)
        self.upper, self.lower = (np.full(x.shape, np.nan, np.float32) for _ in range(2))
        self.depth = 0

    def read(self, depth: int) -> None:
        """Read on, at both ends of every list, to ``depth`` entries."""
        n = len(self.ids)
        for shown, part in ((self.upper, slice(n - depth, n - self.depth)), (self.lower, slice(self.depth, depth))):
            np.put_along_axis(shown, self.rows[part], self.values[part], axis=0)
        self.depth = depth

    def bounds(self, up: np.ndarray, down: np.ndarray, far: bool) -> np.ndarray:
        """Bounds of every row's score (rows, queries) for the positive and the negative parts of the queries.

        What a list has not shown counts as its last value shown (an upper bound) or, with ``far``, as
        the value at its other end (a lower bound).
        """
        n, at = len(self.ids), self.depth
        high, low = (self.values[0], self.values[-1]) if far else (self.values[n - at], self.values[at - 1])
        gaps = np.concatenate([np.nan_to_num(self.upper - high, nan=0.0), np.nan_to_num(self.lower - low, nan=0.0)], axis=1)
        return gaps @ np.concatenate([up, down], axis=1).T + (up @ high + down @ low)


def survivors(lists: SortedLists, points: np.ndarray, k: int, least: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Per query (a row of ``points``) the rows that can be among its ``k`` best and reach ``least``, without row ``own`` (-1: none)."""
    n = len(lists.ids)
    out = [np.delete(np.arange(n), o) if o >= 0 else np.arange(n) for o in own]
    if n <= k or not points.shape[1]:
        return out
    left = np.arange(len(points))
    # Bounds are drawn in single precision and widened by more than they can be off.
    slack = (np.abs(points) @ np.abs(lists.values[[0, -1]]).max(axis=0)) * 1e-5
    for share in STRIDES:
        depth = max(1, round(share * n))
        if depth <= lists.depth and share < 1:
            continue
        lists.read(depth)
        q = points[left].astype(np.float32)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bound, mine = least[left].copy(), own[left]
        blind = np.flatnonzero(bound == -np.inf)
        if len(blind):
            lower = lists.bounds(up[blind], down[blind], far=True) - slack[left[blind]]
            held = np.flatnonzero(mine[blind] >= 0)
            lower[mine[blind[held]], held] = -np.inf
            bound[blind] = np.partition(lower, n - k, axis=0)[n - k]
        alive = lists.bounds(up, down, far=False) + slack[left] >= bound
        held = np.flatnonzero(mine >= 0)
        alive[mine[held], held] = False
        done = (alive.sum(axis=0) <= max(4 * k, FEW * n)) | (share == 1)
        for i in np.flatnonzero(done):
            out[left[i]] = np.flatnonzero(alive[:, i])
        left = left[~done]
        if not len(left):
            break
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if dim else np.empty(0)
    return flat.astype(np.int64).reshape(len(column), dim)


def _search(k: int):
    def work(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and queries.num_rows:
            dim = vectors.column("dim")[0].as_py()
            vectors = vectors.sort_by("vec_id")
            lists = SortedLists(vectors.column("vec_id").to_numpy(), _matrix(vectors.column("q"), dim))
            points, asked = _matrix(queries.column("q"), dim), queries.column("query_id").to_numpy()
            least = np.array([-np.inf if v is None else v for v in queries.column("least").to_pylist()], dtype=float)
            at = np.minimum(np.searchsorted(lists.ids, asked), len(lists.ids) - 1)
            own = np.where(lists.ids[at] == asked, at, -1)
            for query, q, rows in zip(asked.tolist(), points, survivors(lists, points, k, least, own)):
                scores = lists.x[rows] @ q
                best = np.lexsort((lists.ids[rows], -scores))[:k]
                found.append((query, lists.ids[rows[best]], scores[best]))
        none = np.empty(0, np.int64)
        return pa.table({
            "query_id": np.concatenate([none, *(np.full(len(v), q) for q, v, _ in found)]).astype(np.int64),
            "vec_id": np.concatenate([none, *(v for _, v, _ in found)]),
            "score": np.concatenate([none, *(s for _, _, s in found)]),
        })

    return work


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, q) of every row of (vec_id, embedding) that takes part; one row per id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fits)
    whole = rows.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(UNIT)) * x).cast("int")).alias("q"))
    return whole.groupBy("vec_id").agg(F.min("q").alias("q")).select("vec_id", F.size("q").alias("dim"), "q")


def _blocks(rows: DataFrame, key: str, size: int, out: str) -> DataFrame:
    """Add the row's block and the number of blocks among rows of its length (``out``, ``out``s)."""
    count = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{out}s"))
    joined = rows.join(count, "dim")
    return joined.withColumn(out, F.pmod(F.xxhash64(key), F.col(f"{out}s")).cast("int"))


def _meet(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (df.repartition(n, *KEYS).groupBy(*KEYS) for df in (vectors, queries))
    return left.cogroup(right).applyInArrow(_search(k), FOUND)


def top_inner_products(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, the ``k`` best of all other rows."""
    if k < 1 or every < 1:
        raise ValueError(f"k and every must be at least 1, got {k} and {every}")
    whole = cut_lineage(integer_vectors(vectors))
    rows = cut_lineage(_blocks(whole, "vec_id", BLOCK, "block"))
    asked = whole.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "dim", "q")
    asked = cut_lineage(_blocks(asked, "query_id", QUERIES, "query_block"))
    counts = asked.select("dim", F.col("query_blocks")).distinct()
    spread = rows.join(counts, "dim").withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    spread = spread.select(*KEYS, "vec_id", "q")
    depth = rows.select("dim", "blocks").distinct()
    most = depth.agg(F.max("blocks")).first()[0] or 0
    passes: list[DataFrame] = []
    low, high = 0, 1
    while low < most:
        wide = asked.join(depth, "dim").filter(F.col("blocks") > low)
        wide = wide.withColumn("block", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), "blocks") - 1)))
        if passes:
            known = top_k(union_all(passes), ["query_id"], [F.desc("score"), F.asc("vec_id")], k, "rank")
            known = known.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
            wide = wide.join(known, "query_id", "left")
        else:
            wide = wide.withColumn("least", F.lit(None).cast("long"))
        part = spread.filter((F.col("block") >= low) & (F.col("block") < high))
        passes.append(cut_lineage(_meet(part, wide.select(*KEYS, "query_id", "q", "least"), k)))
        low, high = high, GROWTH * high
    if not passes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = top_k(union_all(passes), ["query_id"], [F.desc("score"), F.asc("vec_id")], k, "rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, min(list_transform(embedding::DOUBLE[], lambda x: floor({UNIT} * x))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x::DOUBLE) >= {LIMIT})) = 0
  GROUP BY vec_id
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CASE WHEN len(a.q) = 0 THEN 0 ELSE list_inner_product(a.q, b.q) END::BIGINT AS score
  FROM whole a JOIN whole b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= {K}
"""
