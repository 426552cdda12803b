"""Packing into optimal length buckets.

One aggregation gives the global histogram of lengths. Dynamic programming over it
chooses the bucket bounds with the least total padding; every document is padded to
its bucket's bound. Inside a bucket, documents in seeded order form batches of
floor(token budget / bound) rows, at least one.

The histogram is exact up to ``EXACT`` tokens; longer lengths share cells of a width
of 1/EXACT of their size, which bounds what reaches the driver (EXACT cells per
doubling of the length). A cell's bound is the longest document in it, so no
document is ever cut. Ranks are counted in blocks: a bucket that holds all rows
still spreads over all tasks.

Defined results: null and empty texts have length 0 and are padded whole; rows with
equal ids (as repeats of a mixture have) are separate rows; a corpus without any
token has one bucket of bound 1; an empty table gives no rows; further columns are
ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scaling import cut_lineage
from .common import block_rows, key_block, position, shuffle_key, table, word_count

BUCKETS = 16
TOKEN_BUDGET = 65536
SEED = 31
EXACT = 4096


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bounds with the least total padding: at most ``buckets`` of the given ascending lengths.

    A bucket over cells i..j costs lengths[j] * rows(i..j) less the tokens, which are
    the same for every choice. For a given last cell the best start is the lowest of
    a set of lines at x = lengths[j]; both slopes and x only grow, so the lower hull
    is walked once per bucket and the whole takes buckets * cells steps.
    """
    x = [int(v) for v in lengths]
    upto = [0, *(int(v) for v in np.cumsum(counts))]
    cells = len(x)
    best = [x[j] * upto[j + 1] for j in range(cells)]
    starts = [[0] * cells]
    for _ in range(1, min(buckets, cells)):
        # line i: best cost of all before cell i, and -upto[i] rows not to be paid for
        hull: list[tuple[int, int, int]] = []
        nxt, start, head = [], [], 0
        for j in range(cells):
            slope, level = -upto[j], best[j - 1] if j else 0
            while len(hull) - head >= 2:
                (s1, l1, _), (s2, l2, _) = hull[-2], hull[-1]
                if (level - l1) * (s1 - s2) <= (l2 - l1) * (s1 - slope):
                    hull.pop()
                else:
                    break
            hull.append((slope, level, j))
            while len(hull) - head >= 2 and hull[head + 1][0] * x[j] + hull[head + 1][1] <= hull[head][0] * x[j] + hull[head][1]:
                head += 1
            s, lev, i = hull[head]
            nxt.append(s * x[j] + lev + x[j] * upto[j + 1])
            start.append(i)
        best = nxt
        starts.append(start)
    bounds, j = [], cells - 1
    for start in reversed(starts):
        bounds.append(x[j])
        j = start[j] - 1
        if j < 0:
            break
    return bounds[::-1]


def histogram_cell(n: Column) -> Column:
    """Lengths to histogram cells: exact up to EXACT, then EXACT cells per doubling."""
    width = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double") / F.lit(EXACT)))).cast("long")
    return F.when(n <= EXACT, n).otherwise(F.ceil(n / width) * width).cast("long")


def bucket_bounds(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The chosen bounds for the column ``n_tokens``, ascending; the last one is the longest length."""
    cells = lengths.groupBy(histogram_cell(F.col("n_tokens")).alias("cell"))
    seen = cells.agg(F.count(F.lit(1)).alias("rows"), F.max("n_tokens").alias("bound")).collect()
    found = sorted((max(r["bound"], 1), r["rows"]) for r in seen)
    if not found:
        return [1]
    merged: dict[int, int] = {}
    for bound, rows in found:
        merged[bound] = merged.get(bound, 0) + rows
    return best_bounds(np.array(list(merged)), np.array(list(merged.values())), buckets)


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, seed: int = SEED, tokens: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_to, batch, slot) of every row.

    ``batch`` counts from 0 inside a bucket, ``slot`` inside a batch. ``tokens``: the
    length of a row, default its words.
    """
    if buckets < 1 or token_budget < 1:
        raise ValueError("buckets and token_budget must be at least 1")
    size = word_count(F.col("text")) if tokens is None else tokens
    rows = cut_lineage(docs.select("doc_id", size.alias("n_tokens"), shuffle_key(F.lit(seed), F.col("doc_id")).alias("key")))
    bounds = bucket_bounds(rows, buckets)
    total = rows.count()
    blocks = max(1, -(-total // block_rows(total)))
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    placed = rows.withColumn("bucket", bucket).withColumn("block", key_block(F.col("key"), blocks))
    placed = position(placed, ["bucket"], "block", [F.col("key"), F.col("n_tokens")], "rank")
    chosen = F.array(*[F.lit(b).cast("long") for b in bounds])
    placed = placed.withColumn("padded_to", F.element_at(chosen, F.col("bucket") + 1))
    room = F.greatest(F.expr(f"{token_budget}L DIV padded_to"), F.lit(1))
    placed = placed.withColumn("room", room)
    return placed.select(
        "doc_id", "n_tokens", "bucket", "padded_to", F.expr("rank DIV room").alias("batch"), F.expr("rank % room").alias("slot")
    )


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
