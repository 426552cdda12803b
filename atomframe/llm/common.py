"""What several of the operators share: reading, text measures and ranking without a giant task."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the word rules of the operators see it.
SPACE = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string, binary or list column that hold about ``most`` bytes (8 for a list entry); a row at least."""
    if pa.types.is_list(column.type):
        sizes = pc.multiply(pc.fill_null(pc.list_value_length(column), 0), 8)
    else:
        sizes = pc.fill_null(pc.binary_length(column), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield lo, hi
        lo = hi


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by ``keys``: about ``most`` bytes each, or one group."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if held.nbytes < most // 2:
            continue
        columns = [held.column(k).to_numpy() for k in keys]
        open_ = np.logical_and.reduce([c == c[-1] for c in columns])
        done = 0 if open_.all() else len(held) - int(open_[::-1].argmin())
        if done:
            yield held.slice(0, done).combine_chunks()
            held = held.slice(done).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys start in sorted key arrays, and the end."""
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys[0])]]) if len(keys[0]) else np.zeros(1, np.int64)


def give_back() -> None:
    """Hand memory that a finished slice has freed back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: Column, row_id: Column) -> Column:
    """A pseudo-random text that orders rows: md5 of seed and id (a null id counts as the word null)."""
    return F.md5(F.concat_ws(":", seed.cast("string"), F.coalesce(row_id.cast("string"), F.lit("null"))))


def block_rows(n: int) -> int:
    """Rows in a block of ``n``: blocks and rows in a block both grow with the root of n."""
    return max(4096, 16 * isqrt(n))


def key_block(key: Column, blocks: int) -> Column:
    """The block, in key order, of a key of ``shuffle_key``: its first 32 bits cut into equal ranges."""
    high = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(high * F.lit(blocks) / F.lit(2**32)).cast("long")


def position(df: DataFrame, group: list[str], block: str, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the 0-based place of the row in its group, ordered by ``block`` and then ``order``.

    No window holds a whole group: rows are numbered inside a block, and the sizes
    of the blocks before it, one row per block, are added. ``df`` is read twice.
    """
    sizes = df.groupBy(*group, block).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    if group:
        offsets = sizes.select(*group, block, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    else:
        before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(block, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    left, right = df.alias("l"), offsets.alias("r")
    same = F.col(f"l.{block}") == F.col(f"r.{block}")
    for g in group:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    joined = left.join(right, same).select("l.*", "r._before")
    inside = Window.partitionBy(*group, block).orderBy(*order)
    place = (F.col("_before") + F.row_number().over(inside) - 1).cast("long")
    return joined.withColumn(out, place).drop("_before")
