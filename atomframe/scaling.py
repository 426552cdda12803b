"""Helpers that keep one giant structure from becoming one giant task.

A window over ``partitionBy('structure_id')`` puts a whole structure in one
task. The helpers here cut each group into blocks of consecutive keys, number
or sum inside a block, and add the total of the blocks before it. Only one row
per block ever meets in a per-group window.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
SALTS = 32
HOT = 1 << 20


def _block(key: str, block: int) -> Column:
    return F.floor(F.col(key) / F.lit(float(block))).cast("long")


def running_total(
    df: DataFrame, group: list[str], key: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the group's rows up to and including this one.

    ``key`` is an integer that orders the group and is unique inside it.
    """
    rows = df.withColumn("_blk", _block(key, block)).withColumn("_val", value)
    per_block = rows.groupBy(*group, "_blk").agg(F.sum("_val").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *group, "_blk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off")
    )
    inside = (
        Window.partitionBy(*group, "_blk")
        .orderBy(key)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # groups may be as many as rows; the merge join finds the rows dealt and sorted by the window
    return (
        rows.withColumn("_in", F.sum("_val").over(inside))
        .join(offsets.hint("merge"), [*group, "_blk"])
        .withColumn(out, F.col("_off") + F.col("_in"))
        .drop("_blk", "_val", "_in", "_off")
    )


def running_index(
    df: DataFrame, group: list[str], key: str, out: str = "idx", block: int = BLOCK
) -> DataFrame:
    """Add ``out`` = 0-based position of the row inside its group, ordered by ``key``."""
    numbered = running_total(df, group, key, F.lit(1), "_n", block)
    return numbered.withColumn(out, (F.col("_n") - 1).cast("long")).drop("_n")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "place"):
    """The first ``k`` rows of each group.

    ``row_number() <= k`` is planned with a per-task group limit before the
    shuffle, so at most ``k`` rows per group and task travel.
    """
    if k < 1:
        raise ValueError(f"limit must be at least 1, got {k}")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(out, place).filter(F.col(out) <= k)


def skew_lookup(rows: DataFrame, table: DataFrame, on: list[str], spread: str) -> DataFrame:
    """Left-join a one-row-per-key ``table`` onto ``rows`` whose keys may be very uneven.

    Keys with HOT rows or more are found by a pre-aggregated count; there can be
    at most rows/HOT of them, which bounds what is broadcast. Rows of a hot key
    are split over SALTS sub-keys by the hash of ``spread``, and only hot keys
    are copied SALTS times on the table side.
    """
    hot = rows.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") >= HOT)
    hot = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    is_hot = F.coalesce("_hot", F.lit(False))
    salt = F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = rows.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    spread_table = table.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(spread_table, [*on, "_salt"], "left").drop("_salt")


def by_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Hash-partition by the key of the join that follows, in the session's partition count.

    The join reuses this exchange. Unlike the join's own exchange it is not
    merged into few partitions when its rows are small but costly.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *key)


def met_by(df: DataFrame, key: list[str]) -> DataFrame:
    """Shuffle by the key of the join that follows, so that the join knows the real size.

    Sizes are guessed from compressed files, and ``explode`` does not raise the guess:
    rows of gigabytes would be sent to the driver as a small table. After a shuffle they
    are measured; the join reuses it, and a side that is small indeed is still broadcast.
    Both sides need it: a planned broadcast stays where leaving it costs another shuffle.
    """
    return df.repartition(*key)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts; a scratch one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or None
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    Unlike an in-memory cut it survives lost executors, and unlike a plain
    checkpoint the table keeps its size and its columns, so later steps can
    prune columns and pick joins by size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._cut_path = path
    return kept


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a frame of ``cut_lineage`` once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
