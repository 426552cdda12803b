"""Exact percentiles with linear interpolation, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def exact_percentiles(
    df: DataFrame, group: list[str], value: str, percents: dict[str, float]
) -> DataFrame:
    """One row per group with a column per entry of ``percents`` (name -> 0..100).

    Equal values are counted first. Values then fall into equal-width buckets;
    the bucket totals tell which buckets hold the wanted positions, and only
    the values of those buckets are ordered.
    """
    for name, percent in percents.items():
        if not 0 <= percent <= 100:
            raise ValueError(f"{name}: a percentile lies between 0 and 100, got {percent}")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v"))
    counts = counts.agg(F.count("*").alias("_n"))
    span = counts.groupBy(*group).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total")
    )
    width = F.col("_hi") - F.col("_lo")
    bucket = F.when(width > 0, F.floor((F.col("_v") - F.col("_lo")) / width * BUCKETS)).otherwise(0)
    placed = counts.join(span, group).withColumn("_b", bucket.cast("int"))
    totals = placed.groupBy(*group, "_b").agg(F.sum("_n").alias("_bn"), F.first("_total").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0)))

    wanted = []
    for name, percent in percents.items():
        position = F.lit(percent / 100.0) * (F.col("_total") - 1)
        wanted += [
            F.struct(F.lit(name).alias("name"), F.floor(position).alias("at"), (F.lit(1.0) - (position - F.floor(position))).alias("w")),
            F.struct(F.lit(name).alias("name"), (F.floor(position) + 1).alias("at"), (position - F.floor(position)).alias("w")),
        ]
    asks = totals.withColumn("_q", F.explode(F.array(*wanted))).filter(
        (F.col("_q.w") > 0)
        & (F.col("_q.at") >= F.col("_before"))
        & (F.col("_q.at") < F.col("_before") + F.col("_bn"))
    )
    asks = asks.groupBy(*group, "_b").agg(
        F.collect_list("_q").alias("_qs"), F.first("_before").alias("_before")
    )  # at most two entries per asked percentile
    inside = Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = placed.join(asks, [*group, "_b"]).withColumn(
        "_end", F.col("_before") + F.sum("_n").over(inside)
    )
    hits = rows.withColumn("_q", F.explode("_qs")).filter(
        (F.col("_q.at") < F.col("_end")) & (F.col("_q.at") >= F.col("_end") - F.col("_n"))
    )
    picked = [
        F.sum(F.when(F.col("_q.name") == name, F.col("_q.w") * F.col("_v"))).alias(name)
        for name in percents
    ]
    return hits.groupBy(*group).agg(*picked)
