"""Voxel statistics, contour levels and declared provenance of maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scales import absolute_level, caveat, provenance


def volume_stats(voxels: DataFrame, meta: DataFrame, strict: bool = False) -> DataFrame:
    """Dimensions, voxel count and statistics measured on the voxels, beside the header's own.

    A volume without voxels has no statistics; ``strict`` refuses it.
    """
    found = voxels.groupBy("volume_id").agg(
        *[(F.max(f"i{c}") - F.min(f"i{c}") + 1).alias(f"n{c}") for c in "xyz"],
        F.count("value").alias("voxels"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sigma"),
    )
    if strict and not meta.join(found, "volume_id", "left_anti").isEmpty():
        raise ValueError("a volume has no voxels")
    return meta.join(found, "volume_id")


def declare_provenance(meta: DataFrame) -> DataFrame:
    """Check the declared origin and add the caveat to show with it; none is ``unknown``."""
    word = provenance(F.coalesce("provenance", F.lit("unknown")))
    checked = meta.withColumn("provenance", word)
    return checked.withColumn("caveat", caveat(F.col("provenance")))


def isolevel(stats: DataFrame, level: float, unit: str = "sigma") -> DataFrame:
    """Absolute contour level from measured statistics, and what the header would have given."""
    absolute = absolute_level(level, unit, F.col("mean"), F.col("sigma"))
    stated = absolute_level(level, unit, F.col("stated_mean"), F.col("stated_sigma"))
    implied = F.lit(None).cast("double") if unit == "absolute" else stated
    return stats.withColumns({"absolute": absolute, "stated_absolute": implied})


def voxels_above(voxels: DataFrame, levels: DataFrame) -> DataFrame:
    """Voxels at or above each volume's absolute level."""
    joined = voxels.join(levels.select("volume_id", "absolute"), "volume_id")
    above = F.sum((F.col("value") >= F.col("absolute")).cast("long"))
    return joined.groupBy("volume_id", "absolute").agg(above.alias("voxels_above"))
