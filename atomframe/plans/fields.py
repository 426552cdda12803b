"""Per-residue fields: coverage, and domain fractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scales import domain_fraction

KEY = ["structure_id", "chain_id", "res_id", "ins_code"]


def field_coverage(field: DataFrame, atoms: DataFrame, strict: bool = False) -> DataFrame:
    """Residues a field reaches, residues it does not, and entries that match nothing.

    ``duplicates`` counts residue keys named more than once. ``strict`` refuses
    an empty field, a duplicate key and a field that matches no residue at all.
    """
    named = field.groupBy(*KEY).agg(F.count("*").alias("_entries"))
    held = atoms.select(*KEY).distinct().withColumn("_held", F.lit(True))
    both = held.join(named, KEY, "full_outer")
    present, given = F.col("_held").isNotNull(), F.col("_entries").isNotNull()
    report = both.groupBy("structure_id").agg(
        F.sum((present & given).cast("long")).alias("matched"),
        F.sum((present & ~given).cast("long")).alias("unmatched"),
        F.sum((~present & given).cast("long")).alias("unknown"),
        F.sum((F.coalesce("_entries", F.lit(0)) > 1).cast("long")).alias("duplicates"),
    )
    if strict:
        whole = report.agg(F.sum("matched"), F.sum("duplicates"), F.sum("unknown")).collect()[0]
        if not (whole[0] or whole[2]):
            raise ValueError("the field was given no values")
        if whole[1]:
            raise ValueError("two entries name the same residue")
        if not whole[0]:
            raise ValueError("the field matches no residue")
    return report


def field_fraction(field: DataFrame, domain: tuple[float, float] | None = None) -> DataFrame:
    """``fraction`` 0..1 of every value inside the field's own range or the given domain."""
    span = field.groupBy("structure_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    joined = field.join(span, "structure_id")
    return joined.withColumn(
        "fraction", domain_fraction(F.col("value"), F.col("_lo"), F.col("_hi"), domain)
    ).drop("_lo", "_hi")
