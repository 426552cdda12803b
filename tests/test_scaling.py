"""Block-wise numbering, hot keys and percentiles against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomframe import scaling
from atomframe.operators import spatial
from atomframe.operators.quantiles import exact_percentiles


def test_running_index_over_many_blocks(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7).alias("k"))
    got = scaling.running_index(df, ["g"], "k", "i", block=64).toPandas().sort_values(["g", "k"])
    for _, part in got.groupby("g"):
        assert part["i"].tolist() == list(range(len(part)))


def test_as_many_groups_as_rows_are_not_broadcast(spark):
    rows = scaling.cut_lineage(spark.range(3000).select(F.col("id").alias("g"), F.lit(5).alias("k")))
    found = scaling.running_index(rows, ["g"], "k", "i")
    assert {r["i"] for r in found.collect()} == {0}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_running_total_with_negative_keys(spark):
    df = spark.range(-500, 500).select(F.lit(1).alias("g"), F.col("id").alias("k"))
    got = scaling.running_total(df, ["g"], "k", F.col("k"), "t", block=16).toPandas().sort_values("k")
    assert got["t"].tolist() == np.cumsum(np.arange(-500, 500)).tolist()


def test_hot_keys_are_split_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(scaling, "HOT", 100)
    rows = spark.range(0, 1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, 900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = scaling.skew_lookup(rows, table, ["k"], "id").toPandas()
    assert len(got) == 1000
    assert (got["v"].isna() == (got["k"] >= 900)).all()
    known = got.dropna()
    assert (known["v"] == known["k"] * 2).all()


@pytest.mark.parametrize("values", [
    [1.0], [3.0, 1.0], [5.0] * 9, [0.0, 1e9, 1.0, 2.0, 3.0], list(np.random.default_rng(5).normal(size=701)),
    list(np.round(np.random.default_rng(6).normal(size=400), 1)),
])
def test_percentiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(g, float(v)) for g in (1, 2) for v in values], "g long, v double")
    asked = {"a": 0, "b": 25, "c": 50, "d": 75, "e": 100, "f": 33.3}
    for row in exact_percentiles(df, ["g"], "v", asked).collect():
        for name, percent in asked.items():
            assert row[name] == pytest.approx(np.percentile(values, percent), abs=1e-12)


def test_top_k_refuses_zero(spark):
    with pytest.raises(ValueError):
        scaling.top_k(spark.range(3), [], [F.col("id")], 0)


def test_cut_lineage_reads_the_named_folder(spark):
    folder = scaling.checkpoint_dir(spark)
    assert folder.startswith("file:" + spark.conf.get("spark.checkpoint.dir")) or spark.conf.get("spark.checkpoint.dir") in folder
    cut = scaling.cut_lineage(spark.range(10))
    assert cut.count() == 10 and "cut-" in cut.inputFiles()[0]


def test_copies_for_a_distance_join_are_not_broadcast_by_the_size_of_their_file(spark):
    """An atom on a cube's corner is copied eight times; its file is small, its copies are not."""
    spots = spark.range(40000).select(
        F.col("id").alias("structure_id"), F.col("id").alias("atom_id"), *[F.lit(0.0).alias(c) for c in "xyz"]
    )
    atoms = scaling.cut_lineage(spots)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1500k")
    try:
        for found in (spatial.pairs_within(atoms, atoms, 4.0), spatial.within(atoms, atoms, 4.0)):
            assert len(found.collect()) == 40000
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastExchange" not in plan.split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
