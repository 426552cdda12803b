"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import canonical

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_coarse_forms_have_one_at_default_settings():
    coarse = "m2_delta_sasa a7_buried_residues a7_buried_totals a8_interface_atoms a9_per_copy m20_interface_sets t6_ranked_residues"
    coarse += " m13_grid_axes m13_grid_points m14_coulomb_grid m15_sample_grid m16_electrostatics"
    assert {f"{n}_fine" for n in coarse.split()} | {"g1_derive_bonds_all"} <= set(entry.queries())


def test_fields_are_sampled_from_atoms_that_were_made_once(spark):
    for name in ("m15_sample_grid", "a20_residue_potential", "t4_extreme_potential", "m16_electrostatics"):
        assert all("/cut-" in f for f in entry.queries()[name](spark, SF_DIR).inputFiles()), name


def test_interface_atoms_use_the_operators_own_points(spark):
    rows = lambda name: sorted(map(tuple, entry.queries()[name](spark, SF_DIR).select("structure_id", "atom_id").collect()))
    assert rows("a8_interface_atoms") == rows("a8_interface_atoms_fine")
    assert "range(1000)" in entry.oracle_sql()["a8_interface_atoms"]


def test_ranked_residues_use_the_operators_own_points(spark):
    cols = ("structure_id", "chain_id", "res_id", "buried")
    rows = lambda name: sorted(map(tuple, entry.queries()[name](spark, SF_DIR).select(*cols).collect()))
    assert rows("t6_ranked_residues") == rows("t6_ranked_residues_fine")
    assert "range(1000)" in entry.oracle_sql()["t6_ranked_residues"]


def test_fine_potentials_are_sampled_without_rows_of_the_grid(spark):
    for name in ("m15_sample_grid_fine", "m16_electrostatics_fine"):
        plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "cell" not in plan, name
