"""Bond walks and molecules against a plain graph search on random graphs."""

import random

import pytest
from atom_tables import atom_rows, ids

from atomframe.operators import bonds as B
from atomframe.operators import predicates as P
from pyspark.sql import functions as F
from atomframe import scaling
from atomframe.operators import bonds as bond_ops
from atomframe.operators import components

BONDS = "structure_id long, a long, b long"


def graph(seed, n=60, m=50):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    near = {v: set() for v in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return edges, near


def reach(near, start, depth):
    seen = set(start)
    for _ in range(depth):
        seen |= {w for v in seen for w in near[v]}
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_walks_and_molecules(spark, seed):
    edges, near = graph(seed)
    bonds = spark.createDataFrame([(1, a, b) for a, b in edges], BONDS)
    atoms = spark.createDataFrame([(1, v) for v in near], "structure_id long, atom_id long")
    start = {0, 7}
    x = atoms.filter("atom_id IN (0, 7)")
    assert set(ids(B.neighbor(x, bonds))) == reach(near, start, 1) - start
    for depth in (1, 2, 5, 64):
        assert set(ids(B.extend(x, bonds, depth))) == reach(near, start, depth)
    labels = {r["atom_id"]: r["molecule"] for r in B.molecules(atoms, bonds).collect()}
    assert labels == {v: min(reach(near, {v}, 60)) for v in near}
    assert set(ids(B.bymolecule(atoms, x, bonds))) == reach(near, start, 60)


def test_long_chain_is_one_molecule(spark):
    bonds = spark.range(0, 300).selectExpr("1L AS structure_id", "id AS a", "id + 1 AS b")
    atoms = spark.range(0, 301).selectExpr("1L AS structure_id", "id AS atom_id")
    assert {r["molecule"] for r in B.molecules(atoms, bonds).collect()} == {0}


@pytest.mark.parametrize("n", [0, -1, 1.5])
def test_walk_depth_is_a_count(spark, n):
    with pytest.raises(ValueError):
        B.extend(spark.createDataFrame([(1, 1)], "structure_id long, atom_id long"), spark.createDataFrame([(1, 1, 2)], BONDS), n)


def test_derived_bonds_link_residues_and_skip_other_letters(spark):
    atoms = atom_rows(spark, [
        ("A", 1, "ALA", "CA", "C", 0, 0, 0),
        ("A", 1, "ALA", "C", "C", 1, 0, 0, {"alt": "A"}),
        ("A", 1, "ALA", "C", "C", 1, 1, 0, {"alt": "B"}),
        ("A", 1, "ALA", "O", "O", 2, 0, 0, {"alt": "A"}),
        ("A", 2, "ALA", "N", "N", 3, 0, 0),
        ("A", 9, "ALA", "N", "N", 9, 0, 0),
    ])
    template = spark.createDataFrame([("ALA", "CA", "C"), ("ALA", "C", "O")], "res_name string, atom1 string, atom2 string")
    found = {(r["a"], r["b"]) for r in B.derive_bonds(atoms, template).collect()}
    assert found == {(1, 2), (1, 3), (2, 4), (2, 5), (3, 5)}
    own = spark.createDataFrame([(1, 1, 6)], BONDS)
    assert {(r["a"], r["b"]) for r in B.derive_bonds(atoms, template, own).collect()} == {(1, 6)}


def test_atom_typing(spark):
    atoms = atom_rows(spark, [
        ("A", 1, "LIG", "O1", "O", 0, 0, 0), ("A", 1, "LIG", "C1", "C", 1, 0, 0),
        ("A", 1, "LIG", "C2", "C", 2, 0, 0), ("A", 1, "LIG", "C3", "C", 3, 0, 0),
        ("A", 1, "LIG", "N1", "N", 4, 0, 0), ("A", 1, "LIG", "H1", "H", 5, 0, 0), ("A", 1, "LIG", "P1", "P", 6, 0, 0),
    ])
    bonds = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 4, 5), (1, 5, 6)], BONDS)
    got = {r["atom_id"]: r["feature"] for r in B.pharmacophore(atoms, atoms, bonds).collect()}
    assert got == {1: "both", 3: "hydrophobe", 5: "donor"}
    with pytest.raises(ValueError):
        B.pharmacophore(atoms, atoms.filter(P.name("P1")), bonds, strict=True)


def test_molecules_of_near_numbers_are_settled_in_one_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "cut_lineage", lambda df: written.append(1) or scaling.cut_lineage(df))
    ids = spark.range(0, 640)
    atoms = ids.select(F.lit(1).alias("structure_id"), F.col("id").alias("atom_id"))
    bonds = ids.filter("id % 64 < 63").repartition(7, F.xxhash64("id")).selectExpr("1 AS structure_id", "id AS a", "id + 1 AS b")
    found = bond_ops.molecules(atoms, bonds).collect()
    assert len(found) == 640 and all(r["molecule"] == r["atom_id"] // 64 * 64 for r in found)
    assert len(written) == 3


def test_a_long_walk_compares_new_atoms_with_the_last_two_rounds_only(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(bond_ops, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or scaling.cut_lineage(df))
    x = spark.createDataFrame([(1, 0)], "structure_id long, atom_id long")
    bonds = spark.range(0, 20).selectExpr("1L AS structure_id", "id AS a", "id + 1 AS b")
    found = bond_ops.extend(x, bonds, 8).collect()
    assert sorted(r["atom_id"] for r in found) == list(range(9))
    assert plans[9].count("FileScan") == plans[6].count("FileScan") and "Broadcast" not in plans[9]
