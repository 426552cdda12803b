"""Predicates, joins, conformers and named sets on hand-counted atoms."""

import random

import pytest
from atom_tables import atom_rows, ids
from pyspark.sql import functions as F

from atomframe.operators import predicates as P
from atomframe.operators import prep, sets, spatial


@pytest.mark.parametrize(
    "build, want",
    [
        (lambda a: P.is_class("protein"), [1, 2, 3, 4, 5, 6, 7]),
        (lambda a: P.is_class("water"), [9]),
        (lambda a: P.is_class("bb."), [1, 2, 3, 4, 6]),
        (lambda a: P.is_class("sidechain"), [5, 7]),
        (lambda a: P.is_class("metals"), [8]),
        (lambda a: P.is_class("ion"), [8]),
        (lambda a: P.is_class("hetatm"), [8, 9]),
        (lambda a: P.chain("B"), [8, 9]),
        (lambda a: P.chain("b"), []),
        (lambda a: P.resn("ser") & P.name("og"), [7]),
        (lambda a: P.resi("1-2"), [1, 2, 3, 4, 5, 6, 7]),
        (lambda a: P.index(3), [3]),
        (lambda a: P.rank("0-1"), [1, 2]),
        (lambda a: P.compare(a, "b", ">", 50), [5]),
        (lambda a: ~P.is_class("polymer") & ~P.is_class("solvent"), [8]),
        (lambda a: P.elem("Fe", atoms=a), []),
        (lambda a: P.alt("''", atoms=a), list(range(1, 10))),
    ],
)
def test_predicates(mixed, build, want):
    assert ids(mixed.filter(build(mixed))) == want


def test_organic_needs_carbon(spark):
    atoms = atom_rows(spark, [
        ("A", 1, "HEM", "FE", "FE", 0, 0, 0, {"hetero": True}),
        ("A", 1, "HEM", "CHA", "C", 1, 0, 0, {"hetero": True}),
        ("A", 2, "SO4", "S", "S", 5, 0, 0, {"hetero": True}),
        ("A", 3, "HOH", "O", "O", 9, 0, 0, {"hetero": True}),
        ("A", 4, "DA", "C1'", "C", 9, 9, 0),
        ("A", 4, "DA", "N9", "N", 9, 9, 1),
        ("A", 5, "NAG", "C1", "C", 9, 9, 2, {"hetero": True}),
    ])
    flagged = P.classify(atoms)
    assert ids(flagged.filter(P.is_class("organic"))) == [1, 2, 7]
    assert ids(flagged.filter(P.is_class("inorganic"))) == [3]
    assert ids(atoms.filter(P.is_class("nucleic"))) == [5, 6]
    assert ids(atoms.filter(P.is_class("backbone"))) == [5]
    assert ids(atoms.filter(P.is_class("sidechain"))) == [6]
    assert ids(atoms.filter(P.is_class("glycan"))) == [7]


@pytest.mark.parametrize(
    "call",
    [
        lambda a: P.is_class("pepseq"),
        lambda a: P.elem("Zz"),
        lambda a: P.resi("x1"),
        lambda a: P.index("5A"),
        lambda a: P.ss("twist"),
        lambda a: P.compare(a, "x", ">", 1),
        lambda a: P.compare(a, "b", "~", 1),
        lambda a: P.sym(a, 0),
        lambda a: P.alt("A", atoms=a),
        lambda a: P.require_residue(a, "ATP"),
        lambda a: P.check_mutations(a, "A1"),
        lambda a: P.check_mutations(a, "A1B"),
        lambda a: spatial.within(a, a, 0),
        lambda a: spatial.within(a, a, float("nan")),
        lambda a: spatial.ligand_site(a, "ZN", -1),
        lambda a: sets.combine_sets(sets.register(None, a, "x"), "xor", ["x"], "y"),
        lambda a: sets.combine_sets(sets.register(None, a, "x"), "subtract", ["x"], "y"),
        lambda a: sets.get(sets.register(None, a, "x"), "q", strict=True),
        lambda a: P.compare(a.drop("b_factor"), "b", ">", 1),
    ],
)
def test_unknown_things_are_refused(mixed, call):
    with pytest.raises(ValueError):
        call(mixed)


def test_unknown_element_that_is_present_is_answered(spark):
    atoms = atom_rows(spark, [("A", 1, "XXX", "Q", "QQ", 0, 0, 0)])
    assert ids(atoms.filter(P.elem("qq", atoms=atoms))) == [1]


def test_mutations(mixed):
    rows = P.check_mutations(mixed, "A1G, S1T, A9G").collect()
    assert {r["mutation"]: (r["status"], r["found"]) for r in rows} == {
        "A1G": ("verified", "ALA"), "S1T": ("mismatch", "ALA"), "A9G": ("missing", ""),
    }


def test_distance_selectors(mixed):
    zinc = mixed.filter(P.resn("ZN"))
    assert ids(spatial.within(mixed, zinc, 1.5)) == [7, 8]
    assert ids(spatial.around(mixed, zinc, 1.5)) == [7]
    assert ids(spatial.near(mixed, zinc, 1.5)) == [6, 7]
    assert ids(spatial.near(mixed, zinc, 1.5, whole_residues=False, exclude_self=False)) == [7, 8]
    assert ids(spatial.within(mixed, zinc.limit(0), 5)) == []
    assert ids(spatial.bychain(mixed, zinc)) == [8, 9]


@pytest.mark.parametrize("seed, r", [(0, 0.3), (1, 1.0), (2, 2.5), (3, 7.0), (4, 30.0)])
def test_pairs_match_brute_force(spark, seed, r):
    """Random points, some on cube borders and some at exactly the cut-off, negative ones too."""
    rng = random.Random(seed)
    grid = [rng.choice([-1, 1]) * rng.randint(0, 40) / 4 for _ in range(360)]
    points = [(i % 2 + 1, i, *grid[3 * i : 3 * i + 3]) for i in range(120)]
    df = spark.createDataFrame(points, "structure_id long, atom_id long, x double, y double, z double")
    got = {(p["structure_id"], p["a_atom_id"], p["b_atom_id"]) for p in spatial.pairs_within(df, df, r).collect()}
    want = {
        (p[0], p[1], q[1]) for p in points for q in points
        if p[0] == q[0] and sum((p[k] - q[k]) ** 2 for k in (2, 3, 4)) <= r * r
    }
    assert got == want
    assert spatial.pairs_within(df, df, r).count() == len(want)
    assert spatial.pairs_within(df, df, r, heavy=True).count() == len(want)


def test_conformers_are_chosen_per_site(spark):
    atoms = atom_rows(spark, [
        ("A", 1, "ARG", "N", "N", 0, 0, 0),
        ("A", 1, "ARG", "CD", "C", 1, 0, 0, {"alt": "A", "occ": 0.3}),
        ("A", 1, "ARG", "CD", "C", 2, 0, 0, {"alt": "B", "occ": 0.7}),
        ("A", 1, "ARG", "NE", "N", 3, 0, 0, {"alt": "A", "occ": 0.5}),
        ("A", 1, "ARG", "NE", "N", 4, 0, 0, {"alt": "B", "occ": 0.5}),
        ("A", 9, "ZN", "ZN", "ZN", 9, 0, 0, {"alt": "C", "occ": 0.2, "hetero": True}),
    ])
    state = prep.resolve_conformers(atoms)
    assert ids(state) == [1, 3, 4, 6]
    assert prep.conformers_used(state).collect()[0]["conformers"] == "A+B+C"
    assert ids(prep.resolve_conformers(atoms, "A")) == [1, 2, 4]
    assert prep.dominant_altloc(atoms).collect()[0]["dominant"] == "B"
    assert prep.altloc_surplus(atoms).collect()[0]["surplus"] == 2
    assert prep.labelled_atoms(atoms).collect()[0]["labelled"] == 5


def test_assembly_keeps_big_ones_and_numbers_copies(spark, mixed):
    def op(structure, number, chain, tx):
        return (structure, number, chain, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, float(tx), 0.0, 0.0)

    names = "structure_id long, op_id long, chain_id string, " + ", ".join(
        f"{c} double" for c in prep.ROTATION + prep.TRANSLATION
    )
    ops = spark.createDataFrame([op(1, 5, "A", 0), op(1, 9, "A", 100)], names)
    built = prep.expand_assembly(mixed, ops)
    assert built.count() == 14 and {r[0] for r in built.select("sym_id").distinct().collect()} == {0, 1}
    assert built.filter("sym_id = 1").agg(F.min("x")).collect()[0][0] == 100.0
    many = spark.createDataFrame([op(1, i, "A", i) for i in range(13)], names)
    assert prep.expand_assembly(mixed, many).count() == 13 * 7
    kept = prep.expand_assembly(mixed, many, max_copies=12)
    assert kept.count() == 9 and kept.first()["note"].startswith("13 operators")
    check = sets.check_copy_partition(built).collect()[0]
    assert (check["copies"], check["atoms"], check["disjoint"]) == (2, 14, True)
    one = built.filter("atom_id = 1 OR (atom_id = 2 AND sym_id = 0)")
    assert spatial.same_in_every_copy(built, one).collect()[0]["same"] is False


def test_named_sets_survive_saving(spark, mixed, tmp_path):
    handles = sets.register(None, mixed.filter(P.chain("A")), "a", "chain A")
    handles = sets.register(handles, mixed.filter(P.name("CA")), "ca")
    handles = sets.register(handles, mixed.filter(P.name("CB")), "ca", "again")
    assert sets.names(handles) == ["a", "ca"] and ids(sets.get(handles, "ca")) == [5]
    sets.save_handles(handles, str(tmp_path / "h"))
    back = sets.load_handles(spark, str(tmp_path / "h"), mixed)
    assert sorted(map(tuple, back.select("name", "atom_id").collect())) == sorted(
        map(tuple, handles.select("name", "atom_id").collect())
    )
    assert sets.clear(handles).isEmpty()


def test_id_runs(spark):
    df = spark.createDataFrame([(1, i) for i in (1, 2, 3, 5, 6, 9, 200000, 200001, 200002)], "structure_id long, atom_id long")
    got = sorted((r["lo"], r["hi"]) for r in sets.id_runs(df).collect())
    assert got == [(1, 3), (5, 5), (6, 6), (9, 9), (200000, 200002)]


def test_first_and_empty_residue_list(spark, mixed):
    assert ids(P.first(mixed.filter(P.is_class("sidechain")))) == [5]
    empty = spark.createDataFrame([], "chain_id string, res_id int, ins_code string")
    assert ids(P.in_residues(mixed, empty)) == []


def test_predicates_work_on_streams(spark, mixed, tmp_path):
    mixed.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(mixed.schema).parquet(str(tmp_path / "in"))
    out = prep.normalise_altloc(stream).filter(P.chain("B") & ~P.is_class("water"))
    query = out.writeStream.format("memory").queryName("picked").option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["atom_id"] for r in spark.table("picked").collect()] == [8]
