"""Analyses against closed forms, NumPy and small folds built by hand."""

import math
import time

import numpy as np
import pytest
from atom_tables import atom_rows
from pyspark.sql import functions as F

from atomframe import scaling
from atomframe.functions import physics
from atomframe.functions.scales import domain_fraction, rescale
from atomframe.operators import sets
from atomframe.plans import conservation as C
from atomframe.plans import electrostatics as EL
from atomframe.plans import fields, fit, interface, keyframes, measure, sasa, secondary, volumes
from atomframe.plans.align import match_positions


# ---------------------------------------------------------------- area and interfaces
def test_two_spheres_closed_form(spark):
    gap = 3.0
    atoms = atom_rows(spark, [("A", 1, "UNL", "C1", "C", 0, 0, 0), ("B", 1, "UNL", "C1", "C", gap, 0, 0)])
    r = 1.88 + 1.4
    whole = 4 * math.pi * r * r
    cap = 2 * math.pi * r * (r - gap / 2)
    rows = {x["atom_id"]: x for x in sasa.accessible_area(atoms, points=5000).collect()}
    assert rows[1]["area_alone"] == pytest.approx(whole, rel=1e-9)
    assert rows[1]["area"] == pytest.approx(whole - cap, rel=5e-3)
    delta = interface.buried(atoms, "A", "B", points=5000)
    totals = {t["chain_id"]: t["buried"] for t in interface.interface_totals(delta).collect()}
    assert totals["A"] == pytest.approx(cap, rel=2e-2) and totals["B"] == pytest.approx(cap, rel=2e-2)
    assert interface.interface_residues(delta).count() == 2


def test_interface_residues_are_not_broadcast(spark):
    atoms = atom_rows(spark, [("A", 1, "UNL", "C1", "C", 0, 0, 0), ("B", 1, "UNL", "C1", "C", 3, 0, 0), ("B", 2, "UNL", "C1", "C", 30, 0, 0)])
    delta = interface.buried(atoms, "A", "B", points=100)
    found = interface.interface_atoms(delta, interface.interface_residues(delta))
    assert {r["atom_id"] for r in found.collect()} == {1, 2}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_water_and_hydrogen_have_no_area(spark):
    atoms = atom_rows(spark, [("A", 1, "HOH", "O", "O", 0, 0, 0), ("A", 2, "ALA", "H", "H", 9, 0, 0), ("A", 2, "ALA", "CB", "C", 1, 0, 0)])
    area = {x["atom_id"]: x["area"] for x in sasa.sasa(atoms, points=100).collect()}
    assert area[1] == area[2] == 0 and area[3] == pytest.approx(4 * math.pi * 3.28**2)


SALT = [
    ("A", 1, "ASP", "CG", "C", 0, 0, 0), ("A", 1, "ASP", "OD1", "O", 1.2, 0, 0),
    ("B", 2, "ARG", "NH1", "N", 4.2, 0, 0), ("B", 2, "ARG", "CZ", "C", 5.5, 0, 0),
]


def test_salt_bridge_comes_first(spark):
    found = interface.contacts(atom_rows(spark, SALT), "A", "B").collect()
    assert [(f["kind"], round(f["d"], 2)) for f in found] == [("salt_bridge", 3.0)]
    assert "no hydrogens" in found[0]["criterion"]


@pytest.mark.parametrize("hx, bonded", [(1.0, True), (-1.0, False)])
def test_explicit_hydrogens_decide(spark, hx, bonded):
    """SER OG-H pointing at a carbonyl O bonds; pointing away it is only a polar contact."""
    atoms = atom_rows(spark, [
        ("A", 1, "SER", "OG", "O", 0, 0, 0), ("A", 1, "SER", "HG", "H", hx, 0, 0), ("B", 2, "GLY", "O", "O", 2.9, 0, 0),
    ])
    bonds = spark.createDataFrame([(1, 1, 2)], "structure_id long, a long, b long")
    for table in (bonds, None):
        found = interface.contacts(atoms, "A", "B", bonds=table).collect()
        assert [f["kind"] for f in found] == ["hydrogen_bond" if bonded else "polar_contact"]
        assert "hydrogens present" in found[0]["criterion"]


def test_interface_refusals_and_far_pairs(spark):
    atoms = atom_rows(spark, SALT)
    with pytest.raises(ValueError):
        interface.contacts(atoms, "A", "A")
    with pytest.raises(ValueError, match="chains present"):
        interface.contacts(atoms, "A", "Z", strict=True)
    with pytest.raises(ValueError):
        interface.contacts(atoms, "A", "B", copy=0)
    far = atom_rows(spark, [("A", 1, "ALA", "CA", "C", 0, 0, 0), ("B", 1, "ALA", "CA", "C", 80, 0, 0)])
    assert interface.contacts(far, "A", "B").isEmpty()
    with pytest.raises(ValueError, match="do not touch"):
        interface.interface_sets(far, "A", "B", points=50, strict=True)


def test_water_only_counts_when_asked(spark):
    rows = [("A", 1, "SER", "OG", "O", 0, 0, 0), ("B", 2, "HOH", "O", "O", 2.8, 0, 0, {"hetero": True})]
    atoms = atom_rows(spark, rows)
    assert interface.contacts(atoms, "A", "B").isEmpty()
    assert interface.contacts(atoms, "A", "B", include_water=True).count() == 1


def test_sidechains_bring_their_anchor(mixed):
    rows = interface.sidechains_with_anchor(mixed).collect()
    assert sorted(r["atom_id"] for r in rows) == [2, 5, 6, 7]


# ---------------------------------------------------------------- fits
def rotation(seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def numpy_fit(m, t):
    mc, tc = m.mean(0), t.mean(0)
    u, s, vt = np.linalg.svd((m - mc).T @ (t - tc))
    d = np.sign(np.linalg.det(vt.T @ u.T))
    r = vt.T @ np.diag([1, 1, d]) @ u.T
    moved = (m - mc) @ r.T + tc
    return r, tc - r @ mc, np.sqrt(((moved - t) ** 2).sum(1).mean())


@pytest.mark.parametrize("seed, flat", [(0, False), (1, False), (2, True)])
def test_kabsch_equals_numpy(spark, seed, flat):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(40, 3)) * 10 + 100
    if flat:
        m[:, 2] = 3.0
    t = m @ rotation(seed).T + rng.normal(size=3) + rng.normal(size=m.shape) * 0.2
    df = spark.createDataFrame(np.hstack([np.full((40, 1), 7.0), m, t]).tolist(), "g double, mx double, my double, mz double, tx double, ty double, tz double")
    row = fit.kabsch(df, ["g"]).collect()[0]
    r, shift, rmsd = numpy_fit(m, t)
    assert row["rmsd"] == pytest.approx(rmsd, abs=1e-6)
    got = np.array([[row[f"r{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)])
    assert np.linalg.det(got) == pytest.approx(1.0)
    assert np.allclose(got, r, atol=1e-6) and np.allclose([row["tx"], row["ty"], row["tz"]], shift, atol=1e-4)


def trajectory(spark, moves):
    """Ten atoms, one per residue; each frame rotated rigidly, the last atom also drifting."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(10, 3)) * 5
    rows = []
    for f in range(5):
        x = base.copy()
        x[-1] += [0, 0, moves * f]
        x = x @ rotation(f).T + f
        rows += [(1, f, i, i, "A", "", "ALA", *map(float, x[i])) for i in range(10)]
    return spark.createDataFrame(rows, "traj_id long, frame int, atom_id long, res_id int, chain_id string, ins_code string, res_name string, x double, y double, z double")


def test_rigid_motion_is_no_fluctuation(spark):
    frames = trajectory(spark, 0.0)
    assert fit.rmsf(frames).agg(F.max("rmsf")).collect()[0][0] < 1e-6
    assert fit.rmsd_series(frames).agg(F.max("rmsd")).collect()[0][0] < 1e-5


def test_drifting_atom_is_most_mobile(spark):
    frames = trajectory(spark, 0.5)
    values = fit.rmsf(frames)
    assert fit.most_mobile(values, 1).collect()[0]["res_id"] == 9
    series = [r["rmsd"] for r in fit.rmsd_series(frames).orderBy("frame").collect()]
    assert series == sorted(series)
    assert fit.rmsd_summary(fit.rmsd_series(frames)).collect()[0]["final"] == pytest.approx(series[-1])


def test_frame_selection_and_refusals(spark):
    frames = trajectory(spark, 0.0)
    template = frames.filter("frame = 0").select("traj_id", "atom_id", "res_id")
    picked = fit.select_frames(frames, template, stride=2, limit=2, strict=True)
    assert sorted(r[0] for r in picked.select("frame").distinct().collect()) == [0, 2]
    gaps = frames.withColumn("frame", 3 * F.col("frame") + 1)
    picked = fit.select_frames(gaps, template, stride=2, limit=2)
    assert sorted(r[0] for r in picked.select("frame").distinct().collect()) == [1, 7]
    for bad in ({"stride": 0}, {"limit": 0}):
        with pytest.raises(ValueError):
            fit.select_frames(frames, template, **bad)
    with pytest.raises(ValueError, match="10 atoms, its template 9"):
        fit.select_frames(frames, template.filter("atom_id < 9"), strict=True)
    with pytest.raises(ValueError):
        fit.rmsf(frames.filter("frame = 0"), strict=True)
    with pytest.raises(ValueError):
        fit.align_frames(frames, ref=99, strict=True)


def test_reference_is_a_place_and_lost_frames_are_told(spark):
    frames = trajectory(spark, 0.5)
    want = {r["frame"]: r["rmsd"] for r in fit.rmsd_series(frames).collect()}
    late = frames.withColumn("frame", 3 * F.col("frame") + 1)  # numbered 1, 4, 7, ...
    got = fit.rmsd_series(late).collect()
    assert {(r["frame"] - 1) // 3: r["rmsd"] for r in got} == pytest.approx(want, abs=1e-6)
    assert {r["status"] for r in got} == {fit.OK}
    assert fit.align_frames(late).count() == 50 and fit.rmsf(late).filter("rmsf IS NOT NULL").count() == 10
    # place 2 exists only in the longer trajectory; the last frame of it shares no atom with the reference
    short = late.filter("frame < 7").withColumn("traj_id", F.lit(2).cast("long"))
    odd = frames.filter("frame = 4").withColumns({"frame": F.lit(99), "atom_id": F.col("atom_id") + 100})
    both = late.unionByName(short).unionByName(odd)
    found = fit.rmsd_series(both, ref=2).collect()
    told = {(r["traj_id"], r["frame"]): r["status"] for r in found if r["rmsd"] is None}
    assert told == {(2, 1): fit.NO_REFERENCE, (2, 4): fit.NO_REFERENCE, (1, 99): fit.NO_COMMON_ATOMS}
    assert len(found) == 8 and min(r["rmsd"] for r in found if r["frame"] == 7) < 1e-5
    moved = fit.align_frames(both, ref=2)
    assert moved.count() == both.count() and moved.filter("x IS NULL").count() == 30
    summary = {r["traj_id"]: r for r in fit.rmsd_summary(fit.rmsd_series(both, ref=2)).collect()}
    assert summary[2]["mean"] is None and summary[2]["status"] == fit.NO_REFERENCE
    with pytest.raises(ValueError, match="at least 0"):
        fit.rmsd_series(frames, ref=-1)


SEQUENCE = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQ"


def test_alignment_skips_an_insertion():
    a, b = SEQUENCE, SEQUENCE[:12] + "GG" + SEQUENCE[12:]
    assert match_positions(a, b) == [(i, i if i < 12 else i + 2) for i in range(len(a))]
    assert match_positions(a[5:], a) == [(i, i + 5) for i in range(len(a) - 5)]
    assert match_positions(a, a[3:20]) == [(i + 3, i) for i in range(17)]
    assert match_positions("", a) == []


def test_superpose_drops_a_moved_loop(spark):
    three = {v: k for k, v in __import__("atomframe.schema", fromlist=["x"]).ONE_LETTER.items()}
    rng = np.random.default_rng(11)
    x = np.cumsum(rng.normal(size=(len(SEQUENCE), 3)) * 2.2, axis=0)
    y = x @ rotation(4).T + [5.0, -3.0, 8.0] + rng.normal(size=x.shape) * 0.05
    y[14:17] += 9.0
    rows = [("A", i + 1, three[c], "CA", "C", *x[i], {"structure": 1}) for i, c in enumerate(SEQUENCE)]
    rows += [("A", i + 101, three[c], "CA", "C", *y[i], {"structure": 2}) for i, c in enumerate(SEQUENCE)]
    atoms = atom_rows(spark, rows)
    pairs = spark.createDataFrame([(1, 2, 1)], "pair_id long, mobile_id long, target_id long")
    found = fit.superpose(pairs, atoms, strict=True)
    row = found["fits"].collect()[0]
    assert row["aligned"] <= len(SEQUENCE) - 3 and row["rmsd"] < 0.15 and row["identity"] == 1.0
    assert row["mobile_chains"] == row["target_chains"] == "A"
    got = np.array([[row[f"r{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)])
    assert np.allclose(got, rotation(4).T, atol=0.02)
    side = {1: "target", 2: "mobile"}
    both = {s: atoms.filter(F.col("structure_id") == k).withColumn("pair_id", F.lit(1)) for k, s in side.items()}
    field = fit.deviation_field(both["target"], both["mobile"], found["fits"], found["anchors"])
    assert field.count() == row["aligned"]  # numbers differ, so only the fitted residues correspond
    same = both["mobile"].withColumn("res_id", F.col("res_id") - 100)
    whole = fit.deviation_field(both["target"], same, found["fits"], found["anchors"])
    assert whole.count() == len(SEQUENCE) and whole.agg(F.max("deviation")).collect()[0][0] > 10
    assert fit.deviation_domain(whole).collect()[0]["paintable"] is True


def test_pairs_without_a_fit_are_told(spark):
    x = np.cumsum(np.random.default_rng(5).normal(size=(12, 3)) * 2.2, axis=0)
    rows = [("A", i + 1, "ALA", "CA", "C", *x[i], {"structure": k}) for k in (1, 2) for i in range(12)]
    rows += [("A", i + 1, "ALA", "CA", "C", *x[i], {"structure": 3}) for i in range(2)]
    rows += [("A", 1, "HOH", "O", "O", 0, 0, 0, {"structure": 4})]
    atoms = atom_rows(spark, rows)
    sides = [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 1, 4), (5, 8, 1)]
    pairs = spark.createDataFrame(sides, "pair_id long, mobile_id long, target_id long")
    found = fit.superpose(pairs, atoms)
    told = {r["pair_id"]: (r["status"], r["aligned"]) for r in found["fits"].collect()}
    assert told == {
        1: (fit.OK, 12), 2: (fit.NO_ANCHORS, None), 3: (fit.NO_MOBILE, None), 4: (fit.NO_TARGET, None),
        5: (fit.NO_MOBILE, None),
    }
    both = {
        s: atoms.join(pairs.select("pair_id", F.col(f"{s}_id").alias("structure_id")), "structure_id")
        for s in ("mobile", "target")
    }
    field = fit.deviation_field(both["target"], both["mobile"], found["fits"], found["anchors"])
    counts = {(r["pair_id"], r["status"]): r["count"] for r in field.groupBy("pair_id", "status").count().collect()}
    assert counts == {(k, v[0]): v[1] or 1 for k, v in told.items()}
    assert not any(r["paintable"] for r in fit.deviation_domain(field).collect())


# ---------------------------------------------------------------- conservation
def letters(spark, sequences):
    return spark.createDataFrame(
        [(1, s, c, letter) for s, text in enumerate(sequences) for c, letter in enumerate(text)],
        "msa_id long, seq_idx long, col int, letter string",
    )


def test_entropy_by_hand(spark):
    msa = letters(spark, ["AC-A", "AD-", "aXXAA"])
    got = [r["entropy"] for r in C.column_entropy(msa).orderBy("col").collect()]
    assert got == pytest.approx([0.0, 1 / math.log2(20), 1.0, 0.0])
    assert math.copysign(1, got[0]) == 1.0
    full = letters(spark, list("ACDEFGHIKLMNPQRSTVWY"))
    assert C.column_entropy(full).collect()[0]["entropy"] == pytest.approx(1.0)


def test_scores_need_depth_and_length(spark, mixed):
    seq = C.chain_sequence(mixed, "A").withColumn("msa_id", F.lit(1))
    assert [r["letter"] for r in seq.orderBy("pos").collect()] == ["A", "S"]
    good = letters(spark, ["AS", "AT"])
    scores = C.score_conservation(seq, C.column_entropy(good), C.msa_depth(good), strict=True)
    assert {r["res_id"]: round(r["conservation"], 3) for r in scores.collect()} == {1: 1.0, 2: round(1 - 1 / math.log2(20), 3)}
    assert C.conservation_report(scores).collect()[0]["shallow"] is True
    for bad in (["AS"], ["A", "A"]):
        msa = letters(spark, bad)
        with pytest.raises(ValueError):
            C.score_conservation(seq, C.column_entropy(msa), C.msa_depth(msa), strict=True)
    with pytest.raises(ValueError, match="chains present: A, B"):
        C.chain_sequence(mixed, "B", strict=True)
    shown = {r["atom_id"]: r["shown"] for r in C.value_column(mixed, scores).collect()}
    assert shown[1] == 0.0 and shown[6] == 100.0 and shown[9] == 100.0
    with pytest.raises(ValueError):
        C.entropy_bands(scores, 1)
    assert sorted(r["band"] for r in C.entropy_bands(scores, 4).collect()) == [0, 3]


def test_chains_without_scores_are_told(spark, mixed):
    seq = C.chain_sequence(mixed, "A")
    chains = [seq.withColumns({"chain_id": F.lit(k), "msa_id": F.lit(i)}) for i, k in enumerate("ABCD")]
    msa = [letters(spark, s).withColumn("msa_id", F.lit(i)) for i, s in enumerate((["AS", "AT"], ["AS"], ["A", "A"]))]
    seq, msa = scaling.union_all(chains), scaling.union_all(msa)
    parts = seq, C.column_entropy(msa), C.msa_depth(msa)
    status = C.conservation_status(*parts)
    want = {"A": C.OK, "B": C.TOO_SHALLOW, "C": C.TOO_FEW_COLUMNS, "D": C.NO_ALIGNMENT}
    assert {r["chain_id"]: r["status"] for r in status.collect()} == want
    report = C.conservation_report(C.score_conservation(*parts), status).collect()
    assert {r["chain_id"]: r["status"] for r in report} == want
    assert {r["chain_id"]: r["residues_scored"] for r in report} == {"A": 2, "B": 0, "C": 0, "D": 0}


def test_aligned_fluctuation_needs_one_shuffle_of_the_frames_after_the_fit(spark, monkeypatch):
    """Large trajectories are dealt by atoms, small ones are whole; both equal the two steps apart."""
    rows = [(t, f, a, *map(float, np.random.default_rng(100 * t + 10 * a).normal(size=3) + 0.1 * np.random.default_rng(f + a).normal(size=3)))
            for t, n in ((1, 40), (2, 6)) for f in range(5) for a in range(n)]
    rows += [(3, 0, 1, 0.0, 0.0, 0.0), (3, 1, 2, 1.0, 1.0, 1.0)]  # no atoms in common
    frames = scaling.cut_lineage(spark.createDataFrame(rows, "traj_id long, frame int, atom_id long, x double, y double, z double"))
    want = {(r["traj_id"], r["atom_id"]): r for r in fit.rmsf_atoms(fit.align_frames(frames)).collect()}
    monkeypatch.setattr(fit, "HOT", 50)
    df = fit.rmsf(frames, per="atom")
    got = df.collect()
    assert len(got) == len(want) == 48
    for r in got:
        w = want[r["traj_id"], r["atom_id"]]
        assert r["status"] == w["status"] and (r["rmsf"] is None) == (w["rmsf"] is None)
        assert r["rmsf"] is None or r["rmsf"] == pytest.approx(w["rmsf"], abs=1e-9)
    final = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [traj_id" in final and "_share" in final


# ---------------------------------------------------------------- electrostatics
def charges(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r), 1.0) for i, r in enumerate(rows)], "structure_id long, atom_id long, charge double, x double, y double, z double, radius double")


def test_point_charge_closed_form(spark):
    meta, grid = EL.coulomb_grid(charges(spark, [(1, 0, 0, 0), (0, 9, 9, 9)]), spacing=2.0, padding=5.0)
    box = meta.collect()[0]
    assert (box["nx"], box["ox"]) == (11, -5.0)
    kappa, scale = 1 / physics.debye_length(), physics.kt_scale()
    rows = grid.collect()
    assert len(rows) == 11**3
    for r in rows[::97]:
        p = [box[f"o{c}"] + 2.0 * r[i] for c, i in zip("xyz", "ijk")]
        d = max(1.0, math.sqrt(sum(v * v for v in p)))
        assert r["value"] == pytest.approx(scale * math.exp(-kappa * d) / d, rel=1e-9)


def test_screening_limits():
    assert physics.debye_length(0.0) == math.inf and physics.screening(0.0, 78.54, 298.15) == 0.0
    assert physics.debye_length(1.0) == pytest.approx(3.04)


def test_chunks_add_up(spark, monkeypatch):
    monkeypatch.setattr(EL, "CHUNK", 3)
    rng = np.random.default_rng(0)
    rows = [(rng.choice([-1, 1]), *(rng.random(3) * 6)) for _ in range(20)]
    meta, grid = EL.coulomb_grid(charges(spark, rows), spacing=3.0, padding=2.0, ionic=0.0)
    box = meta.collect()[0]
    for r in grid.collect():
        p = [box[f"o{c}"] + 3.0 * r[i] for c, i in zip("xyz", "ijk")]
        want = sum(q / max(1.0, math.dist(p, c)) for q, *c in rows) * physics.kt_scale()
        assert r["value"] == pytest.approx(want, rel=1e-9, abs=1e-12)


def direct(axes, rows, kappa):
    out = np.zeros([len(x) for x in axes])
    for q, *p in rows:
        dx, dy, dz = (np.square(x - c) for x, c in zip(axes, p))
        d = np.sqrt(np.maximum(dx[:, None, None] + dy[None, :, None] + dz[None, None, :], 1.0))
        out += q * np.exp(-kappa * d) / d
    return out


def test_several_bricks_equal_the_direct_sum(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.choice([-1, 0.5]), *(rng.random(3) * [34, 3, 3])) for _ in range(150)]
    meta, grid = EL.coulomb_grid(charges(spark, rows), spacing=0.5, padding=1.0)
    box = meta.collect()[0]
    axes = [box[f"o{c}"] + 0.5 * np.arange(box[f"n{c}"]) for c in "xyz"]
    want = direct(axes, rows, 1 / physics.debye_length()) * physics.kt_scale()
    found = grid.toPandas()
    assert want.shape[0] > EL.BRICK and len(found) == want.size
    assert np.abs(found["value"] - want[found["i"], found["j"], found["k"]]).max() < 1e-8


@pytest.mark.parametrize("size, spacing, kappa", [(26, 1.0, 0.127), (26, 4.0, 0.127), (3, 0.25, 2.0), (200, 5.0, 1e-3), (0, 0.5, 0.127)])
def test_sums_of_gaussians_equal_the_direct_sum(size, spacing, kappa):
    rng = np.random.default_rng(4)
    rows = [(rng.choice([-1, 0.5]), *(rng.random(3) * size)) for _ in range(200)]
    axes = [np.arange(-4, size + 4, spacing)[:40] for _ in "xyz"]
    total = np.zeros([len(x) for x in axes])
    q, *at = (np.array(v) for v in zip(*rows))
    EL._add(total, axes, at, q, kappa)
    assert np.abs(total - direct(axes, rows, kappa)).max() < 1e-9


def test_a_fine_grid_costs_less_than_every_pair_of_point_and_charge():
    rng = np.random.default_rng(5)
    rows = [(rng.choice([-1, 0.5]), *(rng.random(3) * 26)) for _ in range(900)]
    axes = [np.arange(-10.0, 36.0) for _ in "xyz"]
    q, *at = (np.array(v) for v in zip(*rows))
    total, start = np.zeros([len(x) for x in axes]), time.process_time()
    EL._add(total, axes, at, q, 0.127)
    middle = time.process_time()
    direct(axes, rows, 0.127)
    assert 2 * (middle - start) < time.process_time() - middle


def test_charges_far_apart_in_number_are_met_together(spark, monkeypatch):
    """Each atom lies in a block of numbers of its own; the charges are dealt once and met by the chunk."""
    met, add = [], EL._add
    rng = np.random.default_rng(8)
    rows = [(rng.choice([-1, 0.5]), *(rng.random(3) * 9)) for _ in range(30)]
    table = charges(spark, rows).withColumn("atom_id", F.col("atom_id") * 10_000_000)
    meta, grid = EL.coulomb_grid(scaling.cut_lineage(table), spacing=2.0, padding=2.0)
    box = meta.collect()[0]
    axes = [box[f"o{c}"] + 2.0 * np.arange(box[f"n{c}"]) for c in "xyz"]
    found = grid.toPandas()
    want = direct(axes, rows, 1 / physics.debye_length()) * physics.kt_scale()
    assert np.abs(found["value"] - want[found["i"], found["j"], found["k"]]).max() < 1e-9
    kappa = physics.screening(physics.IONIC_STRENGTH, physics.WATER_DIELECTRIC, physics.TEMPERATURE)
    monkeypatch.setattr(EL, "_add", lambda *args: met.append(len(args[3])) or add(*args))
    lists = ["qx", "qy", "qz", "q"]
    kinds = "structure_id long, part long, bi int, bj int, bk int, " + ", ".join(f"o{c} double, h{c} double, n{c} long" for c in "xyz") + ", " + ", ".join(f"{c} array<double>" for c in lists)
    head = [1, 0, 0, 0, 0] + [v for c in "xyz" for v in (box[f"o{c}"], box[f"h{c}"], box[f"n{c}"])]
    brick = [(*head, None, None, None, None)] + [(*head, [float(x)], [float(y)], [float(z)], [float(q)]) for q, x, y, z in rows]
    sent = spark.createDataFrame(brick, kinds).toArrow().to_batches()
    got = list(EL._sums(kappa, "bigint")(iter(sent)))
    assert met == [30] and len(got) == 1


def test_too_large_a_grid_is_refused_on_demand(spark):
    wide = charges(spark, [(1, 0, 0, 0), (1, 400, 400, 400)])
    assert EL.grid_axes(wide).collect()[0]["points"] == 421**3
    with pytest.raises(Exception, match="is above 1000"):
        EL.grid_axes(charges(spark, [(1, 0, 0, 0), (1, 50, 50, 50)]), max_points=1000).collect()


def test_linear_field_is_sampled_exactly_and_outside_is_null(spark):
    grid = spark.range(4).selectExpr("id AS i").crossJoin(spark.range(4).selectExpr("id AS j")).crossJoin(spark.range(4).selectExpr("id AS k"))
    grid = grid.selectExpr("1L AS structure_id", "CAST(i AS INT) i", "CAST(j AS INT) j", "CAST(k AS INT) k", "CAST(2*i - 3*j + 5*k AS DOUBLE) AS value")
    meta = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 4, 4, 4, 0.5, 0.5, 0.5)], "structure_id long, ox double, oy double, oz double, nx long, ny long, nz long, hx double, hy double, hz double")
    points = spark.createDataFrame([(1, 1, 0.6, 0.1, 1.2), (1, 2, 1.5, 0.1, 0.1), (1, 3, -0.1, 0.0, 0.0)], "structure_id long, atom_id long, x double, y double, z double")
    got = {r["atom_id"]: r["potential"] for r in EL.sample_grid(points, grid, meta, ["atom_id"]).collect()}
    assert got[1] == pytest.approx(2 * 1.2 - 3 * 0.2 + 5 * 2.4) and got[2] is None and got[3] is None


@pytest.mark.parametrize("spacing", [0.5, 1.0, 4.0])
def test_samples_made_in_bricks_equal_those_of_the_grid(spark, monkeypatch, spacing):
    """Cells between bricks, equal places, places outside, a structure without charges."""
    monkeypatch.setattr(EL, "BRICK", 8)
    rng = np.random.default_rng(9)
    place = rng.uniform(0, 20, (60, 3))
    place[7] = place[8]
    rows = [("A", k, "ALA", "CA", "C", *p, {"structure": 1 + k % 3}) for k, p in enumerate([*place, [99.0, 0, 0]])]
    atoms = atom_rows(spark, rows)
    again = atoms.unionByName(atoms.filter("atom_id % 5 = 0"))
    charges = atoms.filter("x < 90").selectExpr("structure_id", "atom_id", "x", "y", "z", "CAST(atom_id % 5 - 2 AS DOUBLE) * IF(structure_id = 3, 0, 1) AS charge")
    meta, grid = EL.coulomb_grid(charges, spacing, 2.0)
    want = EL.sample_grid(again, grid, meta, ["atom_id"])
    got = EL.sample_coulomb(again, charges, spacing=spacing, padding=2.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(cell" not in plan and set(got.columns) == set(want.columns)
    values = [sorted(((r["atom_id"], r["potential"]) for r in df.collect()), key=str) for df in (got, want)]
    assert len(values[0]) == len(values[1]) == again.count()
    for (a, v), (b, w) in zip(*values):
        assert a == b and (v is None) == (w is None) and (v is None or v == pytest.approx(w, abs=1e-9))
    assert any(v is None for _, v in values[0]) and any(v for _, v in values[0])


def test_a_grid_of_many_blocks_with_a_hole_is_sampled_without_rows_per_corner(spark):
    ids = spark.range(13)
    grid = ids.selectExpr("CAST(id AS INT) i").crossJoin(ids.selectExpr("CAST(id AS INT) j")).crossJoin(ids.selectExpr("CAST(id AS INT) k"))
    grid = grid.selectExpr("1L AS structure_id", "i", "j", "k", "CAST(2*i - 3*j + 5*k AS DOUBLE) AS value").filter("NOT (i = 4 AND j = 4 AND k = 4)")
    meta = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 13, 13, 13, 1.0, 1.0, 1.0)], "structure_id long, ox double, oy double, oz double, nx long, ny long, nz long, hx double, hy double, hz double")
    places = np.random.default_rng(7).random((300, 3)) * 12
    rows = [(1, n, *map(float, p)) for n, p in enumerate(places)] + [(1, 300, 4.25, 4.0, 4.0), (1, 301, 12.5, 1.0, 1.0), (2, 302, 1.0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "structure_id long, atom_id long, x double, y double, z double")
    found = EL.sample_grid(points, scaling.cut_lineage(grid), meta, ["atom_id"])
    got = {r["atom_id"]: r["potential"] for r in found.collect()}
    for n, p in enumerate(places):
        if not all(3 < v < 5 for v in p):
            assert got[n] == pytest.approx(2 * p[0] - 3 * p[1] + 5 * p[2], abs=1e-9)
    assert got[300] == pytest.approx(0.25 * (2 * 5 - 3 * 4 + 5 * 4)) and got[301] is None and got[302] is None
    assert "[0,1,2,3,4,5,6,7]" not in found._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- secondary structure
def helix(n=16, chain="A", start=1, shift=0.0):
    spots = {"N": (1.55, -27.5, -0.9), "CA": (2.28, 0.0, 0.0), "C": (1.67, 26.4, 1.12), "O": (2.0, 23.6, 2.32)}
    rows = []
    for i in range(n):
        for name, (r, phase, up) in spots.items():
            t = math.radians(100 * i + phase)
            rows.append((chain, start + i, "ALA", name, name[0], r * math.cos(t) + shift, r * math.sin(t), 1.5 * i + up))
    return rows


def by_residue(df):
    return {(r["chain_id"], r["res_id"]): r["ss"] for r in df.collect()}


def test_ideal_helix(spark):
    got = by_residue(secondary.assign_residues(atom_rows(spark, helix())))
    text = "".join(got["A", i] for i in range(1, 17))
    assert text[0] == "-" and set(text[2:13]) == {"H"}


def test_two_chains_are_not_one_and_water_has_no_class(spark):
    rows = helix(8) + helix(8, "B", 1, 60.0) + [("C", 1, "HOH", "O", "O", 99, 0, 0, {"hetero": True})]
    rows += [("C", 2, "ALA", "CA", "C", 120, 0, 0)]
    atoms = secondary.secondary_structure(atom_rows(spark, rows))
    shown = {(r["chain_id"], r["res_id"]): r["ss"] for r in atoms.collect()}
    assert shown["C", 1] == "" and shown["C", 2] == ""
    assert [shown["A", i] for i in range(1, 9)] == [shown["B", i] for i in range(1, 9)]


def test_bare_trace_is_refused(spark):
    with pytest.raises(ValueError, match="complete backbone"):
        secondary.secondary_structure(atom_rows(spark, [("A", 1, "ALA", "CA", "C", 0, 0, 0)]), strict=True)


BONDS = "structure_id long, i long, j long, seg_i long, seg_j long"


@pytest.mark.parametrize("seed", range(4))
def test_bridges_match_the_definition(spark, seed):
    """Random bonds and chain breaks against the four rules read pair by pair."""
    rng = np.random.default_rng(seed)
    n = 40
    link = rng.random(n) > 0.15
    link[0] = False
    seg = np.cumsum(~link)
    bonds = {tuple(map(int, p)) for p in rng.integers(0, n, size=(300, 2)) if abs(p[0] - p[1]) >= 2}
    want = set()
    for i in range(1, n - 1):
        for j in range(i + 3, n - 1):
            if seg[i - 1] != seg[i + 1] or seg[j - 1] != seg[j + 1]:
                continue
            has = lambda a, b: (a, b) in bonds
            if (has(i - 1, j) and has(j, i + 1)) or (has(j - 1, i) and has(i, j + 1)):
                want.add((i, j, "P"))
            elif (has(i, j) and has(j, i)) or (has(i - 1, j + 1) and has(j - 1, i + 1)):
                want.add((i, j, "A"))
    table = spark.createDataFrame([(1, a, b, int(seg[a]), int(seg[b])) for a, b in bonds], BONDS)
    residues = spark.createDataFrame([(1, i, bool(link[i])) for i in range(n)], "structure_id long, i long, link_prev boolean")
    got = {(r["i"], r["j"], r["kind"]) for r in secondary.bridges(table, residues).collect()}
    assert got == want
    steps = secondary.ladders(secondary.bridges(table, residues)).collect()
    assert sum(s["size"] for s in steps) == len(want)
    assert all(s["i_hi"] - s["i_lo"] + 1 == s["size"] == s["j_hi"] - s["j_lo"] + 1 for s in steps)


def test_short_helix_touching_an_alpha_helix_is_dropped_whole(spark):
    turned = [(1, 1, 4), (1, 2, 4), (1, 4, 3), (1, 5, 3), (1, 20, 3), (1, 21, 3)]
    df = spark.createDataFrame([(s, i, n, 0, 0) for s, i, n in turned], "structure_id long, i long, n int, seg_i long, seg_j long")
    got = {(r["i"], r["letter"]) for r in secondary.helices(df).collect()}
    assert got == {(i, "H") for i in range(2, 6)} | {(i, "G") for i in (21, 22, 23)}


# ---------------------------------------------------------------- paths, fields, volumes, measures
def path(spark, *frames):
    return spark.createDataFrame([(1, k, *f) for k, f in enumerate(frames)], "path_id long, ord long, position array<double>, target array<double>, up array<double>")


UP = [0.0, 1.0, 0.0]


def test_half_turn_keeps_its_distance(spark):
    rows = keyframes.resample_keyframes(path(spark, ([0.0, 0.0, 10.0], [0.0] * 3, UP), ([0.0, 0.0, -10.0], [0.0] * 3, UP)), 9).orderBy("frame").collect()
    assert len(rows) == 9
    for r in rows:
        assert math.hypot(r["position_x"], r["position_y"], r["position_z"]) == pytest.approx(10.0)
    assert rows[0]["position_z"] == pytest.approx(10.0) and rows[-1]["position_z"] == pytest.approx(-10.0)


def test_dolly_is_a_straight_line_and_eases(spark):
    rows = keyframes.resample_keyframes(path(spark, ([0.0, 0.0, 10.0], [0.0] * 3, UP), ([0.0, 0.0, 20.0], [0.0] * 3, UP)), 5, "ease-in").orderBy("frame").collect()
    assert [r["position_z"] for r in rows] == pytest.approx([10 + 10 * (k / 4) ** 2 for k in range(5)], abs=1e-6)


def test_path_refusals(spark):
    one = path(spark, ([0.0, 0.0, 1.0], [0.0] * 3, UP))
    two = path(spark, ([0.0, 0.0, 1.0], [0.0, 0.0, 1.0], UP), ([1.0, 0.0, 1.0], [0.0] * 3, UP))
    for call in (
        lambda: keyframes.resample_keyframes(two, 1),
        lambda: keyframes.resample_keyframes(two, 5, "bounce"),
        lambda: keyframes.resample_keyframes(one, 5, strict=True),
        lambda: keyframes.resample_keyframes(two, 5).collect(),
    ):
        with pytest.raises(Exception):
            call()


def test_lying_header_is_not_believed(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(0.5, 0.25, size=(6, 7, 8))
    rows = [(1, z, y, x, float(v)) for (z, y, x), v in np.ndenumerate(data)]
    voxels = spark.createDataFrame(rows, "volume_id long, iz long, iy long, ix long, value double")
    meta = spark.createDataFrame([(1, -999.0, 999.0, 42.0, 7.0, " Measured")], "volume_id long, stated_min double, stated_max double, stated_mean double, stated_sigma double, provenance string")
    row = volumes.volume_stats(voxels, volumes.declare_provenance(meta), strict=True).collect()[0]
    assert (row["nx"], row["ny"], row["nz"], row["voxels"]) == (8, 7, 6, 336)
    assert row["mean"] == pytest.approx(data.mean()) and row["sigma"] == pytest.approx(data.std())
    assert row["provenance"] == "measured" and row["caveat"]
    level = volumes.isolevel(volumes.volume_stats(voxels, meta), 2.0)
    got = level.collect()[0]
    assert got["absolute"] == pytest.approx(data.mean() + 2 * data.std()) and got["stated_absolute"] == 56.0
    assert volumes.voxels_above(voxels, level).collect()[0]["voxels_above"] == int((data >= got["absolute"]).sum())
    with pytest.raises(ValueError):
        volumes.isolevel(meta, 1.0, "rmsd")
    with pytest.raises(ValueError):
        volumes.isolevel(meta, float("inf"))
    with pytest.raises(ValueError):
        volumes.volume_stats(voxels.limit(0), meta, strict=True)
    with pytest.raises(Exception, match="unknown provenance"):
        volumes.declare_provenance(meta.withColumn("provenance", F.lit("mesured"))).collect()


def test_field_rules(spark, mixed):
    def field(*rows):
        return spark.createDataFrame([(1, *r) for r in rows], "structure_id long, chain_id string, res_id int, ins_code string, value double")

    row = fields.field_coverage(field(("A", 1, "", 2.0), ("Q", 1, "", 4.0)), mixed, strict=True).collect()[0]
    assert (row["matched"], row["unmatched"], row["unknown"]) == (1, 3, 1)
    for bad in (field(("A", 1, "", 1.0), ("A", 1, "", 2.0)), field(("Q", 1, "", 1.0)), field().limit(0)):
        with pytest.raises(ValueError):
            fields.field_coverage(bad, mixed, strict=True)
    flat = fields.field_fraction(field(("A", 1, "", 3.0), ("A", 2, "", 3.0))).collect()
    assert {r["fraction"] for r in flat} == {0.5}
    clamped = fields.field_fraction(field(("A", 1, "", 9.0)), (0.0, 4.0)).collect()
    assert clamped[0]["fraction"] == 1.0
    with pytest.raises(ValueError):
        domain_fraction(F.lit(1), F.lit(0), F.lit(1), (2.0, 2.0))
    with pytest.raises(ValueError):
        rescale(F.lit(1), F.lit(0), F.lit(1), "log")


def test_measures(spark, mixed):
    handles = None
    for name, atom in (("n", 1), ("ca", 2), ("cb", 5), ("zn", 8)):
        handles = sets.register(handles, mixed.filter(F.col("atom_id") == atom), name)
    value = lambda kind, *names: measure.measure(mixed, handles, kind, list(names), strict=True).collect()[0]["value"]
    assert value("distance", "n", "ca") == pytest.approx(1.5)
    assert value("angle", "n", "ca", "cb") == pytest.approx(90.0)
    assert abs(value("dihedral", "n", "ca", "cb", "zn")) == pytest.approx(180.0)
    for bad in (("distance", "n"), ("angle", "n", "ca"), ("area", "n", "ca"), ("distance", "n", "nothing")):
        with pytest.raises(ValueError):
            value(*bad)


def test_area_of_a_crowded_cube_equals_a_plain_count_and_pairs_never_become_rows(spark, monkeypatch):
    from atom_tables import atom_rows
    from atomframe.plans import sasa

    monkeypatch.setattr(sasa, "ROWS", 32)
    monkeypatch.setattr(sasa, "NEAR", 8)
    rng = np.random.default_rng(11)
    place = np.round(rng.uniform(0, 12, (120, 3)), 3)
    chain = ["A" if k % 3 else "B" for k in range(120)]
    atoms = atom_rows(spark, [(c, k, "ALA", "CA", "C", *p) for k, (c, p) in enumerate(zip(chain, place))])
    found = sasa.accessible_area(atoms, points=70)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    ball, r = sasa.fibonacci_sphere(70), 1.88 + 1.4
    for row in found.collect():
        k = row["atom_id"] - 1
        spots = place[k] + r * ball
        near = np.linalg.norm(spots[:, None] - place[None], axis=2) < r
        near[:, k] = False
        own = near[:, [c == chain[k] for c in chain]]
        assert (row["free"], row["free_alone"]) == ((~near.any(1)).sum(), (~own.any(1)).sum())


def test_hidden_points_are_looked_up_and_equal_a_test_of_every_point():
    import time

    rng = np.random.default_rng(7)
    ball = sasa.fibonacci_sphere(1000)
    i = np.repeat(np.arange(500), 60)
    far = rng.uniform(0.0, 6.5, len(i))
    far[::97] = 0.0
    shift = rng.normal(size=(3, len(i)))
    shift *= far / np.linalg.norm(shift, axis=0)
    ra, rb = rng.choice([2.81, 3.04, 3.28], (2, len(i)))
    reach = (ra * ra + far * far - rb * rb) / (2 * ra)
    caps, known = sasa.Caps(ball), np.zeros((500, 16), np.int64)
    spent = []
    for find in (lambda: caps.hidden(i, shift, np.linalg.norm(shift, axis=0), reach, known), lambda: sasa._each(ball, i, shift, reach, known)):
        start = time.process_time()
        spent.append((find(), time.process_time() - start))
    assert (spent[0][0] == spent[1][0]).all() and spent[0][0].any()
    assert 2 * spent[0][1] < spent[1][1]


def test_far_and_unusable_places_hide_nothing_and_cubes_are_met_together(spark):
    """Distant cubes, cubes below zero, places that are no numbers, and atoms of several cubes in one batch."""
    rng = np.random.default_rng(5)
    spots = np.concatenate([rng.uniform(-30, 30, (150, 3)), rng.uniform(-3, 3, (40, 3)) + [1e7, -1e7, 1e7], [[np.nan, 0, 0], [np.inf, 1, 1]]])
    atoms = atom_rows(spark, [("A" if k % 2 else "B", k, "ALA", "CB", "C", *p) for k, p in enumerate(spots)])
    found = {r["atom_id"] - 1: (r["free"], r["free_alone"]) for r in sasa.accessible_area(atoms, points=100).collect()}
    ball, r = sasa.fibonacci_sphere(100), 1.88 + 1.4
    assert len(found) == len(spots) and found[190] == found[191] == (100, 100)
    for k in range(190):
        near = np.linalg.norm((spots[k] + r * ball)[:, None] - spots[None, :190], axis=2) < r
        near[:, k] = False
        own = near[:, k % 2 :: 2]
        assert found[k] == ((~near.any(1)).sum(), (~own.any(1)).sum())


def test_an_atom_is_copied_to_few_cubes(spark):
    rng = np.random.default_rng(3)
    atoms = atom_rows(spark, [("A", k, "ALA", "CB", "C", *p) for k, p in enumerate(rng.uniform(0, 80, (400, 3)))])
    widest = 2 * (1.88 + 1.4)
    assert sasa.reaching_cubes(atoms, widest, sasa.EDGE * widest).count() < 3 * 400


def test_rounds_of_outlier_removal_need_no_jobs_of_their_own(spark):
    """Pairs that need one to many rounds, against the definition with the library's own fit; tables written once."""
    rng = np.random.default_rng(21)
    rows, want = [], {}
    for pair in range(6):
        m = rng.normal(size=(40, 3)) * 9
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        t = m @ (turn * np.sign(np.linalg.det(turn))).T + 4.0 + rng.normal(size=(40, 3)) * 0.05
        t[: 2 * pair] += rng.normal(size=(2 * pair, 3)) * np.logspace(0, 1.5, 2 * pair)[:, None]
        rows += [(pair, k, k, *map(float, (*m[k], *t[k])), "ALA") for k in range(40)]
        left, lost = np.arange(40), 0
        while lost < 10:
            fits = {r["pair_id"]: r for r in fit.kabsch(spark.createDataFrame([(pair, *map(float, (*m[k], *t[k]))) for k in left], "pair_id long, mx double, my double, mz double, tx double, ty double, tz double"), ["pair_id"]).collect()}[pair]
            moved = np.array([[fits[f"r{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)])
            square = ((m[left] @ moved.T + [fits["tx"], fits["ty"], fits["tz"]] - t[left]) ** 2).sum(1)
            low, high = np.percentile(square, [25, 75])
            near = square <= high + 1.5 * (high - low)
            if near.all():
                break
            left, lost = left[near], lost + 1
        want[pair] = ({int(k) for k in left}, min(lost + 1, 10), lost < 10)
    anchors = spark.createDataFrame(rows, "pair_id long, m long, t long, mx double, my double, mz double, tx double, ty double, tz double, name string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rounds", "outliers")
    kept, rounds = fit._without_outliers(anchors)
    got, told = kept.collect(), {r["pair_id"]: (r["rounds"], r["settled"]) for r in rounds.collect()}
    ran = len(jobs.getJobIdsForGroup("rounds"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for pair, (left, *more) in want.items():
        assert {r["m"] for r in got if r["pair_id"] == pair} == left and told[pair] == tuple(more)
    assert max(r for r, _ in told.values()) > 2 and ran <= 6 and set(kept.columns) == set(anchors.columns)


def test_residues_are_written_once_and_pairs_settle_apart(spark):
    """Two pairs that need different rounds; residues are read from written tables."""
    three = {v: k for k, v in __import__("atomframe.schema", fromlist=["x"]).ONE_LETTER.items()}
    x = np.cumsum(np.random.default_rng(3).normal(size=(len(SEQUENCE), 3)) * 2.2, axis=0)
    y = x.copy()
    y[14:17] += 9.0
    rows = [("A", i + 1, three[c], "CA", "C", *v[i], {"structure": k}) for k, v in ((1, x), (2, y), (3, x)) for i, c in enumerate(SEQUENCE)]
    pairs = spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "pair_id long, mobile_id long, target_id long")
    found = fit.superpose(pairs, atom_rows(spark, rows))
    assert all("cut-" in f for s in ("mobile", "target") for f in found["residues"][s].inputFiles()[:1] or [""])
    got = {r["pair_id"]: r for r in found["fits"].collect()}
    assert got[1]["aligned"] <= len(SEQUENCE) - 3 and got[1]["rounds"] > 1 and got[1]["settled"]
    assert got[2]["rmsd"] < 1e-6 and got[2]["identity"] == 1.0
