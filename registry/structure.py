"""Interfaces and accessible area, secondary structure and the steps it is made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomframe.operators import predicates as P
from atomframe.plans import interface as I
from atomframe.plans import sasa as A
from atomframe.plans import secondary as SS
from atomframe.scaling import cut_lineage

from .core import query
from .fixtures import (
    AMINO, RESKEY, SQL_BONDS, SQL_COPIES, SQL_FOLD, SQL_PROTONS, fx_atoms, fx_bonds, fx_copies, fx_fold,
    fx_protons, sql,
)
from .graph import recursive
from .selections import STATE, close, dist, ids

SIX = [(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, -1.0)]
SPHERE = "(VALUES " + ", ".join(f"({x:g}.0::DOUBLE, {y:g}.0::DOUBLE, {z:g}.0::DOUBLE)" for x, y, z in SIX) + ") p(px, py, pz)"
RADIUS = """CASE WHEN res_name = 'HOH' THEN NULL WHEN element = 'C' AND atom_name = 'C' THEN 1.61 WHEN element = 'C' THEN 1.88
  WHEN element = 'N' THEN 1.64 WHEN element = 'O' AND res_name = 'SER' AND atom_name = 'OG' THEN 1.46 WHEN element = 'O' THEN 1.42
  WHEN element = 'S' THEN 1.77 ELSE 1.8 END"""


#: The operators' own 1000 test points.
BALL = """(SELECT sqrt(1 - pz*pz) * cos(turn) AS px, sqrt(1 - pz*pz) * sin(turn) AS py, pz FROM (
      SELECT 1 - (2 * k + 1)::DOUBLE / 1000 AS pz, pi() * (3 - sqrt(5::DOUBLE)) * k AS turn FROM range(1000) t(k))) p"""


def area_sql(source: str, key: str = "structure_id, atom_id", sphere: str = SPHERE, points: int = 6) -> str:
    """Free test points per atom of ``source``, in company and with its own chain only."""
    same = " AND ".join(f"b.{c} = a.{c}" for c in key.split(", ") if c != "atom_id")
    d2 = "((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z))"
    return f"""sized AS (SELECT *, CAST({RADIUS} AS DOUBLE) + CAST(1.4 AS DOUBLE) AS r FROM {source}),
  hides AS (SELECT a.structure_id, {'a.sym_id, ' if 'sym_id' in key else ''}a.atom_id, px, py, pz, bool_or(a.chain_id = b.chain_id) AS own
    FROM sized a JOIN sized b ON {same} AND b.atom_id <> a.atom_id AND {d2} < (a.r + b.r) * (a.r + b.r)
    JOIN {sphere} ON px*(b.x-a.x) + py*(b.y-a.y) + pz*(b.z-a.z) > (a.r*a.r + {d2} - b.r*b.r) / (2*a.r) GROUP BY ALL),
  lost AS (SELECT {key}, count(*) AS n, count(*) FILTER (WHERE own) AS n_own FROM hides GROUP BY {key}),
  area AS (SELECT s.*, coalesce(4*pi()/{points}*s.r*s.r*({points} - coalesce(n, 0)), 0) AS area, coalesce(4*pi()/{points}*s.r*s.r*({points} - coalesce(n_own, 0)), 0) AS area_alone
    FROM sized s LEFT JOIN lost USING ({key}))"""


@query("m1_sasa", sql("SELECT structure_id, atom_id, round(area, 6) AS area FROM area", area_sql("fx_atoms")))
def sasa(spark, sf_dir):
    out = A.sasa(fx_atoms(spark, sf_dir), sphere=SIX)
    return out.withColumn("area", F.round("area", 6))


@query("m1_sasa_fine")
def sasa_fine(spark, sf_dir):
    return A.sasa(fx_atoms(spark, sf_dir))


DRY = "dry AS MATERIALIZED (SELECT * FROM fx_state WHERE res_name <> 'HOH' AND chain_id IN ('A','B'))"
DELTA = (STATE, DRY, area_sql("dry"))
DELTA_FINE = (STATE, DRY, area_sql("dry", sphere=BALL, points=1000))
BURIED = f"""kept AS MATERIALIZED (SELECT {RESKEY}, min(res_name) AS res_name, sum(area_alone - area) AS buried FROM area
  WHERE area_alone - area > 0 GROUP BY {RESKEY} HAVING sum(area_alone - area) > 1)"""


@query("m2_delta_sasa", sql("SELECT structure_id, atom_id, round(area_alone - area, 6) AS delta FROM area", *DELTA))
def delta_sasa(spark, sf_dir):
    out = I.buried(fx_atoms(spark, sf_dir), "A", "B", sphere=SIX)
    return out.select("structure_id", "atom_id", F.round("delta", 6).alias("delta"))


@query("a7_buried_residues", sql(f"SELECT {RESKEY}, res_name, round(buried, 6) AS buried FROM kept", *DELTA, BURIED))
def buried_residues(spark, sf_dir):
    out = I.interface_residues(I.buried(fx_atoms(spark, sf_dir), "A", "B", sphere=SIX))
    return out.withColumn("buried", F.round("buried", 6))


@query(
    "t6_ranked_residues",
    sql(f"SELECT {RESKEY}, res_name, round(buried, 1) AS buried FROM kept", *DELTA_FINE, BURIED),
)
def ranked_residues(spark, sf_dir):
    out = I.interface_residues(I.buried(fx_atoms(spark, sf_dir), "A", "B"))
    return I.ranked_residues(out)


@query("a7_buried_totals", sql("SELECT structure_id, chain_id, round(sum(area_alone - area), 6) + 0 AS buried FROM area GROUP BY 1, 2", *DELTA))
def buried_totals(spark, sf_dir):
    out = I.interface_totals(I.buried(fx_atoms(spark, sf_dir), "A", "B", sphere=SIX))
    return out.withColumn("buried", F.round("buried", 6) + F.lit(0.0))


@query(
    "a8_interface_atoms",
    sql(f"SELECT structure_id, atom_id FROM dry JOIN (SELECT {RESKEY} FROM kept) USING ({RESKEY})", *DELTA_FINE, BURIED),
)
def interface_atoms(spark, sf_dir):
    delta = I.buried(fx_atoms(spark, sf_dir), "A", "B")
    return ids(I.interface_atoms(delta, I.interface_residues(delta)))


@query(
    "m20_interface_sets",
    sql("SELECT structure_id, chain_id, count(*) AS contact_residues FROM kept GROUP BY 1, 2", *DELTA, BURIED),
)
def interface_sets(spark, sf_dir):
    return I.interface_sets(fx_atoms(spark, sf_dir), "A", "B", sphere=SIX)["counts"]


# the same at the operators' own 1000 sphere points; SQL checks the six-point forms above
def fine(spark, sf_dir):
    return I.buried(fx_atoms(spark, sf_dir), "A", "B")


@query("m2_delta_sasa_fine")
def delta_sasa_fine(spark, sf_dir):
    return fine(spark, sf_dir).select("structure_id", "atom_id", "delta")


@query("a7_buried_residues_fine")
def buried_residues_fine(spark, sf_dir):
    return I.interface_residues(fine(spark, sf_dir))


@query("t6_ranked_residues_fine")
def ranked_residues_fine(spark, sf_dir):
    return I.ranked_residues(I.interface_residues(fine(spark, sf_dir)))


@query("a7_buried_totals_fine")
def buried_totals_fine(spark, sf_dir):
    return I.interface_totals(fine(spark, sf_dir))


@query("a8_interface_atoms_fine")
def interface_atoms_fine(spark, sf_dir):
    delta = fine(spark, sf_dir)
    return ids(I.interface_atoms(delta, I.interface_residues(delta)))


@query("m20_interface_sets_fine")
def interface_sets_fine(spark, sf_dir):
    return I.interface_sets(fx_atoms(spark, sf_dir), "A", "B")["counts"]


@query("a9_per_copy_fine")
def per_copy_fine(spark, sf_dir):
    delta = I.buried(fx_copies(spark, sf_dir), "A", "B", per_copy=True)
    return I.interface_copies(I.interface_totals(delta, per_copy=True))


COPY_STATE = """fx_cstate AS (SELECT * FROM fx_copies WHERE chain_id IN ('A','B') AND res_name <> 'HOH' AND altloc_id = '.' UNION ALL
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, sym_id, chain_id, res_id,
    ins_code, atom_name ORDER BY occupancy DESC, altloc_id, atom_id) AS rn
    FROM fx_copies WHERE altloc_id <> '.' AND chain_id IN ('A','B') AND res_name <> 'HOH') WHERE rn = 1)"""


@query(
    "a9_per_copy",
    sql("SELECT structure_id, sym_id, round(sum(area_alone - area), 6) + 0 AS buried FROM area GROUP BY 1, 2",
        SQL_COPIES, COPY_STATE, area_sql("fx_cstate", "structure_id, sym_id, atom_id")),
)
def per_copy(spark, sf_dir):
    delta = I.buried(fx_copies(spark, sf_dir), "A", "B", per_copy=True, sphere=SIX)
    out = I.interface_copies(I.interface_totals(delta, per_copy=True))
    return out.withColumn("buried", F.round("buried", 6) + F.lit(0.0))


KINDS = f"""side_a AS MATERIALIZED (SELECT * FROM dry WHERE chain_id = 'A'), side_b AS MATERIALIZED (SELECT * FROM dry WHERE chain_id = 'B'),
  contacts AS MATERIALIZED (SELECT * FROM (SELECT a.structure_id, a.atom_id AS a_atom_id, b.atom_id AS b_atom_id, {dist('a', 'b')} AS d,
    CASE WHEN ((a.res_name IN ('ASP','GLU') AND a.atom_name IN ('OD1','OE1') AND b.res_name IN ('ARG','LYS') AND b.atom_name IN ('NH1','NZ'))
        OR (b.res_name IN ('ASP','GLU') AND b.atom_name IN ('OD1','OE1') AND a.res_name IN ('ARG','LYS') AND a.atom_name IN ('NH1','NZ')))
        AND {dist('a', 'b')} <= 4 THEN 'salt_bridge'
      WHEN a.element IN ('N','O') AND b.element IN ('N','O') AND {dist('a', 'b')} <= CAST(3.5 AS DOUBLE) THEN 'polar_contact' END AS kind
  FROM side_a a JOIN side_b b ON {close('a', 'b', 4.0)}) WHERE kind IS NOT NULL)"""


@query(
    "m4_contacts",
    sql("SELECT structure_id, a_atom_id, b_atom_id, round(d, 6) AS d, kind FROM contacts", STATE, DRY, KINDS),
)
def contacts(spark, sf_dir):
    found = I.contacts(fx_atoms(spark, sf_dir), "A", "B")
    return found.select("structure_id", "a_atom_id", "b_atom_id", F.round("d", 6).alias("d"), "kind")


@query("a6_contact_counts", sql("SELECT structure_id, kind, count(*) AS n FROM contacts GROUP BY 1, 2", STATE, DRY, KINDS))
def contact_counts(spark, sf_dir):
    return I.contact_counts(I.contacts(fx_atoms(spark, sf_dir), "A", "B"))


@query(
    "t1_closest_contacts",
    sql("""SELECT structure_id, a_atom_id, b_atom_id, kind, CAST(place AS INT) AS place FROM (SELECT *,
      row_number() OVER (PARTITION BY structure_id ORDER BY d, a_atom_id, b_atom_id) AS place FROM contacts) WHERE place <= 20""",
        STATE, DRY, KINDS),
)
def closest_contacts(spark, sf_dir):
    found = I.contacts(fx_atoms(spark, sf_dir), "A", "B")
    return I.closest_contacts(found, 20).select("structure_id", "a_atom_id", "b_atom_id", "kind", "place")


HBONDS = """hbonds AS (SELECT DISTINCT structure_id, donor_atom_id, acceptor_atom_id FROM (
  SELECT d.structure_id, d.atom_id AS donor_atom_id, a.atom_id AS acceptor_atom_id, {dh} AS dh, {ha} AS ha,
    (d.x-h.x)*(a.x-h.x)+(d.y-h.y)*(a.y-h.y)+(d.z-h.z)*(a.z-h.z) AS dp
  FROM fx_protons h JOIN fx_bonds b ON (b.b = h.atom_id OR b.a = h.atom_id) AND h.element = 'H'
    JOIN fx_protons d ON d.atom_id = CASE WHEN b.b = h.atom_id THEN b.a ELSE b.b END AND d.element IN ('N','O','S')
    JOIN fx_protons a ON a.element IN ('N','O','S') AND a.chain_id <> d.chain_id AND {near}
  WHERE d.chain_id IN ('A','B') AND a.chain_id IN ('A','B')) WHERE dh > 0 AND ha > 0
    AND degrees(acos(greatest(-1, least(1, dp / (dh * ha))))) >= 120)""".format(dh=dist("d", "h"), ha=dist("a", "h"), near=close("a", "h", 2.5))


@query("m5_hydrogen_bonds", sql("SELECT * FROM hbonds", SQL_PROTONS, SQL_BONDS, HBONDS))
def hydrogen_bonds(spark, sf_dir):
    found = I.hbonds(fx_protons(spark, sf_dir), fx_bonds(spark, sf_dir), "A", "B")
    return found.select("structure_id", "donor_atom_id", "acceptor_atom_id")


@query(
    "m19_sidechains",
    sql(f"""SELECT structure_id, atom_id FROM fx_atoms a WHERE res_name IN {AMINO} AND (atom_name NOT IN ('N','CA','C','O','OXT')
      OR (atom_name = 'CA' AND ({RESKEY}) IN (SELECT ({RESKEY}) FROM fx_atoms WHERE res_name IN {AMINO} AND atom_name NOT IN ('N','CA','C','O','OXT'))))"""),
)
def sidechains(spark, sf_dir):
    return ids(I.sidechains_with_anchor(fx_atoms(spark, sf_dir)))


# ---------------------------------------------------------------- secondary structure
def d(p: str, q: str) -> str:
    """Distance between points written as 'alias.prefix'."""
    return "sqrt(" + "+".join(f"({p}{c}-{q}{c})*({p}{c}-{q}{c})" for c in "xyz") + ")"


def spots() -> str:
    return ", ".join(
        f"max({c}) FILTER (WHERE atom_name = '{name}') AS {slot}{c}" for name, slot in SS.SLOTS.items() for c in "xyz"
    )


BACKBONE = f"""bb AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY first_seen) - 1 AS i FROM (
    SELECT {RESKEY}, res_name, min(atom_id) AS first_seen, {spots()} FROM fx_fold GROUP BY {RESKEY}, res_name)),
  link AS (SELECT *, coalesce({d('n', 'pc')} < CAST(2.5 AS DOUBLE) AND pchain = chain_id, false) AS link_prev FROM (
    SELECT *, lag(chain_id) OVER w AS pchain, {", ".join(f"lag({s}{c}) OVER w AS p{s}{c}" for s in "co" for c in "xyz")}
    FROM bb WINDOW w AS (PARTITION BY structure_id ORDER BY i))),
  run AS (SELECT *, {", ".join(f"CASE WHEN link_prev AND res_name <> 'PRO' THEN n{c} + (pc{c}-po{c})/{d('pc', 'po')} END AS h{c}" for c in "xyz")},
    sum(CASE WHEN link_prev THEN 0 ELSE 1 END) OVER (PARTITION BY structure_id ORDER BY i) AS seg FROM link)"""
ENERGY = f"""CASE WHEN least({d('a.o', 'b.n')}, {d('a.c', 'b.h')}, {d('a.o', 'b.h')}, {d('a.c', 'b.n')}) < CAST(0.5 AS DOUBLE) THEN CAST(-9.9 AS DOUBLE)
  ELSE CAST(0.42 AS DOUBLE)*CAST(0.20 AS DOUBLE)*332*(1/{d('a.o', 'b.n')} + 1/{d('a.c', 'b.h')} - 1/{d('a.o', 'b.h')} - 1/{d('a.c', 'b.n')}) END"""
HB = f"""hb AS (SELECT a.structure_id, a.i, b.i AS j, a.seg AS seg_i, b.seg AS seg_j FROM run a JOIN run b ON a.structure_id = b.structure_id
  AND abs(a.i - b.i) >= 2 AND b.hx IS NOT NULL AND {d('a.a', 'b.a')} <= 9 AND {ENERGY} < CAST(-0.5 AS DOUBLE))"""
TURN = "turn AS (SELECT structure_id, i, CAST(j - i AS INT) AS n, seg_i, seg_j FROM hb WHERE j - i IN (3, 4, 5))"
HELIX = """hstart AS (SELECT t.structure_id, t.n, t.i FROM turn t JOIN turn p ON p.structure_id = t.structure_id AND p.n = t.n AND p.i = t.i - 1 AND p.seg_i = t.seg_j),
  hcov AS (SELECT structure_id, n, i AS start, unnest(range(i, i + n)) AS i FROM hstart),
  helix AS (SELECT DISTINCT structure_id, i, CASE n WHEN 5 THEN 'I' WHEN 4 THEN 'H' ELSE 'G' END AS letter FROM hcov h WHERE n > 3 OR NOT EXISTS (
    SELECT 1 FROM hcov g JOIN hcov k ON k.structure_id = g.structure_id AND k.i = g.i AND k.n > 3 WHERE g.n = 3 AND g.structure_id = h.structure_id AND g.start = h.start))"""
BEND = f"""bend AS (SELECT b.structure_id, b.i FROM run b JOIN run a ON a.structure_id = b.structure_id AND a.i = b.i - 2 JOIN run c ON c.structure_id = b.structure_id AND c.i = b.i + 2
  WHERE a.seg = c.seg AND degrees(acos(greatest(-1, least(1, ({"+".join(f"(b.a{k}-a.a{k})*(c.a{k}-b.a{k})" for k in "xyz")}) / ({d('a.a', 'b.a')} * {d('b.a', 'c.a')}))))) > 70)"""
SS_PARTS = (SQL_FOLD, BACKBONE, HB, TURN, HELIX, BEND)


def fold(spark, sf_dir):
    return SS.linked(cut_lineage(SS.backbone(fx_fold(spark, sf_dir))))


@query("w1_peptide_links", sql("SELECT structure_id, i, link_prev FROM run", SQL_FOLD, BACKBONE))
def peptide_links(spark, sf_dir):
    return fold(spark, sf_dir).select("structure_id", "i", "link_prev")


@query("w2_runs", sql("SELECT structure_id, i, CAST(seg AS BIGINT) AS seg FROM run", SQL_FOLD, BACKBONE))
def runs(spark, sf_dir):
    return fold(spark, sf_dir).select("structure_id", "i", "seg")


@query(
    "w3_first_occurrence",
    sql(f"""SELECT {RESKEY}, x, y FROM (SELECT {RESKEY}, arg_min(x, atom_id) FILTER (WHERE atom_name = 'CA') AS x,
      arg_min(y, atom_id) FILTER (WHERE atom_name = 'CA') AS y, count(DISTINCT atom_name) FILTER (WHERE atom_name IN ('N','CA','C','O')) AS slots
      FROM fx_atoms WHERE res_name IN {AMINO} GROUP BY {RESKEY}) WHERE slots = 4"""),
)
def first_occurrence(spark, sf_dir):
    out = SS.backbone(fx_atoms(spark, sf_dir))
    return out.select("structure_id", "chain_id", "res_id", "ins_code", F.col("ax").alias("x"), F.col("ay").alias("y"))


@query(
    "x3_amide_hydrogen",
    sql("SELECT structure_id, i, round(hx, 9) AS hx, round(hy, 9) AS hy, round(hz, 9) AS hz FROM run", SQL_FOLD, BACKBONE),
)
def amide_hydrogen(spark, sf_dir):
    out = fold(spark, sf_dir)
    return out.select("structure_id", "i", *[F.round(c, 9).alias(c) for c in ("hx", "hy", "hz")])


@query("x2_backbone_bonds", sql("SELECT structure_id, i, j FROM hb", SQL_FOLD, BACKBONE, HB))
def backbone_bonds(spark, sf_dir):
    return SS.backbone_bonds(fold(spark, sf_dir)).select("structure_id", "i", "j")


@query("w4_turns", sql("SELECT structure_id, i, n FROM turn", SQL_FOLD, BACKBONE, HB, TURN))
def turns(spark, sf_dir):
    return SS.turns(SS.backbone_bonds(fold(spark, sf_dir))).select("structure_id", "i", "n")


@query("w5_helices", sql("SELECT structure_id, i, letter FROM helix", SQL_FOLD, BACKBONE, HB, TURN, HELIX))
def helices(spark, sf_dir):
    bonds = cut_lineage(SS.backbone_bonds(fold(spark, sf_dir)))
    return SS.helices(SS.turns(bonds)).distinct()


BRIDGE = """mid AS (SELECT r.structure_id, r.i FROM run r JOIN run n ON n.structure_id = r.structure_id AND n.i = r.i + 1 AND n.link_prev WHERE r.link_prev),
  pair AS (SELECT DISTINCT structure_id, i, j FROM (
    SELECT structure_id, i + 1 AS i, j FROM hb UNION ALL SELECT structure_id, j - 1, i FROM hb UNION ALL SELECT structure_id, j, i + 1 FROM hb
    UNION ALL SELECT structure_id, i, j - 1 FROM hb UNION ALL SELECT structure_id, i, j FROM hb UNION ALL SELECT structure_id, j, i FROM hb
    UNION ALL SELECT structure_id, i + 1, j - 1 FROM hb UNION ALL SELECT structure_id, j - 1, i + 1 FROM hb)
    WHERE i + 3 <= j AND (structure_id, i) IN (SELECT (structure_id, i) FROM mid) AND (structure_id, j) IN (SELECT (structure_id, i) FROM mid)),
  has AS (SELECT DISTINCT structure_id, i, j FROM hb),
  bridge AS (SELECT * FROM (SELECT structure_id, i, j, CASE
    WHEN ((structure_id, i-1, j) IN (SELECT (structure_id, i, j) FROM has) AND (structure_id, j, i+1) IN (SELECT (structure_id, i, j) FROM has))
      OR ((structure_id, j-1, i) IN (SELECT (structure_id, i, j) FROM has) AND (structure_id, i, j+1) IN (SELECT (structure_id, i, j) FROM has)) THEN 'P'
    WHEN ((structure_id, i, j) IN (SELECT (structure_id, i, j) FROM has) AND (structure_id, j, i) IN (SELECT (structure_id, i, j) FROM has))
      OR ((structure_id, i-1, j+1) IN (SELECT (structure_id, i, j) FROM has) AND (structure_id, j-1, i+1) IN (SELECT (structure_id, i, j) FROM has)) THEN 'A' END AS kind
    FROM pair) WHERE kind IS NOT NULL)"""


@query("w6_bridges", sql("SELECT structure_id, i, j, kind FROM bridge", SQL_FOLD, BACKBONE, HB, BRIDGE))
def bridges(spark, sf_dir):
    residues = cut_lineage(fold(spark, sf_dir))
    return SS.bridges(SS.backbone_bonds(residues), residues)


LADDER = """ladder AS (SELECT structure_id, kind, min(i) AS i_lo, max(i) AS i_hi, min(j) AS j_lo, max(j) AS j_hi, count(*) AS size FROM (
    SELECT *, i - row_number() OVER (PARTITION BY structure_id, kind, CASE kind WHEN 'P' THEN j - i ELSE i + j END ORDER BY i) AS island FROM bridge)
  GROUP BY structure_id, kind, CASE kind WHEN 'P' THEN j - i ELSE i + j END, island)"""


@query("w6_ladders", sql("SELECT * FROM ladder", SQL_FOLD, BACKBONE, HB, BRIDGE, LADDER))
def ladders(spark, sf_dir):
    residues = cut_lineage(fold(spark, sf_dir))
    found = cut_lineage(SS.bridges(SS.backbone_bonds(residues), residues))
    return SS.ladders(found).drop("diagonal", "island")


@query("w8_bends", sql("SELECT structure_id, i FROM bend", SQL_FOLD, BACKBONE, BEND))
def bends(spark, sf_dir):
    return SS.bends(fold(spark, sf_dir))


GAP = """CASE WHEN a.{0}_hi < b.{0}_lo THEN b.{0}_lo - a.{0}_hi WHEN b.{0}_hi < a.{0}_lo THEN a.{0}_lo - b.{0}_hi END"""
STRAND = f"""lad AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY i_lo, j_lo) AS id FROM ladder),
  bulge AS (SELECT a.structure_id, a.id AS a, b.id AS b FROM lad a JOIN lad b ON a.structure_id = b.structure_id AND a.kind = b.kind AND a.id <> b.id
    WHERE ({GAP.format('i')} < 6 AND {GAP.format('j')} < 3) OR ({GAP.format('i')} < 3 AND {GAP.format('j')} < 6)),
  reach AS (SELECT structure_id, id, id AS other FROM lad UNION SELECT r.structure_id, r.id, g.b FROM reach r JOIN bulge g ON g.structure_id = r.structure_id AND g.a = r.other),
  comp AS (SELECT structure_id, id, min(other) AS comp FROM reach GROUP BY 1, 2),
  sheet AS (SELECT structure_id, comp, min(i_lo) AS i_lo, max(i_hi) AS i_hi, min(j_lo) AS j_lo, max(j_hi) AS j_hi FROM lad JOIN comp USING (structure_id, id)
    GROUP BY 1, 2 HAVING count(*) > 1 OR max(size) > 1),
  claim AS (SELECT structure_id, i, CASE letter WHEN 'I' THEN 1 WHEN 'H' THEN 2 ELSE 5 END AS p FROM helix
    UNION ALL SELECT structure_id, unnest(range(i_lo, i_hi + 1)), 4 FROM sheet UNION ALL SELECT structure_id, unnest(range(j_lo, j_hi + 1)), 4 FROM sheet
    UNION ALL SELECT structure_id, i, 40 FROM bridge UNION ALL SELECT structure_id, j, 40 FROM bridge
    UNION ALL SELECT structure_id, unnest(range(i + 1, i + n)), 6 FROM turn WHERE seg_i = seg_j
    UNION ALL SELECT structure_id, i, 7 FROM bend),
  best AS (SELECT structure_id, i, min(CASE WHEN p = 40 THEN 4 ELSE p END) AS p, bool_or(p = 4) AS strand FROM claim GROUP BY 1, 2),
  ss AS (SELECT {RESKEY}, res_name, r.i, CASE WHEN p = 4 THEN CASE WHEN strand THEN 'E' ELSE 'B' END WHEN p IS NULL THEN '-' ELSE substring('IHBEGTS', CAST(p AS INT), 1) END AS ss
    FROM bb r LEFT JOIN best b USING (structure_id, i))"""
SHEET_PARTS = (*SS_PARTS, BRIDGE, LADDER, STRAND)


@query("m9_secondary_structure", recursive("SELECT * FROM ss", *SHEET_PARTS))
def secondary_structure(spark, sf_dir):
    return SS.assign_residues(fx_fold(spark, sf_dir))


@query(
    "f20_helix_atoms",
    recursive(f"""SELECT f.structure_id, f.atom_id FROM fx_fold f JOIN ss USING ({RESKEY}) WHERE ss IN ('H','G','I')""", *SHEET_PARTS),
)
def helix_atoms(spark, sf_dir):
    atoms = SS.secondary_structure(fx_fold(spark, sf_dir))
    return ids(atoms.filter(P.ss("helix")))


@query(
    "w7_strand_gap",
    sql(f"""SELECT a.structure_id, a.i_lo AS a, b.i_lo AS b, a.j_lo AS aj, b.j_lo AS bj, {GAP.format('i')} AS gap_i, {GAP.format('j')} AS gap_j
      FROM ladder a JOIN ladder b ON a.structure_id = b.structure_id AND a.kind = b.kind AND b.i_lo BETWEEN a.i_hi + 1 AND a.i_hi + 5""",
        SQL_FOLD, BACKBONE, HB, BRIDGE, LADDER),
)
def strand_gaps(spark, sf_dir):
    residues = cut_lineage(fold(spark, sf_dir))
    steps = cut_lineage(SS.ladders(SS.bridges(SS.backbone_bonds(residues), residues)))
    first = steps.select("structure_id", "kind", *[F.col(c).alias(f"a_{c}") for c in ("i_lo", "i_hi", "j_lo", "j_hi")])
    first = first.withColumn("i_lo", F.expr("explode(sequence(a_i_hi + 1, a_i_hi + 5))"))
    both = first.join(steps.hint("merge"), ["structure_id", "kind", "i_lo"])

    def gap(c: str):
        return SS.strand_gap(*[F.col(n) for n in (f"a_{c}_lo", f"a_{c}_hi", f"{c}_lo", f"{c}_hi")]).alias(f"gap_{c}")

    return both.select(
        "structure_id", F.col("a_i_lo").alias("a"), F.col("i_lo").alias("b"), F.col("a_j_lo").alias("aj"),
        F.col("j_lo").alias("bj"), gap("i"), gap("j"),
    )


@query(
    "g6_ladder_groups",
    recursive("SELECT structure_id, lo, hi FROM (SELECT structure_id, i_lo AS lo, i_hi AS hi FROM sheet UNION ALL SELECT structure_id, j_lo, j_hi FROM sheet)", *SHEET_PARTS),
)
def ladder_groups(spark, sf_dir):
    residues = cut_lineage(fold(spark, sf_dir))
    steps = cut_lineage(SS.ladders(SS.bridges(SS.backbone_bonds(residues), residues)))
    return SS.strands(steps)
