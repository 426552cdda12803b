"""Predicates (F), preparation (P), keyed and distance joins (J), sets (H), listings (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomframe.operators import predicates as P
from atomframe.operators import prep, sets, spatial

from .core import query
from .fixtures import (
    AMINO, RESKEY, SQL_COPIES, SQL_MIXED, fx_atoms, fx_copies, fx_mixed, fx_ops, sql, table,
)


def ids(df: DataFrame) -> DataFrame:
    return df.select("structure_id", "atom_id")


def predicate(name: str, build, where: str, mixed: bool = False) -> None:
    """A filter over the atoms (or the wider vocabulary) against the same WHERE clause."""
    source, parts, make = ("fx_mixed", [SQL_MIXED], fx_mixed) if mixed else ("fx_atoms", [], fx_atoms)

    @query(name, sql(f"SELECT structure_id, atom_id FROM {source} WHERE {where}", *parts))
    def run(spark, sf_dir):
        atoms = make(spark, sf_dir)
        return ids(atoms.filter(build(atoms)))


@query(
    "j1_interface_residues",
    sql("""SELECT DISTINCT a.structure_id, a.res_id, a.res_name FROM fx_atoms a
    WHERE a.chain_id = 'A' AND EXISTS (SELECT 1 FROM fx_atoms b WHERE b.structure_id = a.structure_id
      AND b.chain_id = 'B'
      AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= CAST(16 AS DOUBLE))"""),
)
def interface_residues(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    a, b = (atoms.filter(P.chain(c)) for c in ("A", "B"))
    return spatial.within(a, b, 4.0).select("structure_id", "res_id", "res_name").distinct()


# ---------------------------------------------------------------- predicates
NUCLEIC = "('A','C','G','U','I','N','DA','DC','DG','DT','DU','DI')"
HET = "(hetero AND res_name NOT IN ('HOH','SOL','WAT','DOD'))"
BB = f"""((res_name IN {AMINO} AND atom_name IN ('N','CA','C','O','OXT'))
  OR (res_name IN {NUCLEIC} AND (atom_name IN ('P','OP1','OP2','OP3','O1P','O2P','O3P') OR regexp_matches(atom_name, '^([OC]5|[OC]4|[OC]3|[OC]2|C1)[''*]$'))))"""
CARBON = f"""(structure_id, chain_id, res_id, ins_code) IN
  (SELECT ({RESKEY}) FROM fx_atoms WHERE {HET} AND element = 'C')"""

predicate("f1_all", lambda a: P.is_class("*"), "true")
predicate("f1_none", lambda a: P.is_class("none"), "false")
predicate("f2_polymer", lambda a: P.is_class("polymer"), f"res_name IN {AMINO} OR res_name IN {NUCLEIC}", True)
predicate("f2_protein", lambda a: P.is_class("polymer.protein"), f"res_name IN {AMINO}")
predicate("f2_nucleic", lambda a: P.is_class("nucleic"), f"res_name IN {NUCLEIC}", True)
predicate("f3_solvent", lambda a: P.is_class("water"), "res_name = 'HOH'")
predicate("f4_hetatm", lambda a: P.is_class("het"), "hetero")
predicate("f5_backbone", lambda a: P.is_class("backbone"), BB, True)
predicate("f6_sidechain", lambda a: P.is_class("sc."), f"(res_name IN {AMINO} OR res_name IN {NUCLEIC}) AND NOT {BB}", True)
predicate("f7_hydro", lambda a: P.is_class("hydro"), "element IN ('H','D')", True)
predicate("f8_metals", lambda a: P.is_class("metals"), "upper(element) IN ('FE','ZN')", True)
predicate("f9_glycan", lambda a: P.is_class("glycan"), "res_name IN ('NAG','MAN','BMA','GAL','FUC')", True)
predicate("f9_ion", lambda a: P.is_class("ion"), "res_name IN ('ZN','CL')", True)
predicate("f12_chain", lambda a: P.chain("A", "C"), "chain_id IN ('A','C')")
predicate("f12_segi", lambda a: P.segi("b"), "chain_id = 'b'")
predicate("f13_resn", lambda a: P.resn("hem", "Asp"), "res_name IN ('HEM','ASP')")
predicate("f13_name", lambda a: P.name("ca", "fe"), "atom_name IN ('CA','FE')")
predicate("f14_elem", lambda a: P.elem("fe", "S", "Zn", atoms=a), "element IN ('FE','S','ZN')")
predicate("f15_resi", lambda a: P.resi("5", "10-20", "52A", "-3-1"),
          "res_id = 5 OR res_id BETWEEN 10 AND 20 OR (res_id = 52 AND ins_code = 'A') OR res_id BETWEEN -3 AND 1")
predicate("f16_index", lambda a: P.index("65-2000", 4000),
          "atom_id BETWEEN 65 AND 2000 OR atom_id = 4000")
predicate("f19_alt", lambda a: P.alt("A", "''", atoms=a), "altloc_id IN ('A','.')")
predicate("f21_compare", lambda a: P.compare(a, "b", ">=", 30) & P.compare(a, "q", "<", 0.5),
          "b_factor >= 30 AND occupancy < CAST(0.5 AS DOUBLE)")
predicate("f22_boolean", lambda a: (P.chain("A") | P.resn("HEM")) & ~P.is_class("backbone"),
          f"(chain_id = 'A' OR res_name = 'HEM') AND NOT {BB}")


@query("f10_organic", sql(f"SELECT structure_id, atom_id FROM fx_atoms WHERE {HET} AND {CARBON}"))
def organic(spark, sf_dir):
    return ids(P.classify(fx_atoms(spark, sf_dir)).filter(P.is_class("ligand")))


@query("f11_inorganic", sql(f"SELECT structure_id, atom_id FROM fx_atoms WHERE {HET} AND NOT {CARBON}"))
def inorganic(spark, sf_dir):
    return ids(P.classify(fx_atoms(spark, sf_dir)).filter(P.is_class("inorganic")))


@query(
    "f17_rank",
    sql("""SELECT structure_id, atom_id FROM (SELECT structure_id, atom_id,
      row_number() OVER (PARTITION BY structure_id ORDER BY atom_id) - 1 AS rank FROM fx_atoms)
      WHERE rank BETWEEN 0 AND 9 OR rank = 100"""),
)
def by_rank(spark, sf_dir):
    atoms = prep.running_index(fx_atoms(spark, sf_dir), ["structure_id"], "atom_id", "rank")
    return ids(atoms.filter(P.rank("0-9", 100)))


@query("f18_sym", sql("SELECT structure_id, sym_id, atom_id FROM fx_copies WHERE sym_id = 1", SQL_COPIES))
def by_copy(spark, sf_dir):
    atoms = fx_copies(spark, sf_dir)
    return atoms.filter(P.sym(atoms, 1)).select("structure_id", "sym_id", "atom_id")


@query(
    "f23_first",
    sql("""SELECT structure_id, min(atom_id) AS atom_id FROM fx_atoms WHERE chain_id = 'B' GROUP BY 1"""),
)
def first_atom(spark, sf_dir):
    return ids(P.first(fx_atoms(spark, sf_dir).filter(P.chain("B"))))


@query(
    "f24_residue_list",
    sql("""SELECT structure_id, atom_id FROM fx_atoms WHERE EXISTS (SELECT 1 FROM nation
      WHERE res_id = n_nationkey AND chain_id = 'A' AND ins_code = '')"""),
)
def residue_list(spark, sf_dir):
    listed = table(spark, sf_dir, "nation").select(
        F.lit("A").alias("chain_id"), F.col("n_nationkey").cast("int").alias("res_id"),
        F.lit("").alias("ins_code"),
    )
    return ids(P.in_residues(fx_atoms(spark, sf_dir), listed))


@query(
    "f25_hetero_names",
    sql(f"SELECT DISTINCT structure_id, res_name FROM fx_atoms WHERE {HET}"),
)
def hetero_names(spark, sf_dir):
    return P.hetero_names(fx_atoms(spark, sf_dir))


@query(
    "f26_mutations",
    sql("""SELECT s.structure_id, m.mutation, CAST(m.res_id AS INT) AS res_id, coalesce(f.found, '') AS found,
      CASE WHEN f.found IS NULL THEN 'missing' WHEN f.found = m.original THEN 'verified' ELSE 'mismatch' END AS status
      FROM (SELECT DISTINCT structure_id FROM fx_atoms WHERE chain_id = 'A') s
      CROSS JOIN (VALUES ('D10A',10,'ASP'),('K13R',13,'LYS'),('G14A',14,'GLY'),('A400G',400,'ALA')) m(mutation,res_id,original)
      LEFT JOIN (SELECT structure_id, res_id, string_agg(DISTINCT res_name, '/' ORDER BY res_name) AS found
        FROM fx_atoms WHERE chain_id = 'A' GROUP BY 1, 2) f
      ON f.structure_id = s.structure_id AND f.res_id = m.res_id"""),
)
def mutations(spark, sf_dir):
    return P.check_mutations(fx_atoms(spark, sf_dir), "D10A,K13R,G14A,A400G", "A")


# ---------------------------------------------------------------- preparation
STATE = """fx_state AS (SELECT * FROM fx_atoms WHERE altloc_id = '.' UNION ALL
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, chain_id, res_id,
    ins_code, atom_name ORDER BY occupancy DESC, altloc_id, atom_id) AS rn
    FROM fx_atoms WHERE altloc_id <> '.') WHERE rn = 1)"""


@query(
    "p3_altloc_spelling",
    sql("SELECT atom_id, CASE WHEN altloc_id IN ('A','B') THEN altloc_id ELSE '.' END AS altloc_id FROM fx_atoms"),
)
def altloc_spelling(spark, sf_dir):
    spelled = fx_atoms(spark, sf_dir).withColumn(
        "altloc_id",
        F.expr("IF(altloc_id = '.', element_at(array('', ' ', '.', '?'), CAST(atom_id % 4 AS INT) + 1), altloc_id)"),
    )
    return prep.normalise_altloc(spelled).select("atom_id", "altloc_id")


@query(
    "p4_altloc_surplus",
    sql("""SELECT structure_id, CAST(sum(CASE WHEN altloc_id <> '.' THEN 1 ELSE 0 END)
      - count(DISTINCT CASE WHEN altloc_id <> '.' THEN concat_ws('|', chain_id, res_id, res_name, atom_name) END) AS BIGINT) AS surplus
      FROM fx_atoms GROUP BY 1"""),
)
def surplus(spark, sf_dir):
    return prep.altloc_surplus(fx_atoms(spark, sf_dir))


@query(
    "p5_labelled_atoms",
    sql("""SELECT structure_id, CAST(sum(CASE WHEN altloc_id <> '.' THEN 1 ELSE 0 END) AS BIGINT) AS labelled,
      bool_or(altloc_id <> '.') AS has_altlocs FROM fx_atoms GROUP BY 1"""),
)
def labelled(spark, sf_dir):
    return prep.labelled_atoms(fx_atoms(spark, sf_dir))


@query("p6_conformer_state", sql("SELECT structure_id, atom_id, altloc_id FROM fx_state", STATE))
def conformer_state(spark, sf_dir):
    return prep.resolve_conformers(fx_atoms(spark, sf_dir)).select("structure_id", "atom_id", "altloc_id")


@query("p7_conformer_letter", sql("SELECT structure_id, atom_id FROM fx_atoms WHERE altloc_id IN ('.','B')"))
def conformer_letter(spark, sf_dir):
    return ids(prep.resolve_conformers(fx_atoms(spark, sf_dir), "B"))


@query(
    "p8_conformers_used",
    sql("""SELECT structure_id, coalesce(string_agg(DISTINCT altloc_id, '+' ORDER BY altloc_id)
      FILTER (WHERE altloc_id <> '.'), '') AS conformers FROM fx_state GROUP BY 1""", STATE),
)
def conformers_used(spark, sf_dir):
    return prep.conformers_used(prep.resolve_conformers(fx_atoms(spark, sf_dir)))


@query(
    "p9_dominant_altloc",
    sql("""SELECT structure_id, coalesce(max(altloc_id) FILTER (WHERE rn = 1), '.') AS dominant FROM (
      SELECT structure_id, altloc_id, row_number() OVER (PARTITION BY structure_id ORDER BY round(w, 6) DESC, altloc_id) AS rn
      FROM (SELECT structure_id, altloc_id, sum(occupancy) AS w FROM fx_atoms WHERE altloc_id <> '.' GROUP BY 1, 2)) GROUP BY 1"""),
)
def dominant(spark, sf_dir):
    return prep.dominant_altloc(fx_atoms(spark, sf_dir))


@query(
    "p10_residue_labels",
    sql("SELECT DISTINCT structure_id, concat_ws('|', chain_id, res_id, ins_code) AS residue FROM fx_atoms"),
)
def residue_labels(spark, sf_dir):
    return prep.residue_labels(fx_atoms(spark, sf_dir)).select("structure_id", "residue").distinct()


@query(
    "p11_renumber",
    sql("""SELECT structure_id, atom_id AS old_id,
      row_number() OVER (PARTITION BY structure_id ORDER BY atom_id) AS atom_id FROM fx_atoms"""),
)
def renumber(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir).withColumn("old_id", F.col("atom_id"))
    return prep.renumber(atoms, "old_id").select("structure_id", "old_id", "atom_id")


@query(
    "p1_assembly",
    sql("""SELECT a.structure_id, a.atom_id, CAST(o.op_id - 1 AS INT) AS sym_id,
        CASE WHEN o.op_id % 2 = 1 THEN a.x ELSE -a.y END + CAST((o.op_id - 1) * 5 AS DOUBLE) AS x,
        CASE WHEN o.op_id % 2 = 1 THEN a.y ELSE a.x END AS y, a.z, 'assembly' AS note
      FROM fx_atoms a JOIN ops o ON a.structure_id = o.structure_id""",
        """ops AS (SELECT structure_id, n, unnest(range(1, n + 1)) AS op_id FROM (SELECT DISTINCT structure_id,
          CASE WHEN structure_id % 7 = 6 THEN 13 ELSE 1 + structure_id % 3 END AS n FROM fx_atoms))"""),
)
def assembly(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    return prep.expand_assembly(atoms, fx_ops(atoms)).select(
        "structure_id", "atom_id", "sym_id", "x", "y", "z", "note"
    )


@query(
    "p1_assembly_limited",
    sql("""SELECT a.structure_id, a.atom_id, CAST(o.op_id - 1 AS INT) AS sym_id,
        CASE WHEN o.op_id % 2 = 1 THEN a.x ELSE -a.y END + CAST((o.op_id - 1) * 5 AS DOUBLE) AS x,
        CASE WHEN o.op_id % 2 = 1 THEN a.y ELSE a.x END AS y, a.z, 'assembly' AS note
      FROM fx_atoms a JOIN ops o ON a.structure_id = o.structure_id WHERE o.n <= 12
      UNION ALL SELECT a.structure_id, a.atom_id, 0, a.x, a.y, a.z, '13 operators; deposited atoms kept'
      FROM fx_atoms a WHERE structure_id % 7 = 6""",
        """ops AS (SELECT structure_id, n, unnest(range(1, n + 1)) AS op_id FROM (SELECT DISTINCT structure_id,
          CASE WHEN structure_id % 7 = 6 THEN 13 ELSE 1 + structure_id % 3 END AS n FROM fx_atoms))"""),
)
def assembly_limited(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    return prep.expand_assembly(atoms, fx_ops(atoms), max_copies=12).select(
        "structure_id", "atom_id", "sym_id", "x", "y", "z", "note"
    )


@query(
    "p2_multiplicity",
    sql("""SELECT DISTINCT structure_id, CAST(CASE WHEN structure_id % 7 = 6 THEN 13 ELSE 1 + structure_id % 3 END AS BIGINT) AS copies
      FROM fx_atoms"""),
)
def multiplicity(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    return prep.assembly_multiplicity(atoms, fx_ops(atoms))


PAIRS = "m.structure_id = t.structure_id + 1 AND t.structure_id % 2 = 0"


def pair_sides(spark, sf_dir):
    """Structures 2k (target) and 2k+1 (mobile) as pair k."""
    atoms = fx_atoms(spark, sf_dir).withColumn("pair_id", F.expr("structure_id div 2"))
    return atoms.filter("structure_id % 2 = 1"), atoms.filter("structure_id % 2 = 0")


@query(
    "p12_combine",
    sql("""SELECT pair_id, side, chain_id, count(*) AS atoms, min(atom_id) AS first_id, max(atom_id) AS last_id FROM (
      SELECT pair_id, side, CASE WHEN side = 1 AND EXISTS (SELECT 1 FROM fx_atoms q
          WHERE q.structure_id = pair_id*2 AND q.chain_id = u.chain_id)
        THEN concat(chain_id, '_2') ELSE chain_id END AS chain_id,
        row_number() OVER (PARTITION BY pair_id ORDER BY side, atom_id) AS atom_id
      FROM (SELECT structure_id // 2 AS pair_id, structure_id % 2 AS side, chain_id, atom_id FROM fx_atoms) u) GROUP BY 1, 2, 3"""),
)
def combine(spark, sf_dir):
    mobile, target = pair_sides(spark, sf_dir)
    joint, _ = prep.combine(target, mobile, ["pair_id"])
    return joint.groupBy("pair_id", F.col("side").cast("long").alias("side"), "chain_id").agg(
        F.count("*").alias("atoms"), F.min("atom_id").alias("first_id"), F.max("atom_id").alias("last_id")
    )


@query(
    "p13_affine",
    sql("""SELECT structure_id, atom_id, -y + CAST(structure_id AS DOUBLE) AS x, x AS y, z + CAST(1 AS DOUBLE) AS z FROM fx_atoms"""),
)
def affine(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    values = {"r12": "-1", "r21": "1", "r33": "1", "tx": "structure_id", "tz": "1"}
    moves = atoms.select("structure_id").distinct().select(
        "structure_id",
        *[F.expr(f"CAST({values.get(c, 0)} AS DOUBLE)").alias(c) for c in prep.ROTATION + prep.TRANSLATION],
    )
    return prep.apply_transform(atoms, moves).select("structure_id", "atom_id", "x", "y", "z")


@query(
    "p15_reconcile",
    sql("""SELECT coalesce(a.structure_id, b.structure_id) AS structure_id, count_a, count_b,
      CASE WHEN count_a IS NULL OR count_b IS NULL THEN 'no count' WHEN count_a = count_b THEN 'agree' ELSE 'MISMATCH' END AS status
      FROM (SELECT structure_id, count(*) AS count_a FROM fx_atoms GROUP BY 1) a
      FULL JOIN (SELECT structure_id, count(*) AS count_b FROM fx_atoms WHERE altloc_id <> 'B' GROUP BY 1) b
      ON a.structure_id = b.structure_id"""),
)
def reconcile(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    other = atoms.filter("altloc_id <> 'B'")
    return prep.reconcile(atoms, other)


@query(
    "p15_choose_reading",
    sql("""SELECT o.structure_id, o.atoms, CASE WHEN o.atoms = 2*n.n THEN 'biological' WHEN o.atoms = n.n THEN 'asymmetric' END AS reading
      FROM (SELECT structure_id, count(*) * (1 + structure_id % 3) AS atoms FROM fx_atoms GROUP BY structure_id) o
      JOIN (SELECT structure_id, count(*) AS n FROM fx_atoms GROUP BY 1) n ON n.structure_id = o.structure_id"""),
)
def choose_reading(spark, sf_dir):
    counts = fx_atoms(spark, sf_dir).groupBy("structure_id").agg(F.count("*").alias("n"))
    readings = counts.select(
        "structure_id",
        F.expr("""explode(array(named_struct('reading', 'biological', 'preference', 0, 'atoms', 2*n),
                                named_struct('reading', 'asymmetric', 'preference', 1, 'atoms', n))) AS r"""),
    ).select("structure_id", "r.*")
    other = counts.select("structure_id", F.expr("n * (1 + structure_id % 3)").alias("atoms"))
    return prep.choose_reading(readings, other)


@query(
    "p16_default_chain",
    sql(f"SELECT structure_id, arg_min(chain_id, atom_id) AS chain_id FROM fx_atoms WHERE res_name IN {AMINO} GROUP BY 1"),
)
def default_chain(spark, sf_dir):
    return prep.default_chain(fx_atoms(spark, sf_dir))


# ---------------------------------------------------------------- joins
def close(a: str, b: str, r: float) -> str:
    d2 = "+".join(f"({a}.{c}-{b}.{c})*({a}.{c}-{b}.{c})" for c in "xyz")
    return f"{a}.structure_id = {b}.structure_id AND {d2} <= CAST({r * r} AS DOUBLE)"


def dist(a: str, b: str) -> str:
    return "sqrt(" + "+".join(f"({a}.{c}-{b}.{c})*({a}.{c}-{b}.{c})" for c in "xyz") + ")"


HEM = "t.res_name = 'HEM'"
NEAR5 = f"near5 AS (SELECT * FROM fx_atoms a WHERE EXISTS (SELECT 1 FROM fx_atoms t WHERE {HEM} AND {close('a', 't', 5.0)}))"


@query("j1_within", sql("SELECT structure_id, atom_id FROM near5", NEAR5))
def within(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    return ids(spatial.within(atoms, atoms.filter(P.resn("HEM")), 5.0))


@query("j2_around", sql("SELECT structure_id, atom_id FROM near5 WHERE res_name <> 'HEM'", NEAR5))
def around(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    return ids(spatial.around(atoms, atoms.filter(P.resn("HEM")), 5.0))


@query("j3_expand", sql("SELECT structure_id, atom_id FROM near5", NEAR5))
def expand(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    return ids(spatial.expand(atoms, atoms.filter(P.resn("HEM")), 5.0))


@query(
    "j4_near",
    sql(f"""SELECT structure_id, atom_id FROM fx_atoms WHERE ({RESKEY}) IN
      (SELECT ({RESKEY}) FROM near5) AND res_name <> 'HEM'""", NEAR5),
)
def near(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    return ids(spatial.near(atoms, atoms.filter(P.resn("HEM"))))


@query(
    "j5_pair_distance",
    sql(f"""SELECT a.structure_id, a.atom_id AS a_atom_id, b.atom_id AS b_atom_id, round({dist('a', 'b')}, 9) AS d
      FROM fx_atoms a JOIN fx_atoms b ON a.chain_id = 'A' AND b.chain_id = 'B' AND {close('a', 'b', 4.0)}"""),
)
def pair_distance(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    a, b = (atoms.filter(P.chain(c)) for c in ("A", "B"))
    return spatial.pairs_within(a, b, 4.0).withColumn("d", F.round("d", 9))


@query(
    "j6_byres",
    sql(f"SELECT structure_id, atom_id FROM fx_atoms WHERE ({RESKEY}) IN (SELECT ({RESKEY}) FROM fx_atoms WHERE b_factor > 48)"),
)
def byres(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    return ids(spatial.byres(atoms, atoms.filter(P.compare(atoms, "b", ">", 48))))


@query(
    "j7_bychain",
    sql("""SELECT structure_id, sym_id, atom_id FROM fx_copies WHERE (structure_id, chain_id) IN
      (SELECT (structure_id, chain_id) FROM fx_copies WHERE res_id BETWEEN 70 AND 80 AND sym_id = 1)""", SQL_COPIES),
)
def bychain(spark, sf_dir):
    atoms = fx_copies(spark, sf_dir)
    return spatial.bychain(atoms, atoms.filter(P.resi("70-80") & P.sym(atoms, 1))).select(
        "structure_id", "sym_id", "atom_id"
    )


@query(
    "j8_attach_field",
    sql(f"""SELECT c.structure_id, c.sym_id, c.atom_id, coalesce(f.value, CAST(100 AS DOUBLE)) AS value FROM fx_copies c
      LEFT JOIN (SELECT {RESKEY}, max(b_factor) AS value FROM fx_atoms WHERE res_name <> 'HOH' GROUP BY ALL) f
      ON c.structure_id = f.structure_id AND c.chain_id = f.chain_id AND c.res_id = f.res_id AND c.ins_code = f.ins_code""", SQL_COPIES),
)
def attach_field(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir).filter("res_name <> 'HOH'")
    field = atoms.groupBy("structure_id", "chain_id", "res_id", "ins_code").agg(F.max("b_factor").alias("value"))
    return spatial.attach_field(fx_copies(spark, sf_dir), field, default=100.0).select(
        "structure_id", "sym_id", "atom_id", "value"
    )


SG = "(SELECT * FROM fx_state WHERE res_name = 'CYS' AND atom_name = 'SG')"


@query(
    "j9_disulfides",
    sql(f"""SELECT a.structure_id, a.atom_id AS a, b.atom_id AS b, round({dist('a', 'b')}, 6) AS d
      FROM {SG} a JOIN {SG} b ON a.atom_id < b.atom_id AND {close('a', 'b', 4.5)}""", STATE),
)
def disulfides(spark, sf_dir):
    found = spatial.disulfides(fx_atoms(spark, sf_dir), 4.5)
    return found.select(
        "structure_id", F.col("a_atom_id").alias("a"), F.col("b_atom_id").alias("b"), F.round("d", 6).alias("d")
    )


SHELL = f"""shell AS (SELECT DISTINCT {RESKEY.replace('structure_id', 'a.structure_id')} FROM fx_state a
  WHERE element <> 'FE' AND EXISTS (SELECT 1 FROM fx_state t WHERE t.element = 'FE' AND {close('a', 't', 5.0)}))"""


@query(
    "j10_metal_sites",
    sql(f"""SELECT structure_id, atom_id, element = 'FE' AS is_metal FROM fx_state
      WHERE element = 'FE' OR ({RESKEY}) IN (SELECT ({RESKEY}) FROM shell)""", STATE, SHELL),
)
def metal_sites(spark, sf_dir):
    return spatial.metal_sites(fx_atoms(spark, sf_dir)).select("structure_id", "atom_id", "is_metal")


@query(
    "m17_crosslinks",
    sql(f"""SELECT structure_id, CAST(sum(s) AS BIGINT) AS disulfides, CAST(sum(m) AS BIGINT) AS metal_atoms,
        CAST(sum(r) AS BIGINT) AS coordinating_residues FROM (
      SELECT a.structure_id, 1 AS s, 0 AS m, 0 AS r FROM {SG} a JOIN {SG} b ON a.atom_id < b.atom_id AND {close('a', 'b', 2.5)}
      UNION ALL SELECT structure_id, 0, 1, 0 FROM fx_state WHERE element = 'FE'
      UNION ALL SELECT structure_id, 0, 0, 1 FROM shell) GROUP BY 1""", STATE, SHELL),
)
def crosslinks(spark, sf_dir):
    return spatial.crosslinks(fx_atoms(spark, sf_dir))


@query(
    "j11_ligand_site",
    sql(f"""SELECT l.structure_id, copies, atoms, coalesce(w.n, 0) AS lining_residues FROM
      (SELECT structure_id, count(DISTINCT (chain_id, res_id, ins_code)) AS copies, count(*) AS atoms
        FROM fx_atoms WHERE res_name = 'HEM' GROUP BY 1) l
      LEFT JOIN (SELECT structure_id, count(DISTINCT (chain_id, res_id, ins_code)) AS n FROM near5
        WHERE res_name IN {AMINO} GROUP BY 1) w ON w.structure_id = l.structure_id""", NEAR5),
)
def ligand_site(spark, sf_dir):
    return spatial.ligand_report(fx_atoms(spark, sf_dir), "HEM")


@query(
    "j12_correspondence",
    sql(f"""SELECT t.structure_id // 2 AS pair_id, t.chain_id, t.res_id, count(*) AS matches,
      round(sum({dist('m', 't')}), 6) AS moved
      FROM fx_atoms t JOIN fx_atoms m ON {PAIRS} AND m.chain_id = t.chain_id AND m.res_id = t.res_id
       AND m.res_name = t.res_name AND m.atom_name = 'CA' AND t.atom_name = 'CA' GROUP BY ALL"""),
)
def correspondence(spark, sf_dir):
    mobile, target = pair_sides(spark, sf_dir)
    both = spatial.correspond(mobile, target, ["pair_id"])
    return both.groupBy("pair_id", "chain_id", "res_id").agg(
        F.count("*").alias("matches"),
        F.round(F.sum(F.sqrt(spatial.squared_distance("m", "t"))), 6).alias("moved"),
    )


@query(
    "j14_same_in_every_copy",
    sql("""SELECT structure_id, CAST(2 AS BIGINT) AS copies, bool_and(n = 2) AS same FROM (
      SELECT structure_id, atom_id, count(*) AS n FROM fx_copies
      WHERE res_name = 'HEM' AND NOT (sym_id = 1 AND b_factor = 50 AND occupancy > 0.85) GROUP BY 1, 2) GROUP BY 1""", SQL_COPIES),
)
def same_in_every_copy(spark, sf_dir):
    atoms = fx_copies(spark, sf_dir)
    x = atoms.filter(P.resn("HEM") & ~F.expr("sym_id = 1 AND b_factor = 50 AND occupancy > 0.85"))
    return spatial.same_in_every_copy(atoms, x)


# ---------------------------------------------------------------- named sets
def handle_table(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    h = sets.register(None, atoms.filter(P.chain("A")), "a", "chain A")
    h = sets.register(h, atoms.filter(P.resn("ASP")), "asp", "resn ASP")
    return atoms, sets.register(h, atoms.filter(P.name("CA")), "ca", "name CA")


def set_query(op: str, members: list[str], where: str) -> None:
    @query(f"h1_{op}", sql(f"SELECT structure_id, atom_id FROM fx_atoms WHERE {where}"))
    def run(spark, sf_dir):
        _, handles = handle_table(spark, sf_dir)
        return ids(sets.get(sets.combine_sets(handles, op, members, "out"), "out"))


set_query("union", ["a", "asp", "ca"], "chain_id = 'A' OR res_name = 'ASP' OR atom_name = 'CA'")
set_query("intersect", ["a", "asp", "ca"], "chain_id = 'A' AND res_name = 'ASP' AND atom_name = 'CA'")
set_query("subtract", ["a", "asp", "ca"], "chain_id = 'A' AND res_name <> 'ASP' AND atom_name <> 'CA'")


@query("h2_invert", sql("SELECT structure_id, atom_id FROM fx_atoms WHERE res_name <> 'ASP'"))
def invert(spark, sf_dir):
    atoms, handles = handle_table(spark, sf_dir)
    return ids(sets.get(sets.invert(atoms, handles, "asp", "rest"), "rest"))


@query(
    "h3_register",
    sql("""SELECT structure_id, 'a' AS name, count(*) AS atoms FROM fx_atoms WHERE chain_id = 'B' GROUP BY 1
      UNION ALL SELECT structure_id, 'ca', count(*) FROM fx_atoms WHERE atom_name = 'CA' GROUP BY 1"""),
)
def registry_upsert(spark, sf_dir):
    atoms, handles = handle_table(spark, sf_dir)
    handles = sets.register(handles, atoms.filter(P.chain("B")), "a", "chain B")
    return sets.drop(handles, "asp").groupBy("structure_id", "name").agg(F.count("*").alias("atoms"))


@query(
    "h4_summarise",
    sql("""SELECT structure_id, count(*) AS atoms, count(DISTINCT (chain_id, res_id, ins_code)) AS residues,
      string_agg(DISTINCT chain_id, ',' ORDER BY chain_id) AS chains FROM fx_atoms WHERE atom_name = 'CA' GROUP BY 1"""),
)
def summarise(spark, sf_dir):
    return sets.summarise(fx_atoms(spark, sf_dir).filter(P.name("CA")))


@query(
    "t5_residue_listing",
    sql(f"""SELECT {RESKEY}, res_name, CAST(place AS INT) AS place, residues, residues > 50 AS truncated FROM (
      SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY first_seen) AS place,
        count(*) OVER (PARTITION BY structure_id) AS residues
      FROM (SELECT {RESKEY}, min(res_name) AS res_name, min(atom_id) AS first_seen FROM fx_atoms GROUP BY ALL)) WHERE place <= 50""".replace("GROUP BY ALL", f"GROUP BY {RESKEY}")),
)
def residue_listing(spark, sf_dir):
    return sets.residue_listing(fx_atoms(spark, sf_dir), 50)


@query(
    "h5_list_sets",
    sql("""SELECT structure_id, name, origin, count(*) AS atoms, count(DISTINCT (chain_id, res_id, ins_code)) AS residues
      FROM (SELECT *, 'a' AS name, 'chain A' AS origin FROM fx_atoms WHERE chain_id = 'A'
        UNION ALL SELECT *, 'asp', 'resn ASP' FROM fx_atoms WHERE res_name = 'ASP'
        UNION ALL SELECT *, 'ca', 'name CA' FROM fx_atoms WHERE atom_name = 'CA') GROUP BY 1, 2, 3"""),
)
def list_sets(spark, sf_dir):
    return sets.list_handles(*handle_table(spark, sf_dir))


@query(
    "h6_id_runs",
    sql("""SELECT structure_id, lo, hi FROM runs WHERE hi - lo >= 2
      UNION ALL SELECT structure_id, unnest(range(lo, hi + 1)) AS lo, unnest(range(lo, hi + 1)) AS hi FROM runs WHERE hi - lo < 2""",
      """runs AS (SELECT structure_id, min(atom_id) AS lo, max(atom_id) AS hi FROM (
        SELECT structure_id, atom_id, atom_id - row_number() OVER (PARTITION BY structure_id ORDER BY atom_id) AS island
        FROM fx_atoms WHERE element <> 'N') GROUP BY structure_id, island)"""),
)
def id_runs(spark, sf_dir):
    return sets.id_runs(fx_atoms(spark, sf_dir).filter("element <> 'N'"))


@query(
    "h7_copy_partition",
    sql("""SELECT structure_id, CAST(2 AS BIGINT) AS copies, count(*) AS atoms, true AS disjoint FROM fx_copies GROUP BY 1""", SQL_COPIES),
)
def copy_partition(spark, sf_dir):
    return sets.check_copy_partition(fx_copies(spark, sf_dir))
