"""Bond queries (G) and the class counts over them (A21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomframe.operators import bonds as B
from atomframe.operators import predicates as P

from .core import query
from .fixtures import SQL_BONDS, fx_atoms, fx_bonds, sql
from .selections import ids

EDGES = """edges AS (SELECT structure_id, a AS src, b AS dst FROM fx_bonds
  UNION ALL SELECT structure_id, b, a FROM fx_bonds)"""


# fixed values: a template of consecutive backbone and side-chain names
TEMPLATE = [("N", "CA"), ("CA", "C"), ("C", "O"), ("CA", "CB"), ("CA", "CB1"), ("CA", "OG"), ("CA", "SG")]


RUNS = """res AS (SELECT structure_id, chain_id, res_id,
          row_number() OVER (PARTITION BY structure_id, chain_id ORDER BY min(atom_id)) AS i
          FROM fx_atoms GROUP BY 1, 2, 3)"""


def bonds_sql(names: str) -> str:
    """Bonds of the template in the residues ``names`` tells, and those between residues in a row."""
    return f"""SELECT structure_id, a, b FROM (
      SELECT a.structure_id, a.atom_id AS a, b.atom_id AS b, a.altloc_id AS la, b.altloc_id AS lb
      FROM fx_atoms a JOIN fx_atoms b ON a.structure_id = b.structure_id AND a.chain_id = b.chain_id
        AND a.res_id = b.res_id JOIN (VALUES {", ".join(map(str, TEMPLATE))}) t(n1, n2)
        ON a.atom_name = n1 AND b.atom_name = n2 WHERE {names}
      UNION ALL
      SELECT a.structure_id, a.atom_id, b.atom_id, a.altloc_id, b.altloc_id
      FROM (SELECT f.*, i FROM fx_atoms f JOIN res USING (structure_id, chain_id, res_id) WHERE atom_name = 'C') a
      JOIN (SELECT f.*, i FROM fx_atoms f JOIN res USING (structure_id, chain_id, res_id) WHERE atom_name = 'N') b
        ON a.structure_id = b.structure_id AND a.chain_id = b.chain_id AND b.i = a.i + 1 AND b.res_id - a.res_id <= 1)
      WHERE NOT (la <> '.' AND lb <> '.' AND la <> lb)"""


@query("g1_derive_bonds", sql(bonds_sql("a.res_name IN ('ALA','SER','CYS','ASP')"), RUNS))
def derive_bonds(spark, sf_dir):
    pairs = [(r, a, b) for r in ("ALA", "SER", "CYS", "ASP") for a, b in TEMPLATE]
    template = spark.createDataFrame(pairs, "res_name string, atom1 string, atom2 string")
    return B.derive_bonds(fx_atoms(spark, sf_dir), template)


@query("g1_derive_bonds_all", sql(bonds_sql("true"), RUNS))
def derive_bonds_all(spark, sf_dir):
    """The template for every residue name."""
    atoms = fx_atoms(spark, sf_dir)
    pairs = spark.createDataFrame(TEMPLATE, "atom1 string, atom2 string")
    return B.derive_bonds(atoms, atoms.select("res_name").distinct().crossJoin(pairs))


@query("g2_cross_conformer", sql("SELECT structure_id, a, b FROM fx_bonds", SQL_BONDS))
def cross_conformer(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    nxt = atoms.select("structure_id", "res_id", F.col("atom_id").alias("b"), (F.col("atom_id") - 1).alias("a"))
    raw = atoms.select("structure_id", "res_id", F.col("atom_id").alias("a")).join(
        nxt, ["structure_id", "res_id", "a"]
    )
    return B.drop_cross_conformer(raw.select("structure_id", "a", "b"), atoms)


@query(
    "g3_neighbor",
    sql("""SELECT DISTINCT e.structure_id, dst AS atom_id FROM edges e JOIN fx_atoms s ON s.atom_id = src AND s.atom_name = 'CA'
      JOIN fx_atoms d ON d.atom_id = dst AND d.atom_name <> 'CA'""", SQL_BONDS, EDGES),
)
def neighbor(spark, sf_dir):
    x = fx_atoms(spark, sf_dir).filter(P.name("CA"))
    return B.neighbor(x, fx_bonds(spark, sf_dir))


def walk(depth: int) -> str:
    return f"""walk AS (SELECT structure_id, atom_id, 0 AS depth FROM fx_atoms WHERE atom_name = 'N'
      UNION SELECT w.structure_id, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.atom_id
      WHERE w.depth < {depth})"""


def recursive(body: str, *ctes: str) -> str:
    return sql(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("g4_extend", recursive("SELECT DISTINCT structure_id, atom_id FROM walk", SQL_BONDS, EDGES, walk(2)))
def extend(spark, sf_dir):
    x = fx_atoms(spark, sf_dir).filter(P.name("N"))
    return B.extend(x, fx_bonds(spark, sf_dir), 2)


@query("g4_extend_far", recursive("SELECT DISTINCT structure_id, atom_id FROM walk", SQL_BONDS, EDGES, walk(8)))
def extend_far(spark, sf_dir):
    x = fx_atoms(spark, sf_dir).filter(P.name("N"))
    return B.extend(x, fx_bonds(spark, sf_dir), 8)


REACH = """reach AS (SELECT structure_id, atom_id, atom_id AS other FROM fx_atoms
  UNION SELECT r.structure_id, r.atom_id, e.dst FROM reach r JOIN edges e ON e.src = r.other)"""


@query(
    "g5_molecules",
    recursive("SELECT structure_id, atom_id, min(other) AS molecule FROM reach GROUP BY 1, 2", SQL_BONDS, EDGES, REACH),
)
def molecules(spark, sf_dir):
    return B.molecules(fx_atoms(spark, sf_dir), fx_bonds(spark, sf_dir))


@query(
    "g5_bymolecule",
    recursive("""SELECT DISTINCT r.structure_id, r.other AS atom_id FROM reach r
      JOIN fx_atoms a ON a.atom_id = r.atom_id AND a.element = 'FE'""", SQL_BONDS, EDGES, REACH),
)
def bymolecule(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    return B.bymolecule(atoms, atoms.filter(P.elem("FE")), fx_bonds(spark, sf_dir))


FEATURES = """features AS (SELECT * FROM (SELECT t.structure_id, t.atom_id, CASE
    WHEN t.element = 'O' THEN CASE WHEN count(o.element) <= 1 THEN 'both' ELSE 'acceptor' END
    WHEN t.element = 'N' THEN CASE WHEN count(o.element) >= 3 THEN 'acceptor' ELSE 'donor' END
    WHEN t.element IN ('C','S') AND NOT (t.element = 'C' AND coalesce(bool_or(o.element IN ('N','O')), false)) THEN 'hydrophobe' END AS feature
  FROM fx_atoms t LEFT JOIN edges e ON e.src = t.atom_id LEFT JOIN fx_atoms o ON o.atom_id = e.dst AND o.element <> 'H'
  GROUP BY t.structure_id, t.atom_id, t.element) WHERE feature IS NOT NULL)"""


@query("g7_pharmacophore", sql("SELECT * FROM features", SQL_BONDS, EDGES, FEATURES))
def pharmacophore(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    return B.pharmacophore(atoms, atoms, fx_bonds(spark, sf_dir))


@query(
    "a21_feature_counts",
    sql("SELECT structure_id, feature, count(*) AS n FROM features GROUP BY 1, 2", SQL_BONDS, EDGES, FEATURES),
)
def feature_counts(spark, sf_dir):
    atoms = fx_atoms(spark, sf_dir)
    return B.feature_counts(B.pharmacophore(atoms, atoms, fx_bonds(spark, sf_dir)))
