"""Structure tables that Spark derives from the driver's tables, and the same as SQL.

Coordinates are derived in integers (thousandths) and cast once, so both
engines see bit-equal doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

E = F.expr
RESIDUE = (
    "CASE ri % 10 WHEN 0 THEN 'ASP' WHEN 1 THEN 'ARG' WHEN 2 THEN 'GLU' WHEN 3 THEN 'LYS' "
    "WHEN 4 THEN 'ALA' WHEN 5 THEN 'SER' WHEN 6 THEN 'CYS' WHEN 7 THEN 'GLY' "
    "WHEN 8 THEN 'HOH' ELSE 'HEM' END"
)
ATOM = (
    "CASE WHEN slot = 1 THEN 'N' WHEN slot = 2 THEN 'CA' WHEN slot = 3 THEN 'C' "
    "WHEN slot = 4 THEN 'O' WHEN slot = 7 THEN 'CB' WHEN slot > 7 THEN concat('C', slot) "
    "ELSE CASE ri % 10 WHEN 0 THEN 'OD1' WHEN 1 THEN 'NH1' WHEN 2 THEN 'OE1' WHEN 3 THEN 'NZ' "
    "WHEN 5 THEN 'OG' WHEN 6 THEN 'SG' WHEN 8 THEN 'O1' WHEN 9 THEN 'FE' ELSE 'CB1' END END"
)
ELEMENT = (
    "CASE WHEN slot = 1 THEN 'N' WHEN slot = 4 THEN 'O' WHEN slot < 4 OR slot > 6 THEN 'C' "
    "ELSE CASE ri % 10 WHEN 0 THEN 'O' WHEN 1 THEN 'N' WHEN 2 THEN 'O' WHEN 3 THEN 'N' "
    "WHEN 5 THEN 'O' WHEN 6 THEN 'S' WHEN 8 THEN 'O' WHEN 9 THEN 'FE' ELSE 'C' END END"
)
CHAIN = "CASE WHEN ri < 75 THEN 'A' WHEN ri < 150 THEN 'B' WHEN ri < 225 THEN 'C' ELSE 'D' END"
ALT = "CASE slot WHEN 5 THEN 'A' WHEN 6 THEN 'B' ELSE '.' END"
SLOT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*SLOT_ORDER))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", *SLOT_ORDER)
    derived = lines.withColumn("slot", slot).withColumn("ri", E("l_orderkey % 300"))
    return derived.select(
        E("l_orderkey div 300").alias("structure_id"),
        E("l_orderkey * 64 + slot").alias("atom_id"),
        E("CAST(ri AS INT)").alias("res_id"),
        F.lit("").alias("ins_code"),
        E(CHAIN).alias("chain_id"),
        E(RESIDUE).alias("res_name"),
        E(ATOM).alias("atom_name"),
        E(ELEMENT).alias("element"),
        E("ri % 10 >= 8").alias("hetero"),
        E(ALT).alias("altloc_id"),
        (E("CAST(l_suppkey % 10 AS DOUBLE)") / E("CAST(10 AS DOUBLE)")).alias("occupancy"),
        E("CAST(l_quantity AS DOUBLE)").alias("b_factor"),
        E(
            "CAST((l_orderkey % 7)*3800 + (l_partkey % 13 - 6)*100 + slot*300 AS DOUBLE)"
            "/CAST(1000 AS DOUBLE)"
        ).alias("x"),
        E(
            "CAST((ri div 7 % 7)*3800 + (l_suppkey % 11 - 5)*100 AS DOUBLE)/CAST(1000 AS DOUBLE)"
        ).alias("y"),
        E("CAST((ri div 49)*3800 + slot*200 AS DOUBLE)/CAST(1000 AS DOUBLE)").alias("z"),
    )


SQL_ATOMS = f"""
fx_rows AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(SLOT_ORDER)}) AS slot,
    l_orderkey % 300 AS ri
  FROM lineitem),
fx_atoms AS (
  SELECT l_orderkey // 300 AS structure_id, l_orderkey*64 + slot AS atom_id,
    CAST(ri AS INT) AS res_id, '' AS ins_code, {CHAIN} AS chain_id, {RESIDUE} AS res_name,
    {ATOM} AS atom_name, {ELEMENT} AS element, ri % 10 >= 8 AS hetero, {ALT} AS altloc_id,
    CAST(l_suppkey % 10 AS DOUBLE)/CAST(10 AS DOUBLE) AS occupancy,
    CAST(l_quantity AS DOUBLE) AS b_factor,
    CAST((l_orderkey % 7)*3800 + (l_partkey % 13 - 6)*100 + slot*300 AS DOUBLE)/CAST(1000 AS DOUBLE) AS x,
    CAST((ri // 7 % 7)*3800 + (l_suppkey % 11 - 5)*100 AS DOUBLE)/CAST(1000 AS DOUBLE) AS y,
    CAST((ri // 49)*3800 + slot*200 AS DOUBLE)/CAST(1000 AS DOUBLE) AS z
  FROM fx_rows)"""


def sql(body: str, *ctes: str) -> str:
    """A query over fx_atoms and any further named parts."""
    return "WITH " + ", ".join([SQL_ATOMS, *ctes]) + "\n" + body


AMINO = "('ASP','ARG','GLU','LYS','ALA','SER','CYS','GLY')"
RESKEY = "structure_id, chain_id, res_id, ins_code"


def fx_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive atoms of a residue, bonds across two alternate letters left out."""
    atoms = fx_atoms(spark, sf_dir).select(
        "structure_id", "chain_id", "res_id", "atom_id", "altloc_id"
    )
    nxt = atoms.select(
        "structure_id", "chain_id", "res_id",
        F.col("atom_id").alias("b"), (F.col("atom_id") - 1).alias("a"),
        F.col("altloc_id").alias("alt_b"),
    )
    here = atoms.withColumnRenamed("atom_id", "a")
    both = here.join(nxt, ["structure_id", "chain_id", "res_id", "a"])
    crossed = E("altloc_id <> '.' AND alt_b <> '.' AND altloc_id <> alt_b")
    return both.filter(~crossed).select("structure_id", "a", "b")


SQL_BONDS = """
fx_bonds AS (
  SELECT a.structure_id, a.atom_id AS a, b.atom_id AS b
  FROM fx_atoms a JOIN fx_atoms b ON a.structure_id = b.structure_id AND a.chain_id = b.chain_id
   AND a.res_id = b.res_id AND b.atom_id = a.atom_id + 1
   AND NOT (a.altloc_id <> '.' AND b.altloc_id <> '.' AND a.altloc_id <> b.altloc_id))"""


def fx_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten drifting frames of the CA atoms."""
    return drifting(fx_atoms(spark, sf_dir).filter("atom_name = 'CA'"))


def drifting(ca: DataFrame) -> DataFrame:
    frames = ca.withColumn("frame", E("explode(sequence(0, 9))"))
    return frames.select(
        F.col("structure_id").alias("traj_id"), "frame", "atom_id", "res_id", "ins_code",
        "chain_id", "res_name",
        E(
            "x + CAST((atom_id % 17)*frame*(1 - 2*(frame % 2)) AS DOUBLE)/CAST(1000 AS DOUBLE)"
        ).alias("x"),
        E("y + CAST((atom_id % 11)*frame AS DOUBLE)/CAST(1000 AS DOUBLE)").alias("y"),
        "z",
    )


SQL_FRAMES = """
fx_frames AS (
  SELECT structure_id AS traj_id, CAST(frame AS INT) AS frame, atom_id, res_id, ins_code, chain_id,
    res_name,
    x + CAST((atom_id % 17)*frame*(1 - 2*(frame % 2)) AS DOUBLE)/CAST(1000 AS DOUBLE) AS x,
    y + CAST((atom_id % 11)*frame AS DOUBLE)/CAST(1000 AS DOUBLE) AS y, z
  FROM (SELECT *, unnest(range(10)) AS frame FROM fx_atoms WHERE atom_name = 'CA'))"""

LETTERS = "ACDEFGHIKLMNPQRSTVWY-"


def fx_msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alignment per 250 customers; every tenth sequence is cut short."""
    rows = table(spark, sf_dir, "customer").select(
        E("c_custkey div 250").alias("msa_id"), E("c_custkey % 250").alias("seq_idx"),
        E("c_custkey").alias("k"),
        E("explode(sequence(0, CASE WHEN c_custkey % 10 = 9 THEN 79 ELSE 99 END))").alias("col"),
    )
    return rows.select(
        "msa_id", "seq_idx", "col",
        E(
            f"substring('{LETTERS}', CAST((col*5 + (k*k) % (1 + col % 9)) % 21 AS INT) + 1, 1)"
        ).alias("letter"),
    )


SQL_MSA = f"""
fx_msa AS (
  SELECT c_custkey // 250 AS msa_id, c_custkey % 250 AS seq_idx, CAST(col AS INT) AS col,
    substring('{LETTERS}', CAST((col*5 + (c_custkey*c_custkey) % (1 + col % 9)) % 21 AS INT) + 1, 1) AS letter
  FROM (SELECT c_custkey, unnest(range(CASE WHEN c_custkey % 10 = 9 THEN 80 ELSE 100 END)) AS col
        FROM customer))"""


def fx_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charged(fx_atoms(spark, sf_dir))


def charged(atoms: DataFrame) -> DataFrame:
    return atoms.select(
        "structure_id", "atom_id", "x", "y", "z",
        E("CAST(atom_id % 5 - 2 AS DOUBLE)/CAST(4 AS DOUBLE)").alias("charge"),
        F.lit(1.0).alias("radius"),
    )


SQL_CHARGES = """
fx_charges AS (
  SELECT structure_id, atom_id, x, y, z,
    CAST(atom_id % 5 - 2 AS DOUBLE)/CAST(4 AS DOUBLE) AS charge, CAST(1 AS DOUBLE) AS radius
  FROM fx_atoms)"""


def fx_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten voxels from every order: 400 orders make one 10 x 20 x 20 volume."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", E("explode(sequence(0, 9))").alias("ix"))
    return rows.select(
        E("o_orderkey div 400").alias("volume_id"), E("o_orderkey % 400 div 20").alias("iz"),
        E("o_orderkey % 20").alias("iy"), "ix",
        E("CAST((ix*37 + o_orderkey*101) % 997 AS DOUBLE)/CAST(997 AS DOUBLE)").alias("value"),
    )


def fx_volume_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header statistics that are deliberately wrong, one row per volume."""
    ids = table(spark, sf_dir, "orders").select(E("o_orderkey div 400").alias("volume_id")).distinct()
    return ids.select(
        "volume_id", F.lit(-999.0).alias("stated_min"), F.lit(999.0).alias("stated_max"),
        F.lit(42.0).alias("stated_mean"), F.lit(7.0).alias("stated_sigma"),
        E("element_at(array(' Measured', 'sharpened', 'NN_enhanced'), CAST(volume_id % 3 AS INT) + 1)").alias(
            "provenance"
        ),
    )


SQL_VOXELS = """
fx_voxels AS (
  SELECT o_orderkey // 400 AS volume_id, o_orderkey % 400 // 20 AS iz, o_orderkey % 20 AS iy, ix,
    CAST((ix*37 + o_orderkey*101) % 997 AS DOUBLE)/CAST(997 AS DOUBLE) AS value
  FROM (SELECT o_orderkey, unnest(range(10)) AS ix FROM orders))"""


def fx_ops(atoms: DataFrame) -> DataFrame:
    """Assembly operators: 1 to 3 per structure, 13 for every seventh structure."""
    chains = atoms.select("structure_id", "chain_id").distinct()
    ops = chains.withColumn(
        "op_id",
        E("explode(sequence(1, IF(structure_id % 7 = 6, 13, CAST(1 + structure_id % 3 AS INT))))"),
    )
    turn = {"r11": "op_id % 2", "r12": "op_id % 2 - 1", "r13": "0", "r21": "1 - op_id % 2",
            "r22": "op_id % 2", "r23": "0", "r31": "0", "r32": "0", "r33": "1",
            "tx": "(op_id - 1) * 5", "ty": "0", "tz": "0"}
    return ops.select(
        "structure_id", "chain_id", "op_id",
        *[E(f"CAST({v} AS DOUBLE)").alias(k) for k, v in turn.items()],
    )


def fx_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every atom twice: the second copy shifted by 40 along x."""
    both = fx_atoms(spark, sf_dir).withColumn("sym_id", E("explode(array(0, 1))"))
    return both.withColumn("x", E("x + CAST(sym_id * 40 AS DOUBLE)"))


SQL_COPIES = """
fx_copies AS (
  SELECT * REPLACE (x + CAST(sym_id * 40 AS DOUBLE) AS x)
  FROM (SELECT *, unnest([0, 1]) AS sym_id FROM fx_atoms))"""


# ---------------------------------------------------------------- folded backbones
# fixed values: radius and phase (degrees) and height of N, CA, C, O in an ideal
# alpha helix (100 degrees and 1.5 angstroms per residue), and their offsets in
# an extended strand (3.4 per residue along z, strands 4.8 apart along x)
HELIX_SPOTS = {"N": (1.55, -27.5, -0.9), "CA": (2.28, 0.0, 0.0), "C": (1.67, 26.4, 1.12), "O": (2.0, 23.6, 2.32)}
STRAND_SPOTS = {"N": (0.35, -1.2), "CA": (0.8, 0.0), "C": (-0.4, 1.2), "O": (-1.6, 1.25)}


def _fold_place(axis: str) -> str:
    """Thousandths of an angstrom: 25 residues of helix, then strands of ten, per block of 75."""
    helix, sheet = [], []
    for name, (r, phase, up) in HELIX_SPOTS.items():
        turn = f"radians(100.0*p + ({phase}))"
        value = {"x": f"round(1000*({r})*cos({turn}))", "y": f"round(1000*({r})*sin({turn}))",
                 "z": f"1500*p + ({round(1000 * up)})"}[axis]
        helix.append(f"WHEN '{name}' THEN {value}")
    for name, (side, up) in STRAND_SPOTS.items():
        # strands run up and down in turn; the side alternates along a strand
        value = {"x": f"4800*s + ({round(1000 * side)})*(1 - 2*(q % 2))", "y": "30000 + 900*(q % 2)",
                 "z": f"(3400*q + ({round(1000 * up)}))*(1 - 2*(s % 2)) + 30600*(s % 2)"}[axis]
        sheet.append(f"WHEN '{name}' THEN {value}")
    far = {"x": "60000*b", "y": "0", "z": "0"}[axis]
    jitter = {"x": "(w % 13 - 6)*12", "y": "(w % 11 - 5)*12", "z": "(w % 7 - 3)*12"}[axis]
    return (
        f"CAST(CAST({far} + {jitter} + CASE WHEN p < 25 THEN CASE atom_name {' '.join(helix)} END "
        f"ELSE CASE atom_name {' '.join(sheet)} END END AS BIGINT) AS DOUBLE)/CAST(1000 AS DOUBLE) AS {axis}"
    )


def fx_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backbones from the orders: structures of 300 residues, a helix and strands in each chain."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_orderkey div 300 AS structure_id", "o_orderkey % 300 div 75 AS b",
        "o_orderkey % 75 AS p", "(o_orderkey % 75 - 25) div 10 AS s", "(o_orderkey % 75 - 25) % 10 AS q",
        "o_custkey AS w", "posexplode(array('N','CA','C','O')) AS (slot, atom_name)",
    )
    return rows.selectExpr(
        "structure_id", "k*4 + slot AS atom_id", "CAST(k % 300 AS INT) AS res_id", "'' AS ins_code",
        "element_at(array('A','B','C','D'), CAST(b AS INT) + 1) AS chain_id",
        "CASE k % 5 WHEN 0 THEN 'GLY' WHEN 1 THEN 'ALA' WHEN 2 THEN 'SER' WHEN 3 THEN 'LYS' ELSE IF(w % 3 = 0, 'PRO', 'VAL') END AS res_name",
        "atom_name", "substring(atom_name, 1, 1) AS element", "'.' AS altloc_id",
        *[_fold_place(c) for c in "xyz"],
    )


SQL_FOLD = f"""
fx_fold AS (SELECT structure_id, k*4 + slot AS atom_id, CAST(k % 300 AS INT) AS res_id, '' AS ins_code,
    CASE b WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS chain_id,
    CASE k % 5 WHEN 0 THEN 'GLY' WHEN 1 THEN 'ALA' WHEN 2 THEN 'SER' WHEN 3 THEN 'LYS' ELSE CASE WHEN w % 3 = 0 THEN 'PRO' ELSE 'VAL' END END AS res_name,
    atom_name, {", ".join(_fold_place(c) for c in "xyz")}
  FROM (SELECT o_orderkey AS k, o_orderkey // 300 AS structure_id, o_orderkey % 300 // 75 AS b, o_orderkey % 75 AS p,
      (o_orderkey % 75 - 25) // 10 AS s, (o_orderkey % 75 - 25) % 10 AS q, o_custkey AS w,
      unnest([0, 1, 2, 3]) AS slot, unnest(['N', 'CA', 'C', 'O']) AS atom_name FROM orders))"""


# ---------------------------------------------------------------- a wider vocabulary
# Chain D of fx_atoms as nucleotides, sugars, ions and hydrogens.
MIXED = {
    "res_name": "CASE res_id % 6 WHEN 0 THEN 'DA' WHEN 1 THEN 'G' WHEN 2 THEN 'NAG' WHEN 3 THEN 'ZN' WHEN 4 THEN 'CL' ELSE 'SO4' END",
    "atom_name": "CASE atom_id % 7 WHEN 0 THEN 'P' WHEN 1 THEN 'O1P' WHEN 2 THEN 'C1*' WHEN 3 THEN 'N9' WHEN 4 THEN 'H5' ELSE 'O5' END",
    "element": "CASE WHEN res_id % 6 = 3 THEN 'Zn' WHEN res_id % 6 = 4 THEN 'CL' WHEN res_id % 6 = 5 THEN 'S' WHEN atom_id % 7 = 0 THEN 'P' "
    "WHEN atom_id % 7 = 2 THEN 'C' WHEN atom_id % 7 = 3 THEN 'N' WHEN atom_id % 7 = 4 THEN 'H' ELSE 'O' END",
    "hetero": "res_id % 6 > 1",
}


def fx_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = {c: F.expr(f"CASE WHEN chain_id = 'D' THEN {v} ELSE {c} END") for c, v in MIXED.items()}
    atoms = fx_atoms(spark, sf_dir)
    return atoms.select(*[changed[c].alias(c) if c in changed else c for c in atoms.columns])


SQL_MIXED = (
    "fx_mixed AS (SELECT * REPLACE ("
    + ", ".join(f"CASE WHEN chain_id = 'D' THEN {v} ELSE {c} END AS {c}" for c, v in MIXED.items())
    + ") FROM fx_atoms)"
)


def fx_protons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_atoms with every CA turned into a hydrogen, bonded to its N by fx_bonds."""
    turned = F.when(F.col("atom_name") == "CA", "H").otherwise(F.col("element"))
    return fx_atoms(spark, sf_dir).withColumn("element", turned)


SQL_PROTONS = """fx_protons AS (SELECT * REPLACE (CASE WHEN atom_name = 'CA' THEN 'H' ELSE element END AS element) FROM fx_atoms)"""
