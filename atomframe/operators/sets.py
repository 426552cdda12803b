"""Named sets of atoms, kept as one HANDLES table (structure_id, name, atom_id[, sym_id])
with the ``origin`` text on every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..scaling import running_index, top_k
from .spatial import minus

OPS = ("union", "intersect", "subtract")


def register(handles: DataFrame | None, x: DataFrame, name: str, origin: str = "") -> DataFrame:
    """Store ``x`` under ``name``: duplicates removed, an older set of that name replaced."""
    key = S.atom_key(x)
    rows = x.select(*key).distinct().withColumn("name", F.lit(name)).withColumn(
        "origin", F.lit(origin)
    )
    return rows if handles is None else drop(handles, name).unionByName(rows)


def names(handles: DataFrame) -> list[str]:
    return sorted(r[0] for r in handles.select("name").distinct().collect())


def get(handles: DataFrame, name: str, strict: bool = False) -> DataFrame:
    found = handles.filter(F.col("name") == name)
    if strict and found.isEmpty():
        raise ValueError(f"no set named {name!r}; known: {', '.join(names(handles)) or 'none'}")
    return found


def drop(handles: DataFrame, name: str) -> DataFrame:
    return handles.filter(F.col("name") != name)


def clear(handles: DataFrame) -> DataFrame:
    return handles.limit(0)


def combine_sets(
    handles: DataFrame, op: str, members: list[str], out: str, strict: bool = False
) -> DataFrame:
    """Left fold of ``op`` over the named sets; the result is registered as ``out``."""
    if op not in OPS:
        raise ValueError(f"unknown operation {op!r}; known: {', '.join(OPS)}")
    if not members or (op == "subtract" and len(members) < 2):
        raise ValueError(f"{op} needs {'two sets' if op == 'subtract' else 'a set'} at least")
    key = S.atom_key(handles)
    parts = [get(handles, n, strict).select(*key) for n in members]
    if op == "union":
        wanted = set(members)
        folded = handles.filter(F.col("name").isin(sorted(wanted))).select(*key).distinct()
    else:
        how = "left_semi" if op == "intersect" else "left_anti"
        folded = reduce(lambda a, b: a.join(b, key, how), parts)
    return register(handles, folded, out, f"{op}({', '.join(members)})")


def invert(atoms: DataFrame, handles: DataFrame, of: str, out: str) -> DataFrame:
    """Register everything the set does not hold, in each structure."""
    return register(handles, minus(atoms, get(handles, of)), out, f"invert({of})")


def residues_in_order(atoms: DataFrame) -> DataFrame:
    """One row per residue with ``first_seen``, the order of its first atom."""
    order = F.min(F.struct(*S.file_order(atoms)))
    return atoms.groupBy(*S.residue_key(atoms), "res_name").agg(
        order.alias("first_seen"), F.count("*").alias("atoms")
    )


def summarise(x: DataFrame) -> DataFrame:
    """Atom count, residue count and sorted chains of a set, per structure."""
    residue = F.struct(*S.residue_key(x)[1:])
    return x.groupBy("structure_id").agg(
        F.count("*").alias("atoms"),
        F.countDistinct(residue).alias("residues"),
        F.array_join(F.sort_array(F.collect_set("chain_id")), ",").alias("chains"),
    )


def residue_listing(x: DataFrame, limit: int = 200) -> DataFrame:
    """The first ``limit`` residues of a set in order of appearance, exact counts beside.

    ``truncated`` tells whether the structure holds more residues than listed.
    """
    key = S.residue_key(x)
    seen = x.groupBy(*key).agg(
        F.min(F.struct(*S.file_order(x))).alias("first_seen"),
        F.min_by("res_name", F.struct(*S.file_order(x))).alias("res_name"),
    )
    total = seen.groupBy("structure_id").agg(F.count("*").alias("residues"))
    listed = top_k(seen, ["structure_id"], [F.col("first_seen")], limit)
    return listed.join(total, "structure_id").select(
        *key, "res_name", "place", "residues", (F.col("residues") > limit).alias("truncated")
    )


def list_handles(atoms: DataFrame, handles: DataFrame) -> DataFrame:
    """Name, atom count, residue count and origin of every set, per structure."""
    key = S.atom_key(handles)
    full = handles.join(atoms.select(*key, *[c for c in S.residue_key(atoms) if c not in key]), key)
    residue = F.struct(*S.residue_key(atoms)[1:])
    return full.groupBy("structure_id", "name", "origin").agg(
        F.count("*").alias("atoms"), F.countDistinct(residue).alias("residues")
    )


def id_runs(x: DataFrame, min_run: int = 3, group: list[str] | None = None) -> DataFrame:
    """Consecutive ids as (lo, hi); runs shorter than ``min_run`` are listed id by id.

    Islands are ``id - position``; positions are numbered block-wise, so a set
    of any size in one structure is spread over the cluster.
    """
    group = group or ["structure_id"]
    ids = x.select(*group, "atom_id").distinct()
    islands = running_index(ids, group, "atom_id", "_i").withColumn(
        "_island", F.col("atom_id") - F.col("_i")
    )
    runs = islands.groupBy(*group, "_island").agg(
        F.min("atom_id").alias("lo"), F.max("atom_id").alias("hi")
    )
    long_run = (F.col("hi") - F.col("lo") + 1) >= min_run
    single = runs.filter(~long_run).withColumn("lo", F.explode(F.sequence("lo", "hi")))
    return (
        runs.filter(long_run)
        .select(*group, "lo", "hi")
        .unionByName(single.select(*group, "lo", F.col("lo").alias("hi")))
    )


def check_copy_partition(atoms: DataFrame) -> DataFrame:
    """Per structure: are the symmetry copies disjoint, and is their union the whole?"""
    S.require(atoms, "sym_id")
    per_row = atoms.groupBy("structure_id", "sym_id", "atom_id").agg(F.count("*").alias("n"))
    return per_row.groupBy("structure_id").agg(
        F.countDistinct("sym_id").alias("copies"),
        F.sum("n").alias("atoms"),
        (F.max("n") == 1).alias("disjoint"),
    )


def save_handles(handles: DataFrame, path: str, buckets: int = 64) -> None:
    """Write the table in ``buckets`` folders by structure, sorted inside each file.

    A folder per structure would mean millions of tiny files.
    """
    bucket = F.pmod(F.xxhash64("structure_id"), F.lit(buckets)).cast("int")
    rows = handles.withColumn("bucket", bucket)
    rows.repartition("bucket", "structure_id", "name").sortWithinPartitions(
        "bucket", "structure_id", "name", "atom_id"
    ).write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_handles(spark: SparkSession, path: str, atoms: DataFrame | None = None) -> DataFrame:
    """Saved sets; with ``atoms``, only rows that still name an atom."""
    saved = spark.read.parquet(path).drop("bucket")
    if atoms is None:
        return saved
    key = S.atom_key(saved)
    return saved.join(atoms.select(*key), key, "left_semi")
