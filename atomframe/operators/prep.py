"""Preparation: alternate positions, assemblies, transforms, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.altloc import normalised_altloc
from ..scaling import running_index, top_k
from . import predicates as P


def normalise_altloc(atoms: DataFrame) -> DataFrame:
    """One spelling, ``'.'``, for an atom without alternate positions."""
    return atoms.withColumn("altloc_id", normalised_altloc(F.col("altloc_id")))


def labelled() -> Column:
    return F.col("altloc_id") != S.NO_ALTLOC


def labelled_atoms(atoms: DataFrame) -> DataFrame:
    """Atoms with an alternate letter, per structure, and whether there are any."""
    count = F.sum(labelled().cast("long"))
    return atoms.groupBy("structure_id").agg(
        count.alias("labelled"), (count > 0).alias("has_altlocs")
    )


def altloc_surplus(atoms: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Labelled rows beyond one per site, per structure (times copies if given)."""
    site = [*S.residue_key(atoms), "res_name", "atom_name"]
    per_site = atoms.filter(labelled()).groupBy(*site).agg((F.count("*") - 1).alias("extra"))
    surplus = per_site.groupBy("structure_id").agg(F.sum("extra").alias("surplus"))
    out = (
        atoms.select("structure_id").distinct().join(surplus, "structure_id", "left").na.fill(0)
    )
    if copies is None:
        return out
    return out.join(copies.select("structure_id", "copies"), "structure_id", "left").select(
        "structure_id", (F.col("surplus") * F.coalesce("copies", F.lit(1))).alias("surplus")
    )


def resolve_conformers(atoms: DataFrame, altloc: str | None = None) -> DataFrame:
    """One conformer state.

    Unlabelled atoms always stay. With no letter, each site keeps its own
    best-occupied alternate (first letter on a tie); with a letter, only the
    atoms carrying it stay. Only labelled atoms are ranked, and the rank limit
    is applied before the shuffle.
    """
    if "altloc_id" not in atoms.columns:
        return atoms
    if altloc is not None:
        return atoms.filter(~labelled() | (F.col("altloc_id") == P.alt_value(altloc)))
    weight = F.coalesce("occupancy", F.lit(0.0)) if "occupancy" in atoms.columns else F.lit(0.0)
    order = [weight.desc(), F.col("altloc_id"), *[F.col(c) for c in S.file_order(atoms)]]
    best = top_k(atoms.filter(labelled()), S.site_key(atoms), order, 1).drop("place")
    return atoms.filter(~labelled()).unionByName(best)


def conformers_used(state: DataFrame) -> DataFrame:
    """Letters a resolved state kept, joined with '+', per structure."""
    letters = F.sort_array(F.collect_set(F.when(labelled(), F.col("altloc_id"))))
    return state.groupBy("structure_id").agg(F.array_join(letters, "+").alias("conformers"))


def dominant_altloc(atoms: DataFrame) -> DataFrame:
    """The letter with the greatest total occupancy per structure, first letter on a tie."""
    # Rounded, so that the order in which tasks add up cannot decide a tie.
    weight = F.round(F.sum("occupancy"), 6) if "occupancy" in atoms.columns else F.lit(0.0)
    totals = atoms.filter(labelled()).groupBy("structure_id", "altloc_id").agg(weight.alias("w"))
    best = top_k(totals, ["structure_id"], [F.col("w").desc(), F.col("altloc_id")], 1)
    best = best.select("structure_id", F.col("altloc_id").alias("dominant"))
    every = atoms.select("structure_id").distinct()
    return every.join(best, "structure_id", "left").na.fill(S.NO_ALTLOC, ["dominant"])


def residue_labels(atoms: DataFrame) -> DataFrame:
    """A printable residue label, copy included when there are copies."""
    names = S.residue_key(atoms)[1:]
    return atoms.withColumn("residue", S.label(*names))


def renumber(atoms: DataFrame, order: str = "rank") -> DataFrame:
    """Atom ids 1..n in row order, numbered block-wise so no task holds a structure."""
    numbered = running_index(atoms, ["structure_id"], order, "_i")
    return numbered.withColumn("atom_id", F.col("_i") + 1).drop("_i")


def assembly_multiplicity(structures: DataFrame, ops: DataFrame) -> DataFrame:
    """Operators listed per structure, 1 where none are."""
    listed = ops.groupBy("structure_id").agg(F.countDistinct("op_id").alias("n"))
    return structures.select("structure_id").distinct().join(listed, "structure_id", "left").select(
        "structure_id", F.coalesce("n", F.lit(1)).alias("copies")
    )


def affine(prefix: str = "") -> list[Column]:
    """``R x + t`` from columns r11..r33, tx..tz, as x, y, z."""
    return [
        (
            F.col(f"{prefix}r{i}1") * F.col("x")
            + F.col(f"{prefix}r{i}2") * F.col("y")
            + F.col(f"{prefix}r{i}3") * F.col("z")
            + F.col(f"{prefix}t{c}")
        ).alias(c)
        for i, c in ((1, "x"), (2, "y"), (3, "z"))
    ]


ROTATION = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
TRANSLATION = ["tx", "ty", "tz"]


def apply_transform(atoms: DataFrame, transforms: DataFrame, on: list[str] | None = None):
    """Move atoms by the transform row of their structure (or ``on`` key)."""
    on = on or ["structure_id"]
    S.require(transforms, *on, *ROTATION, *TRANSLATION)
    keep = [c for c in atoms.columns if c not in ("x", "y", "z")]
    moved = atoms.join(transforms.select(*on, *ROTATION, *TRANSLATION), on)
    return moved.select(*keep, *affine())


def expand_assembly(
    atoms: DataFrame, ops: DataFrame, max_copies: int | None = None, chain_column: str = "chain_id"
) -> DataFrame:
    """Biological assemblies: every operator applied to the chains it names.

    ``ops`` holds structure_id, op_id, chain_id, the rotation and translation;
    ``chain_column`` is the atom column those chain ids refer to.
    Copies are numbered from 0 in operator order. A structure without operators
    keeps its deposited atoms, as does one with more than ``max_copies`` of them if
    the caller sets that limit; ``note`` says which rule applied.
    """
    listed = ops.select("structure_id", "op_id").distinct()
    numbered = running_index(
        listed.withColumn("_o", F.col("op_id").cast("long")), ["structure_id"], "_o", "sym_id"
    ).select("structure_id", "op_id", F.col("sym_id").cast("int").alias("sym_id"))
    count = listed.groupBy("structure_id").agg(F.count("*").alias("_n"))
    within = F.lit(True) if max_copies is None else F.col("_n") <= max_copies
    usable = ops.join(count, "structure_id").filter(within).drop("_n")
    usable = usable.join(numbered, ["structure_id", "op_id"])
    key = ["structure_id", chain_column]
    moves = usable.withColumnRenamed("chain_id", chain_column)
    moves = moves.select(*key, "sym_id", *ROTATION, *TRANSLATION)
    keep = [c for c in atoms.columns if c not in ("x", "y", "z", "sym_id")]
    bare = atoms.drop("sym_id") if S.has_copies(atoms) else atoms
    built = bare.join(moves, key).select(
        *keep, "sym_id", *affine(), F.lit("assembly").alias("note")
    )
    plain = count.filter(within).select("structure_id")
    rest = bare.join(plain, "structure_id", "left_anti").join(count, "structure_id", "left")
    kept = rest.select(
        *keep,
        F.lit(0).alias("sym_id"),
        "x",
        "y",
        "z",
        F.when(F.col("_n").isNull(), "no operators; deposited atoms kept")
        .otherwise(F.concat(F.col("_n").cast("string"), F.lit(" operators; deposited atoms kept")))
        .alias("note"),
    )
    return built.unionByName(kept)


def combine(
    target: DataFrame, mobile: DataFrame, on: list[str], suffix: str = "_2"
) -> tuple[DataFrame, DataFrame]:
    """Append ``mobile`` to ``target``, suffixing chain ids that would collide.

    Both sides carry the ``on`` columns that say which pair they belong to.
    Returns the joint table (``side`` 0 or 1, ``atom_id`` renumbered per pair)
    and the renames.
    """
    key = [*on, "chain_id"]
    taken = target.select(*key).distinct().withColumn("_taken", F.lit(True))
    own = mobile.select(*key).distinct()
    renames = own.join(taken, key).select(
        *on, "chain_id", F.concat("chain_id", F.lit(suffix)).alias("renamed")
    )
    moved = (
        mobile.join(renames, key, "left")
        .withColumn("chain_id", F.coalesce("renamed", "chain_id"))
        .drop("renamed")
        .withColumn("side", F.lit(1))
    )
    both = target.withColumn("side", F.lit(0)).unionByName(moved)
    order = S.rank_column(target)
    # file order inside a side, the target first: one integer key for the numbering
    joint = both.withColumn("_k", F.col(order) * 2 + F.col("side"))
    first = running_index(joint, [*on, "side"], "_k", "_i")
    sizes = target.groupBy(*on).agg(F.count("*").alias("_size"))
    numbered = first.join(sizes, on, "left").withColumn(
        "atom_id",
        F.col("_i") + 1 + F.when(F.col("side") == 1, F.coalesce("_size", F.lit(0))).otherwise(0),
    )
    return numbered.drop("_k", "_i", "_size"), renames


def reconcile(a: DataFrame, b: DataFrame, surplus: DataFrame | None = None) -> DataFrame:
    """Compare the atom counts of two builds of the same structures."""
    left = a.groupBy("structure_id").agg(F.count("*").alias("count_a"))
    right = b.groupBy("structure_id").agg(F.count("*").alias("count_b"))
    out = left.join(right, "structure_id", "full_outer").withColumn(
        "status",
        F.when(F.col("count_a").isNull() | F.col("count_b").isNull(), "no count")
        .when(F.col("count_a") == F.col("count_b"), "agree")
        .otherwise("MISMATCH"),
    )
    if surplus is None:
        return out
    return out.join(surplus.select("structure_id", "surplus"), "structure_id", "left")


def choose_reading(readings: DataFrame, other: DataFrame) -> DataFrame:
    """Which build matches the other side's count, in order of preference.

    ``readings`` holds structure_id, reading, preference (0 first) and atoms;
    ``other`` structure_id and atoms. No match leaves ``reading`` null.
    """
    wanted = other.select("structure_id", F.col("atoms").alias("_wanted"))
    fits = readings.join(wanted, "structure_id").filter(F.col("atoms") == F.col("_wanted"))
    best = top_k(fits, ["structure_id"], [F.col("preference")], 1)
    return wanted.join(best.select("structure_id", "reading"), "structure_id", "left").select(
        "structure_id", F.col("_wanted").alias("atoms"), "reading"
    )


def default_chain(atoms: DataFrame) -> DataFrame:
    """Chain of the first amino-acid atom of each structure."""
    order = F.struct(*S.file_order(atoms))
    return (
        atoms.filter(P.is_class("protein"))
        .groupBy("structure_id")
        .agg(F.min_by("chain_id", order).alias("chain_id"))
    )
