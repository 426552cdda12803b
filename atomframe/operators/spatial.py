"""Distance joins and the keyed joins that widen a set of atoms.

Distance joins never pair up a whole structure. Space is cut into cubes; an
atom of the left side lies in one cube, an atom of the right side is copied to
every cube its ball of radius ``r`` touches (at most eight with a cube edge of
``2r``). The join is then an equi-join on (structure, cube) followed by the
exact distance test, so a giant structure spreads over as many tasks as it has
cubes and every true pair meets exactly once.

A set of atoms ``x`` is a DataFrame holding at least the atom key columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..scaling import by_key, met_by
from . import predicates as P
from .prep import resolve_conformers

AXES = ("x", "y", "z")
_BITS = 21


def squared_distance(a: str, b: str) -> Column:
    """Squared distance between the points whose columns start with ``a`` and ``b``."""
    dx, dy, dz = (F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in AXES)
    return dx * dx + dy * dy + dz * dz


def _pack(cx: Column, cy: Column, cz: Column) -> Column:
    """Three cube numbers in one long. Numbers wrap after 2^21 cubes, which only
    adds candidates that the distance test drops."""
    mask = F.lit((1 << _BITS) - 1)
    low = [c.bitwiseAND(mask) for c in (cx, cy, cz)]
    return F.shiftleft(low[0], 2 * _BITS).bitwiseOR(F.shiftleft(low[1], _BITS)).bitwiseOR(low[2])


def _cube(c: str | Column, edge: float) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.floor(column / F.lit(edge)).cast("long")


def in_cube(df: DataFrame, edge: float) -> DataFrame:
    return df.withColumn("_cube", _pack(*[_cube(c, edge) for c in AXES]))


def reaching_cubes(df: DataFrame, r: float, edge: float) -> DataFrame:
    """One copy of each row per cube its ball touches."""
    slack = r * (1 + 1e-9) + 1e-9
    out = df
    for c in AXES:
        low, high = _cube(F.col(c) - slack, edge), _cube(F.col(c) + slack, edge)
        out = out.withColumn(f"_c{c}", F.explode(F.sequence(low, high)))
    packed = _pack(*[F.col(f"_c{c}") for c in AXES])
    return out.withColumn("_cube", packed).drop(*[f"_c{c}" for c in AXES])


def _edge(r: float) -> float:
    return max(2.0 * r, 1.0)


def pairs_within(
    a: DataFrame,
    b: DataFrame,
    r: float,
    left: list[str] | None = None,
    right: list[str] | None = None,
    group: list[str] | None = None,
    extra: Column | None = None,
    heavy: bool = False,
) -> DataFrame:
    """Pairs of one ``a`` atom and one ``b`` atom at most ``r`` apart, with ``d``.

    ``left``/``right`` name columns to carry, prefixed ``a_``/``b_`` in the
    result; ``extra`` is a further condition on those prefixed columns.
    ``heavy`` says that much work per pair follows: the left side is then
    hash-partitioned by the join key up front, so that partitions are not
    merged by the small size of their input.
    """
    r = S.positive(r, "radius")
    group = group or ["structure_id"]
    left, right = left or ["atom_id"], right or ["atom_id"]
    edge = _edge(r)

    def side(df: DataFrame, prefix: str, carry: list[str]) -> DataFrame:
        extra_cols = [c for c in dict.fromkeys(carry) if c not in (*AXES, *group)]
        renamed = [F.col(c).alias(f"{prefix}{c}") for c in extra_cols]
        return df.select(*group, "_cube", *renamed, *[F.col(c).alias(f"{prefix}{c}") for c in AXES])

    key = [*group, "_cube"]
    near = side(in_cube(a, edge), "a_", left)
    near = by_key(near, key) if heavy else met_by(near, key)
    near = near.join(met_by(side(reaching_cubes(b, r, edge), "b_", right), key), key)
    d2 = squared_distance("a_", "b_")
    hit = d2 <= F.lit(r * r)
    near = near.filter(hit if extra is None else hit & extra).withColumn("d", F.sqrt(d2))
    drop = [f"a_{c}" for c in AXES if c not in left] + [f"b_{c}" for c in AXES if c not in right]
    return near.drop("_cube", *drop)


def within(atoms: DataFrame, target: DataFrame, r: float) -> DataFrame:
    """Atoms with any ``target`` atom at distance at most ``r``.

    A semi-join: every atom of ``atoms`` comes out at most once, so nothing has
    to be de-duplicated afterwards. Equal target positions are sent once.
    """
    r = S.positive(r, "radius")
    edge = _edge(r)
    spots = target.select("structure_id", *AXES).distinct()
    spots = reaching_cubes(spots, r, edge).select(
        F.col("structure_id").alias("_s"),
        F.col("_cube").alias("_k"),
        *[F.col(c).alias(f"_t{c}") for c in AXES],
    )
    cubed = in_cube(atoms, edge)
    d2 = sum(
        ((F.col(c) - F.col(f"_t{c}")) * (F.col(c) - F.col(f"_t{c}")) for c in AXES[1:]),
        (F.col("x") - F.col("_tx")) * (F.col("x") - F.col("_tx")),
    )
    met = (F.col("structure_id") == F.col("_s")) & (F.col("_cube") == F.col("_k"))
    # the copies are more than their guessed size says, and a semi-join is moved below a shuffle
    spots = spots.hint("merge")
    return cubed.join(spots, met & (d2 <= F.lit(r * r)), "left_semi").drop("_cube")


def around(atoms: DataFrame, x: DataFrame, r: float) -> DataFrame:
    """Atoms within ``r`` of ``x`` that are not in ``x``."""
    return minus(within(atoms, x, r), x)


def expand(atoms: DataFrame, x: DataFrame, r: float) -> DataFrame:
    """``x`` and everything within ``r`` of it (every atom is within ``r`` of itself)."""
    return within(atoms, x, r)


def near(
    atoms: DataFrame,
    x: DataFrame,
    r: float = 5.0,
    whole_residues: bool = True,
    exclude_self: bool = True,
) -> DataFrame:
    found = within(atoms, x, r)
    if whole_residues:
        found = byres(atoms, found)
    return minus(found, x) if exclude_self else found


def minus(atoms: DataFrame, x: DataFrame) -> DataFrame:
    key = S.atom_key(atoms)
    return atoms.join(x.select(*key), key, "left_anti")


def only(atoms: DataFrame, x: DataFrame) -> DataFrame:
    key = S.atom_key(atoms)
    return atoms.join(x.select(*key), key, "left_semi")


def byres(atoms: DataFrame, x: DataFrame) -> DataFrame:
    """All atoms of every residue that ``x`` touches."""
    key = S.residue_key(atoms)
    return atoms.join(x.select(*key).distinct(), key, "left_semi")


def bychain(atoms: DataFrame, x: DataFrame) -> DataFrame:
    """All atoms of every chain id that ``x`` touches; symmetry copies share the id."""
    key = ["structure_id", "chain_id"]
    return atoms.join(x.select(*key).distinct(), key, "left_semi")


def attach_field(
    atoms: DataFrame, field: DataFrame, value: str = "value", default: float | None = None
) -> DataFrame:
    """A per-residue number onto every atom of the residue, in every symmetry copy."""
    key = ["structure_id", "chain_id", "res_id", "ins_code"]
    joined = atoms.join(field.select(*key, value), key, "left")
    if default is None:
        return joined
    return joined.withColumn(value, F.coalesce(value, F.lit(float(default))))


def disulfides(atoms: DataFrame, d: float = 2.5) -> DataFrame:
    """Pairs of cysteine sulfurs at most ``d`` apart, one conformer state, each pair once."""
    order = S.rank_column(atoms)
    sulfur = resolve_conformers(atoms).filter(P.resn("CYS") & P.name("SG"))
    carry = ["atom_id", order, "chain_id", "res_id"]
    once = F.col(f"a_{order}") < F.col(f"b_{order}")
    if S.has_copies(atoms):
        carry.append("sym_id")
        once = (F.col("a_sym_id") < F.col("b_sym_id")) | (
            (F.col("a_sym_id") == F.col("b_sym_id")) & once
        )
    found = pairs_within(sulfur, sulfur, d, carry, carry, extra=once)
    return found.withColumn("angstroms", F.round("d", 2))


def metal_sites(atoms: DataFrame, d: float = 2.5) -> DataFrame:
    """Metals and the whole residues with a non-metal atom within ``2d`` of one.

    ``is_metal`` tells the two apart. One conformer state throughout.
    """
    state = resolve_conformers(atoms)
    metals = state.filter(P.is_class("metals"))
    touching = within(state.filter(~P.is_class("metals")), metals, 2 * d)
    shell = byres(state, touching)
    keep = S.atom_key(state)
    hits = shell.select(*keep).union(metals.select(*keep)).distinct()
    return only(state, hits).withColumn("is_metal", P.is_class("metals"))


def crosslinks(atoms: DataFrame, d: float = 2.5, strict: bool = False) -> DataFrame:
    """Per structure: disulfides, metal atoms and coordinating residues.

    ``strict`` refuses a collection that has neither.
    """
    state = resolve_conformers(atoms)
    metals = state.filter(P.is_class("metals"))
    bridges = disulfides(atoms, d).groupBy("structure_id").agg(F.count("*").alias("disulfides"))
    touching = within(state.filter(~P.is_class("metals")), metals, 2 * d)
    shell = touching.select(*S.residue_key(state)).distinct()
    counted = metals.groupBy("structure_id").agg(F.count("*").alias("metal_atoms"))
    ring = shell.groupBy("structure_id").agg(F.count("*").alias("coordinating_residues"))
    out = (
        bridges.join(counted, "structure_id", "full_outer")
        .join(ring, "structure_id", "full_outer")
        .na.fill(0)
    )
    if strict and out.isEmpty():
        raise ValueError("no disulfides and no metals in this collection")
    return out


def ligand_site(
    atoms: DataFrame, resn: str, around: float = 5.0, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The copies of a named residue, and the whole residues whose polymer atoms line it."""
    around = S.positive(around, "around")
    ligand = P.require_residue(atoms, resn) if strict else atoms.filter(P.resn(resn))
    lining = byres(atoms, within(atoms.filter(P.is_class("polymer")), ligand, around))
    if strict and lining.isEmpty():
        raise ValueError(f"nothing lines {resn} within {around}")
    return ligand, lining


def ligand_report(atoms: DataFrame, resn: str, around: float = 5.0) -> DataFrame:
    """Copies, atoms and lining residues of a named residue, per structure."""
    ligand, lining = ligand_site(atoms, resn, around)
    copy = F.struct("chain_id", "res_id", "ins_code")
    site = ligand.groupBy("structure_id").agg(
        F.countDistinct(copy).alias("copies"), F.count("*").alias("atoms")
    )
    residues = lining.select(*S.residue_key(atoms)).distinct()
    wall = residues.groupBy("structure_id").agg(F.count("*").alias("lining_residues"))
    return site.join(wall, "structure_id", "left").na.fill(0, ["lining_residues"])


def correspond(mobile: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """CA atoms of two structures matched by chain, number and residue name.

    ``on`` names the column(s) both sides share that say which pair of
    structures a row belongs to.
    """
    key = [*on, "chain_id", "res_id", "res_name"]
    ca = F.col("atom_name") == "CA"
    left = mobile.filter(ca).select(*key, *[F.col(c).alias(f"m{c}") for c in AXES])
    right = target.filter(ca).select(*key, *[F.col(c).alias(f"t{c}") for c in AXES])
    return right.join(left, key)


def same_in_every_copy(atoms: DataFrame, x: DataFrame) -> DataFrame:
    """Per structure: does ``x`` hold the same atoms in every symmetry copy?

    Counting is enough: a set is the same in all ``n`` copies exactly when each
    of its atoms is present ``n`` times.
    """
    S.require(atoms, "sym_id")
    copies = atoms.groupBy("structure_id").agg(F.countDistinct("sym_id").alias("copies"))
    each = x.groupBy("structure_id", "atom_id").agg(F.countDistinct("sym_id").alias("n"))
    spread = each.groupBy("structure_id").agg(F.min("n").alias("least"))
    return copies.join(spread, "structure_id").select(
        "structure_id", "copies", (F.col("least") == F.col("copies")).alias("same")
    )
