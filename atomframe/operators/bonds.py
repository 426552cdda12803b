"""Bond tables: derivation, neighbours, walks, molecules, atom typing.

BONDS holds structure_id, a, b (atom ids), plus sym_id where atoms have copies.
Each bond is listed once; the operators look at it from both ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..scaling import BLOCK, cut_lineage, running_index
from .components import component_roots
from .prep import labelled

_UNROLLED = 2


def _where(bonds: DataFrame) -> list[str]:
    return ["structure_id", "sym_id"] if S.has_copies(bonds) else ["structure_id"]


def both_ways(bonds: DataFrame) -> DataFrame:
    """Every bond as src -> dst in both directions."""
    where = _where(bonds)
    ends = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
    )
    return bonds.select(*where, F.explode(ends).alias("e")).select(*where, "e.src", "e.dst")


def drop_cross_conformer(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Leave out bonds whose two ends carry different alternate letters."""
    where = _where(bonds)
    letters = atoms.filter(labelled()).select(*where, "atom_id", "altloc_id")
    for end in ("a", "b"):
        named = letters.select(
            *where, F.col("atom_id").alias(end), F.col("altloc_id").alias(f"_alt_{end}")
        )
        bonds = bonds.join(named, [*where, end], "left")
    crossed = F.coalesce(F.col("_alt_a") != F.col("_alt_b"), F.lit(False))
    return bonds.filter(~crossed).drop("_alt_a", "_alt_b")


def derive_bonds(
    atoms: DataFrame, template: DataFrame, file_bonds: DataFrame | None = None
) -> DataFrame:
    """Bonds of every structure: its file's own if it has any, else from templates.

    ``template`` holds res_name, atom1, atom2. Consecutive residues of a chain
    are linked C-N (peptide) and O3'-P (nucleic).
    """
    key, where = S.residue_key(atoms), [c for c in S.atom_key(atoms) if c != "atom_id"]
    todo = atoms
    if file_bonds is not None:
        todo = atoms.join(file_bonds.select("structure_id").distinct(), "structure_id", "left_anti")
    order = S.rank_column(atoms)
    first = todo.select(*key, "res_name", "atom_name", "atom_id").join(
        template.select("res_name", F.col("atom1").alias("atom_name"), "atom2"),
        ["res_name", "atom_name"],
    )
    second = todo.select(*key, F.col("atom_name").alias("atom2"), F.col("atom_id").alias("b"))
    inside = first.join(second, [*key, "atom2"]).select(*where, F.col("atom_id").alias("a"), "b")

    residues = todo.groupBy(*key).agg(F.min(order).alias("_first"))
    strand = [*where, "chain_id"]
    numbered = running_index(residues, strand, "_first", "_i").select(*key, "_i")
    ends = todo.filter(F.col("atom_name").isin("C", "N", "O3'", "P")).join(numbered, key)
    linked = None
    for tail, head in (("C", "N"), ("O3'", "P")):
        out = ends.filter(F.col("atom_name") == tail).select(
            *strand, (F.col("_i") + 1).alias("_i"), F.col("res_id").alias("_r"),
            F.col("atom_id").alias("a"),
        )
        into = ends.filter(F.col("atom_name") == head).select(
            *strand, "_i", "res_id", F.col("atom_id").alias("b")
        )
        met = out.join(into, [*strand, "_i"]).filter(F.col("res_id") - F.col("_r") <= 1)
        met = met.select(*where, "a", "b")
        linked = met if linked is None else linked.unionByName(met)
    bonds = inside.unionByName(linked)
    if file_bonds is not None:
        bonds = bonds.unionByName(file_bonds.select(*where, "a", "b"))
    return drop_cross_conformer(bonds, atoms) if "altloc_id" in atoms.columns else bonds


def neighbor(x: DataFrame, bonds: DataFrame) -> DataFrame:
    """Keys of the atoms bonded to ``x``, ``x`` itself left out."""
    where = _where(bonds)
    here = x.select(*where, F.col("atom_id").alias("src"))
    found = both_ways(bonds).join(here, [*where, "src"], "left_semi")
    found = found.select(*where, F.col("dst").alias("atom_id")).distinct()
    return found.join(x.select(*where, "atom_id"), [*where, "atom_id"], "left_anti")


bound_to = neighbor


def extend(x: DataFrame, bonds: DataFrame, n: int) -> DataFrame:
    """Keys of ``x`` and everything reachable over at most ``n`` bonds.

    Each round walks one bond on from the newest atoms only. Short walks stay
    one lazy plan; longer ones cut the lineage each round and stop as soon as a
    round finds nothing new.
    """
    if not (isinstance(n, int) and n >= 1):
        raise ValueError(f"extend takes a whole number of bonds from 1 on, got {n!r}")
    where = _where(bonds)
    key = [*where, "atom_id"]
    edges = both_ways(bonds)
    known = frontier = x.select(*key).distinct()
    looping = n > _UNROLLED
    if looping:
        edges, known = cut_lineage(edges), cut_lineage(known)
        frontier = known
    # bonds lead both ways: from the newest atoms they reach these, the ones before them and new ones only
    late = frontier
    for _ in range(n):
        step = edges.join(frontier.withColumnRenamed("atom_id", "src").hint("merge"), [*where, "src"])
        step = step.select(*where, F.col("dst").alias("atom_id")).distinct()
        before, frontier = frontier, step.join(late.hint("merge"), key, "left_anti")
        if looping:
            frontier = cut_lineage(frontier)
            if frontier.isEmpty():
                break
        late = before.union(frontier)
        known = known.union(frontier)
    return known


def _roots(edges: DataFrame, group: list[str]) -> DataFrame:
    """``group``, v and _root of every vertex that hangs on a smaller one.

    Atoms that are bonded have near numbers: edges are dealt by blocks of numbers, so that
    the forests inside tasks settle nearly all of them before the first round.
    """
    if all(isinstance(edges.schema[c].dataType, T.IntegralType) for c in ("src", "dst")):
        block = F.floor(F.least("src", "dst") / F.lit(float(BLOCK)))
        n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        edges = edges.repartition(n, *group, block)
    end = lambda c: F.struct(*group, F.col(c).alias("v")).alias(c)
    roots = component_roots(edges.select(end("src"), end("dst")), "src", "dst")
    return roots.select(*[F.col(f"node.{c}").alias(c) for c in (*group, "v")], F.col("root.v").alias("_root"))


def _component(vertices: DataFrame, roots: DataFrame, group: list[str], name: str) -> DataFrame:
    """Vertices with the smallest of their component; roots are as many as vertices, whatever their file says."""
    placed = vertices.join(roots.hint("merge"), [*group, "v"], "left")
    return placed.select(*group, "v", F.coalesce("_root", "v").alias(name))


def connected_components(vertices: DataFrame, edges: DataFrame, group: list[str]) -> DataFrame:
    """Smallest vertex of the component of each vertex, as ``component``.

    ``vertices`` holds ``group`` and v, ``edges`` holds ``group``, src and dst, in one
    direction or both. Only edges take part in the rounds; see ``component_roots``.
    """
    return _component(vertices.select(*group, "v"), _roots(edges, group), group, "component")


def _molecule_roots(bonds: DataFrame) -> DataFrame:
    where = _where(bonds)
    return _roots(bonds.select(*where, F.col("a").alias("src"), F.col("b").alias("dst")), where)


def molecules(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """The molecule of every atom, named by its smallest atom id."""
    where = _where(bonds)
    vertices = atoms.select(*where, F.col("atom_id").alias("v"))
    return _component(vertices, _molecule_roots(bonds), where, "molecule").withColumnRenamed("v", "atom_id")


def bymolecule(atoms: DataFrame, x: DataFrame, bonds: DataFrame) -> DataFrame:
    """Keys of all atoms of every molecule that ``x`` touches."""
    where = _where(bonds)
    key = [*where, "atom_id"]
    roots = _molecule_roots(bonds)
    every, some = (d.select(*where, F.col("atom_id").alias("v")) for d in (atoms, x))
    # an atom of ``x`` that is not among ``atoms`` touches nothing
    some = some.join(every.hint("merge"), [*where, "v"], "left_semi")
    touched = _component(some, roots, where, "molecule").select(*where, "molecule").distinct()
    labels = _component(every, roots, where, "molecule").withColumnRenamed("v", "atom_id")
    return labels.join(touched.hint("merge"), [*where, "molecule"], "left_semi").select(*key)


def pharmacophore(
    atoms: DataFrame, x: DataFrame, bonds: DataFrame, strict: bool = False
) -> DataFrame:
    """What each atom of ``x`` can do: donor, acceptor, both, hydrophobe.

    Atoms that fit no class (other elements, carbons next to N or O) are left
    out. ``strict`` refuses a set in which nothing is bonded at all.
    """
    where = _where(bonds)
    key = [*where, "atom_id"]
    wanted = x.select(*key)
    ends = both_ways(bonds).withColumnRenamed("src", "atom_id").join(wanted, key, "left_semi")
    if strict and ends.isEmpty():
        raise ValueError("nothing here is bonded, so there is no connectivity to type from")
    symbol = F.upper("element")
    other = atoms.select(*where, F.col("atom_id").alias("dst"), symbol.alias("_e"))
    heavy = ends.join(other, [*where, "dst"]).filter(F.col("_e") != "H").groupBy(*key).agg(
        F.count("*").alias("_heavy"), F.max(F.col("_e").isin("N", "O")).alias("_polar")
    )
    typed = atoms.select(*key, symbol.alias("_e")).join(wanted, key, "left_semi")
    n = F.coalesce("_heavy", F.lit(0))
    greasy = F.col("_e").isin("C", "S", "F", "CL", "BR", "I")
    beside_polar = (F.col("_e") == "C") & F.coalesce("_polar", F.lit(False))
    feature = (
        F.when(F.col("_e") == "O", F.when(n <= 1, "both").otherwise("acceptor"))
        .when(F.col("_e") == "N", F.when(n >= 3, "acceptor").otherwise("donor"))
        .when(greasy & ~beside_polar, "hydrophobe")
    )
    found = typed.join(heavy, key, "left").withColumn("feature", feature)
    return found.filter(F.col("feature").isNotNull()).select(*key, "feature")


def feature_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("structure_id", "feature").agg(F.count("*").alias("n"))
