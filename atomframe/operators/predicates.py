"""Atom predicates: column expressions that ``filter`` and ``&``/``|``/``~`` combine.

Vocabulary that is closed (element symbols, class words, helix words) is
refused when it is unknown; a known word that matches nothing is an honest
empty answer.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.chemistry import is_ion
from ..scaling import top_k

#: Names an error message lists before it says how many more there are.
SHOWN = 50

Terms = Iterable[str | int]

# fixed values: other spellings of the class words
ALIASES = {
    "*": "all", "water": "solvent", "het": "hetatm", "org": "organic", "ino": "inorganic",
    "bb.": "backbone", "sc.": "sidechain", "h.": "hydro", "hydrogens": "hydro",
    "polymer.protein": "protein", "polymer.nucleic": "nucleic", "ligand": "organic",
}


def _resn_in(names: list[str]) -> Column:
    return F.col("res_name").isin(names)


def _protein() -> Column:
    return _resn_in(S.AMINO_ACIDS)


def _nucleic() -> Column:
    return _resn_in(S.NUCLEOTIDES)


def _backbone() -> Column:
    name = F.col("atom_name")
    return (_protein() & name.isin(S.PROTEIN_BACKBONE)) | (
        _nucleic() & name.isin(S.NUCLEIC_BACKBONE)
    )


def _hetero_not_solvent() -> Column:
    return F.col("hetero") & ~_resn_in(S.SOLVENT)


CLASSES = {
    "all": lambda: F.lit(True),
    "none": lambda: F.lit(False),
    "protein": _protein,
    "nucleic": _nucleic,
    "polymer": lambda: _protein() | _nucleic(),
    "solvent": lambda: _resn_in(S.SOLVENT),
    "hetatm": lambda: F.col("hetero"),
    "backbone": _backbone,
    "sidechain": lambda: (_protein() | _nucleic()) & ~_backbone(),
    "hydro": lambda: F.col("element").isin(S.HYDROGENS),
    "metals": lambda: F.upper("element").isin(S.METALS),
    "glycan": lambda: _resn_in(S.CARBOHYDRATES),
    "ion": is_ion,
    # these two need the residue-level flag that ``classify`` adds
    "organic": lambda: _hetero_not_solvent() & F.col("residue_has_carbon"),
    "inorganic": lambda: _hetero_not_solvent() & ~F.col("residue_has_carbon"),
}


def is_class(word: str) -> Column:
    """The class a word names; ``organic``/``inorganic`` need ``classify`` first."""
    name = ALIASES.get(word, word)
    if name not in CLASSES:
        known = ", ".join(sorted([*CLASSES, *ALIASES]))
        raise ValueError(f"unknown class {word!r}; known: {known}")
    return CLASSES[name]()


def classify(atoms: DataFrame) -> DataFrame:
    """Add ``residue_has_carbon``, true for hetero residues that hold a carbon.

    Only the keys of carbon-bearing hetero residues travel; polymer atoms never
    enter the aggregation.
    """
    S.require(atoms, "hetero", "element", "res_name")
    key = S.residue_key(atoms)
    carbon = (
        atoms.filter(_hetero_not_solvent() & (F.col("element") == "C"))
        .select(*key)
        .distinct()
        .withColumn("_c", F.lit(True))
    )
    return (
        atoms.join(carbon, key, "left")
        .withColumn("residue_has_carbon", F.coalesce("_c", F.lit(False)))
        .drop("_c")
    )


def chain(*ids: str) -> Column:
    return F.col("chain_id").isin(list(ids))


segi = chain


def _any_case(column: str, values: Iterable[str]) -> Column:
    return F.upper(column).isin([v.upper() for v in values])


def resn(*names: str) -> Column:
    return _any_case("res_name", names)


def name(*names: str) -> Column:
    return _any_case("atom_name", names)


def elem(*symbols: str, atoms: DataFrame | None = None) -> Column:
    """Element symbols. An unknown one is refused unless ``atoms`` really holds it."""
    wanted = [s.upper() for s in symbols]
    unknown = [s for s in wanted if s not in S.ELEMENTS]
    if unknown and atoms is not None:
        seen = atoms.filter(_any_case("element", unknown)).select(F.upper("element")).distinct()
        held = {row[0] for row in seen.limit(len(unknown)).collect()}
        unknown = [s for s in unknown if s not in held]
    if unknown:
        near = difflib.get_close_matches(unknown[0], S.ELEMENTS, n=1)
        hint = f"; did you mean {near[0]!r}?" if near else ""
        raise ValueError(f"no such element: {', '.join(map(repr, unknown))}{hint}")
    return _any_case("element", wanted)


def _terms(column: Column, terms: Terms, coded: bool = False) -> Column:
    """OR of integers, inclusive ``a-b`` ranges and, for residues, ``52A`` codes."""
    hit = F.lit(False)
    for term in map(str, terms):
        if m := re.fullmatch(r"(-?\d+)-(-?\d+)", term):
            hit = hit | column.between(int(m[1]), int(m[2]))
        elif re.fullmatch(r"\s*[-+]?\d+\s*", term):
            hit = hit | (column == int(term))
        elif coded and (m := re.fullmatch(r"(-?\d+)([A-Za-z])", term)):
            hit = hit | ((column == int(m[1])) & (F.upper("ins_code") == m[2].upper()))
        else:
            raise ValueError(f"expected an integer, a range or a residue code, got {term!r}")
    return hit


def resi(*terms: str | int) -> Column:
    return _terms(F.col("res_id"), terms, coded=True)


def index(*terms: str | int) -> Column:
    return _terms(F.col("atom_id"), terms)


def rank(*terms: str | int) -> Column:
    return _terms(F.col("rank"), terms)


def sym(atoms: DataFrame, *terms: str | int) -> Column:
    """Symmetry copies by number; refused on a table that holds no copies."""
    S.require(atoms, "sym_id")
    return _terms(F.col("sym_id"), terms)


def alt_value(value: str) -> str:
    """One alternate letter as stored: quotes off, blank spellings become ``'.'``."""
    bare = value.strip("\"'")
    return S.NO_ALTLOC if bare in ("", " ", S.NO_ALTLOC) else bare


def alt(*letters: str, atoms: DataFrame | None = None) -> Column:
    """Atoms carrying exactly these alternate letters.

    With ``atoms`` given, a letter asked of a collection in which no structure
    has alternates is refused.
    """
    wanted = [alt_value(v) for v in letters]
    named = sorted({v for v in wanted if v != S.NO_ALTLOC})
    if atoms is not None and "altloc_id" not in atoms.columns:
        if named:
            raise ValueError(f"no atom has an alternate position, so there is no {named[0]!r}")
        return F.lit(True)
    if atoms is not None and named and atoms.filter(F.col("altloc_id") != S.NO_ALTLOC).isEmpty():
        raise ValueError(f"no atom has an alternate position, so there is no {named[0]!r}")
    return F.col("altloc_id").isin(wanted)


def ss(*words: str) -> Column:
    """Secondary-structure words over the ``ss`` column of ``secondary_structure``."""
    wanted: set[str] = set()
    for word in words:
        if word.upper() not in S.SS_SPELLINGS:
            known = ", ".join(sorted(S.SS_SPELLINGS))
            raise ValueError(f"unknown secondary structure {word!r}; known: {known}")
        wanted |= set(S.SS_SPELLINGS[word.upper()])
    return F.coalesce(F.col("ss").isin(sorted(wanted)), F.lit(False))


def compare(atoms: DataFrame, prop: str, op: str, value: float) -> Column:
    """``b`` (temperature factor) or ``q`` (occupancy) against a number."""
    columns = {"b": "b_factor", "q": "occupancy"}
    if prop not in columns:
        raise ValueError(f"only b and q compare with numbers, got {prop!r}")
    S.require(atoms, columns[prop])
    left, right = F.col(columns[prop]), F.lit(float(value))
    tests = {
        "<": left < right, ">": left > right, "<=": left <= right,
        ">=": left >= right, "=": left == right, "!=": left != right,
    }
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}; known: {' '.join(tests)}")
    return tests[op]


def first(atoms: DataFrame) -> DataFrame:
    """The earliest atom of each structure."""
    order = [F.col(c) for c in S.file_order(atoms)]
    return top_k(atoms, ["structure_id"], order, 1).drop("place")


def in_residues(atoms: DataFrame, residues: DataFrame) -> DataFrame:
    """Atoms of an explicit (chain_id, res_id, ins_code) list; an empty list is empty."""
    key = [c for c in ("structure_id", "chain_id", "res_id", "ins_code") if c in residues.columns]
    return atoms.join(residues.select(*key), key, "left_semi")


def require_residue(atoms: DataFrame, residue: str) -> DataFrame:
    """Atoms of one residue name, or an error listing the hetero names there are."""
    hits = atoms.filter(F.col("res_name") == residue.upper())
    if hits.isEmpty():
        listed = _listed(hetero_names(atoms), "res_name")
        raise ValueError(f"no residue {residue!r}; hetero residues present: {listed or 'none'}")
    return hits


def _listed(rows: DataFrame, column: str) -> str:
    """The first names of a column for an error message, and how many more there are."""
    names = rows.select(column).distinct()
    shown = [str(r[0]) for r in names.orderBy(column).limit(SHOWN).collect()]
    more = names.count() - len(shown)
    return ", ".join(shown) + (f" and {more} more" if more else "")


def chains_listed(atoms: DataFrame) -> str:
    return _listed(atoms, "chain_id")


def hetero_names(atoms: DataFrame) -> DataFrame:
    """Hetero residue names per structure, waters left out."""
    return atoms.filter(_hetero_not_solvent()).select("structure_id", "res_name").distinct()


def check_mutations(atoms: DataFrame, mutations: str, chain_id: str | None = None) -> DataFrame:
    """Check a list such as ``A50G,K12R`` against the residues at those positions.

    One row per structure and mutation: ``verified``, ``found`` (names at that
    position, joined by '/'), and ``status``.
    """
    letters = {one: three for three, one in S.ONE_LETTER.items()}
    parsed = []
    for text in (t.strip().upper() for t in mutations.split(",")):
        m = re.fullmatch(r"([A-Z])(\d+)([A-Z])", text)
        if not m or m[1] not in letters or m[3] not in letters:
            raise ValueError(f"{text!r} is not a mutation such as A50G")
        parsed.append((text, letters[m[1]], int(m[2])))
    held = atoms if chain_id is None else atoms.filter(F.col("chain_id") == chain_id)
    here = held.filter(F.col("res_id").isin([p[2] for p in parsed]))
    found = here.groupBy("structure_id", "res_id").agg(
        F.sort_array(F.collect_set("res_name")).alias("names")
    )
    # one row per structure and asked-for mutation: the list comes from the caller
    asked = held.select("structure_id").distinct().withColumn(
        "m",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(t).alias("mutation"),
                        F.lit(o).alias("original"),
                        F.lit(n).alias("res_id"),
                    )
                    for t, o, n in parsed
                ]
            )
        ),
    ).select("structure_id", "m.*")
    return asked.join(found, ["structure_id", "res_id"], "left").select(
        "structure_id",
        "mutation",
        "res_id",
        F.coalesce(F.array_join("names", "/"), F.lit("")).alias("found"),
        F.when(F.col("names").isNull(), "missing")
        .when(F.col("names") == F.array("original"), "verified")
        .otherwise("mismatch")
        .alias("status"),
    )
