"""Contact kinds, hydrogen-bond energy and atom radii as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

# fixed values: cut-offs in angstroms and the electrostatic factor in kcal A / mol
POLAR_CUTOFF = 3.5
SALT_BRIDGE_CUTOFF = 4.0
Q1Q2F = 0.42 * 0.20 * 332.0
CLASH, CLASH_ENERGY = 0.5, -9.9


def _among(pairs: list[tuple[str, str]], residue: str, atom: str) -> Column:
    names = F.concat_ws(".", residue, atom)
    return names.isin([f"{r}.{a}" for r, a in pairs])


def charged_pair(a: str = "a_", b: str = "b_") -> Column:
    """One end anionic, the other cationic."""

    def test(pairs, p):
        return _among(pairs, f"{p}res_name", f"{p}atom_name")

    return (test(S.ANIONIC, a) & test(S.CATIONIC, b)) | (test(S.CATIONIC, a) & test(S.ANIONIC, b))


def contact_kind(distance: Column, hydrogen_bonded: Column | None = None) -> Column:
    """salt_bridge before hydrogen_bond before polar_contact; null if none applies."""
    # the element test lets a blank element pass, as membership in the text "NO" does
    polar = F.col("a_element").isin("N", "O", "NO", "") & F.col("b_element").isin("N", "O", "NO", "")
    kind = F.when(charged_pair() & (distance <= SALT_BRIDGE_CUTOFF), "salt_bridge")
    if hydrogen_bonded is not None:
        kind = kind.when(hydrogen_bonded, "hydrogen_bond")
    return kind.when(polar & (distance <= POLAR_CUTOFF), "polar_contact")


def hbond_energy(r_on: Column, r_ch: Column, r_oh: Column, r_cn: Column) -> Column:
    clashed = F.least(r_on, r_ch, r_oh, r_cn) < CLASH
    free = F.lit(Q1Q2F) * (
        F.lit(1.0) / r_on + F.lit(1.0) / r_ch - F.lit(1.0) / r_oh - F.lit(1.0) / r_cn
    )
    return F.when(clashed, F.lit(CLASH_ENERGY)).otherwise(free)


def is_ion() -> Column:
    """A residue named after its own single metal or halogen, charge or count digits allowed (FE2, 3CO)."""
    symbol = F.upper("element")
    bare = F.regexp_replace(F.upper("res_name"), "^[0-9]+|[0-9]+$", "")
    return (bare == symbol) & symbol.isin([*S.METALS, "F", "CL", "BR", "I"])


def vdw_radius() -> Column:
    """United-atom radius; null for hydrogens, solvent and ions, which have no area."""
    name = F.concat_ws(".", "res_name", "atom_name")
    element = F.upper("element")
    bare_c = name.isin(S.TRIGONAL_BARE) | (F.col("atom_name") == "C")
    ion = (F.upper("res_name") == element) | is_ion()
    return (
        F.when(element.isin(S.HYDROGENS) | F.col("res_name").isin(S.SOLVENT) | ion, None)
        .when((element == "C") & bare_c, S.R_C3H0)
        .when((element == "C") & name.isin(S.TRIGONAL_CH), S.R_C3H1)
        .when(element == "C", S.R_C4)
        .when(element == "N", S.R_N)
        .when((element == "O") & (name.isin(S.HYDROXYLS) | (F.col("atom_name") == "OXT")), S.R_O2H1)
        .when(element == "O", S.R_O1)
        .when(element == "S", S.R_S)
        .otherwise(S.R_OTHER)
        .cast("double")
    )
