"""Column layout of the tables and the chemistry vocabulary the operators share.

``sym_id`` is either absent (no symmetry copies) or a non-null 0-based integer,
``altloc_id`` is ``'.'`` for an atom without alternate positions, ``ins_code``
is ``''`` when there is none. Keeping these three non-null lets every key join
stay a plain equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATOMS = T.StructType(
    [
        T.StructField("structure_id", T.StringType()),
        T.StructField("rank", T.LongType()),
        T.StructField("atom_id", T.LongType()),
        T.StructField("chain_id", T.StringType()),
        T.StructField("res_id", T.IntegerType()),
        T.StructField("ins_code", T.StringType()),
        T.StructField("res_name", T.StringType()),
        T.StructField("atom_name", T.StringType()),
        T.StructField("element", T.StringType()),
        T.StructField("hetero", T.BooleanType()),
        T.StructField("altloc_id", T.StringType()),
        T.StructField("occupancy", T.DoubleType()),
        T.StructField("b_factor", T.DoubleType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
    ]
)

NO_ALTLOC = "."

# ---------------------------------------------------------------- fixed values
# Chemistry vocabulary: these must hold exactly these values for right answers.
ELEMENTS = (
    "H HE LI BE B C N O F NE NA MG AL SI P S CL AR K CA SC TI V CR MN FE CO NI CU ZN "
    "GA GE AS SE BR KR RB SR Y ZR NB MO TC RU RH PD AG CD IN SN SB TE I XE CS BA LA CE "
    "PR ND PM SM EU GD TB DY HO ER TM YB LU HF TA W RE OS IR PT AU HG TL PB BI PO AT RN "
    "FR RA AC TH PA U NP PU AM CM BK CF ES FM MD NO LR RF DB SG BH HS MT DS RG CN NH FL "
    "MC LV TS OG D T"
).split()
METALS = (
    "LI BE NA MG AL K CA SC TI V CR MN FE CO NI CU ZN GA RB SR Y ZR NB MO TC RU RH PD AG "
    "CD IN SN CS BA LA HF TA W RE OS IR PT AU HG TL PB BI"
).split()
HYDROGENS = ["H", "D"]
PROTEIN_BACKBONE = ["N", "CA", "C", "O", "OXT"]
PHOSPHATE = ["P", "OP1", "OP2", "OP3", "O1P", "O2P", "O3P"]
SUGAR_STEMS = ["O5", "C5", "C4", "O4", "C3", "O3", "C2", "O2", "C1"]
NUCLEIC_BACKBONE = PHOSPHATE + [s + p for s in SUGAR_STEMS for p in ("'", "*")]
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E",
    "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F",
    "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
AMINO_LETTERS = "ACDEFGHIKLMNPQRSTVWY"
MODIFIED_AMINO = (
    "MSE SEC PYL ASX GLX UNK SEP TPO PTR CSO CME CSD OCS CSS KCX LLP MLY M3L MLZ ALY HYP "
    "PCA FME HIC NEP TYS SAC CGU DAL DSN DCY ORN NLE ABA AIB SAR"
).split()
AMINO_ACIDS = list(ONE_LETTER) + MODIFIED_AMINO
NUCLEOTIDES = "A C G U I N DA DC DG DT DU DI PSU 5MC 5MU H2U 1MA 2MG 7MG OMC OMG 4SU".split()
SOLVENT = "HOH SOL WAT DOD".split()
CARBOHYDRATES = (
    "NAG NDG NGA A2G BMA MAN GLC BGC GAL GLA FUC FUL SIA SLB XYS XYP RIB ARA RAM FRU SUC "
    "LAC MAL TRE GCU BDP IDR GTR SGN NGS"
).split()
ANIONIC = [("ASP", "OD1"), ("ASP", "OD2"), ("GLU", "OE1"), ("GLU", "OE2")]
CATIONIC = [
    ("ARG", "NE"), ("ARG", "NH1"), ("ARG", "NH2"),
    ("LYS", "NZ"), ("HIS", "ND1"), ("HIS", "NE2"),
]
# Secondary-structure spelling -> the assigned classes it stands for.
SS_SPELLINGS = {
    "H": "HGI", "HELIX": "HGI", "ALPHA": "H", "HELIX_ALPHA": "H",
    "G": "G", "310": "G", "3-10": "G", "HELIX_310": "G",
    "I": "I", "PI": "I", "HELIX_PI": "I",
    "S": "EB", "E": "EB", "SHEET": "EB", "STRAND": "EB",
    "EXTENDED": "E", "B": "B", "BRIDGE": "B",
    "T": "T", "TURN": "T", "BEND": "S",
    "L": "TS-", "C": "TS-", "LOOP": "TS-", "COIL": "TS-",
}
# ProtOr united-atom radii (Tsai et al. 1999): trigonal carbons without and with
# a hydrogen, tetrahedral carbons, nitrogen, carbonyl and hydroxyl oxygen, sulfur.
R_C3H0, R_C3H1, R_C4, R_N, R_O1, R_O2H1, R_S = 1.61, 1.76, 1.88, 1.64, 1.42, 1.46, 1.77
R_OTHER = 1.8
TRIGONAL_BARE = (
    "ARG.CZ ASN.CG ASP.CG GLN.CD GLU.CD HIS.CG PHE.CG TRP.CG TRP.CD2 TRP.CE2 TYR.CG TYR.CZ"
).split()
TRIGONAL_CH = (
    "HIS.CD2 HIS.CE1 PHE.CD1 PHE.CD2 PHE.CE1 PHE.CE2 PHE.CZ TRP.CD1 TRP.CE3 TRP.CZ2 "
    "TRP.CZ3 TRP.CH2 TYR.CD1 TYR.CD2 TYR.CE1 TYR.CE2"
).split()
HYDROXYLS = ["SER.OG", "THR.OG1", "TYR.OH"]
# ------------------------------------------------------------ end fixed values


def require(df: DataFrame, *names: str) -> DataFrame:
    """Refuse a table that lacks a column, rather than answer with an empty set."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"this table has no {', '.join(map(repr, missing))} column")
    return df


def positive(value: float, what: str) -> float:
    """A finite number above zero, or an error naming the parameter."""
    number = float(value)
    if not (0.0 < number < float("inf")):
        raise ValueError(f"{what} must be a finite number above 0, got {value!r}")
    return number


def has_copies(df: DataFrame) -> bool:
    return "sym_id" in df.columns


def atom_key(df: DataFrame) -> list[str]:
    """The columns that name one atom."""
    return ["structure_id", "sym_id", "atom_id"] if has_copies(df) else ["structure_id", "atom_id"]


def residue_key(df: DataFrame) -> list[str]:
    """The columns that name one residue; the alternate letter is not one of them."""
    key = ["structure_id", "chain_id", "res_id", "ins_code"]
    return key + ["sym_id"] if has_copies(df) else key


def site_key(df: DataFrame) -> list[str]:
    """The columns that name one physical atom position with all its alternates."""
    return residue_key(df) + ["atom_name"]


def rank_column(df: DataFrame) -> str:
    """The integer that orders the atoms of one copy of a structure."""
    return "rank" if "rank" in df.columns else "atom_id"


def file_order(df: DataFrame) -> list[str]:
    """The columns that order the atoms of a structure: copy after copy, in file order."""
    return (["sym_id"] if has_copies(df) else []) + list(dict.fromkeys([rank_column(df), "atom_id"]))


def label(*names: str) -> Column:
    return F.concat_ws("|", *[F.col(n).cast("string") for n in names])
