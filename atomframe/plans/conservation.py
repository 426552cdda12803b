"""Chain sequences, alignment entropy and what is derived from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scales import FULL, rescale
from ..operators import predicates as P
from ..operators.quantiles import exact_percentiles
from ..operators.spatial import attach_field
from ..scaling import running_index, top_k

# fixed values
MIN_DEPTH, SHALLOW, MIN_SEQUENCE, DIGEST = 2, 10, 10, 32
MODIFIED_LETTERS = {
    "MSE": "M", "SEP": "S", "TPO": "T", "PTR": "Y", "CSO": "C", "CME": "C", "OCS": "C",
    "CSS": "C", "CSD": "C", "KCX": "K", "LLP": "K", "MLY": "K", "M3L": "K", "MLZ": "K",
    "ALY": "K", "HYP": "P", "PCA": "Q", "FME": "M", "HIC": "H", "TYS": "Y", "CGU": "E",
    "SEC": "U", "PYL": "O", "ASX": "B", "GLX": "Z",
}
RESIDUE = ["structure_id", "chain_id", "res_id", "ins_code"]
PIECE = 4096
CHAIN = ["msa_id", "structure_id", "chain_id"]
OK, NO_ALIGNMENT, TOO_SHALLOW, TOO_FEW_COLUMNS = "ok", "no alignment", "too shallow", "too few columns"


def one_letter(c: Column) -> Column:
    letters = {**S.ONE_LETTER, **MODIFIED_LETTERS}
    table = F.create_map(*[F.lit(x) for item in letters.items() for x in item])
    return F.coalesce(F.try_element_at(table, c), F.lit("X"))


def chain_sequence(atoms: DataFrame, chain: str | None = None, strict: bool = False) -> DataFrame:
    """One row per amino residue of each chain: ``pos`` (0-based), ``letter`` and identity."""
    S.require(atoms, *RESIDUE, "res_name")
    held = atoms.filter(P.is_class("protein"))
    if chain is not None:
        held = held.filter(F.col("chain_id") == chain)
    if strict and held.isEmpty():
        raise ValueError(f"no amino acids in chain {chain!r}; chains present: {P.chains_listed(atoms)}")
    order = F.struct(*S.file_order(atoms))
    residues = held.groupBy(*RESIDUE).agg(
        F.min(S.rank_column(atoms)).alias("_first"), F.min_by("res_name", order).alias("res_name")
    )
    numbered = running_index(residues, ["structure_id", "chain_id"], "_first", "pos")
    return numbered.select(*RESIDUE, "res_name", "pos", one_letter(F.col("res_name")).alias("letter"))


def sequence_text(sequence: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The letters of each chain as one string, put together from bounded pieces."""
    group = group or ["structure_id", "chain_id"]
    piece = F.floor(F.col("pos") / PIECE).cast("long").alias("piece")
    pieces = sequence.groupBy(*group, piece).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda s: s.letter), ""
        ).alias("text"),
        F.count("*").alias("n"),
    )
    return pieces.groupBy(*group).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda s: s.text), ""
        ).alias("sequence"),
        F.sum("n").alias("length"),
    )


def msa_worklist(
    sequences: DataFrame, done: DataFrame | None, mode: str = "env", force_refresh: bool = False
) -> DataFrame:
    """Distinct sequences still to be aligned, keyed by a digest of mode and sequence."""
    digest = F.substring(F.sha2(F.concat(F.lit(mode + "\n"), F.col("sequence")), 256), 1, DIGEST)
    todo = sequences.filter(F.length("sequence") >= MIN_SEQUENCE)
    todo = todo.select("sequence", digest.alias("key")).dropDuplicates(["key"])
    if done is None or force_refresh:
        return todo
    return todo.join(done.select("key"), "key", "left_anti")


def column_entropy(msa: DataFrame) -> DataFrame:
    """Entropy of every alignment column over the twenty letters, 0 to 1.

    Gaps and other signs do not count; a column without letters scores 1. The
    columns are those of the first sequence. Counting per letter comes first,
    so at most 21 rows per column reach the second step.
    """
    letter = F.upper("letter")
    known = F.when(letter.isin(list(S.AMINO_LETTERS)), letter)
    counts = msa.groupBy("msa_id", "col", known.alias("_l")).agg(
        F.count("*").alias("_n"), F.min("seq_idx").alias("_seq")
    )
    n = F.when(F.col("_l").isNotNull(), F.col("_n"))
    columns = counts.groupBy("msa_id", "col").agg(
        F.sum(n).alias("_total"),
        F.max(n).alias("_top"),
        F.sum(n * F.log2(n.cast("double"))).alias("_nlogn"),
        F.min("_seq").alias("_seq"),
    )
    first = columns.groupBy("msa_id").agg(F.min("_seq").alias("_seq"))
    total = F.col("_total").cast("double")
    spread = (F.log2(total) - F.col("_nlogn") / total) / F.lit(math.log2(20))
    entropy = (
        F.when(F.col("_total").isNull(), 1.0)
        .when(F.col("_top") == F.col("_total"), 0.0)
        .otherwise(spread)
    )
    return columns.join(first, ["msa_id", "_seq"]).select("msa_id", "col", entropy.alias("entropy"))


def msa_depth(msa: DataFrame) -> DataFrame:
    return msa.groupBy("msa_id").agg(F.countDistinct("seq_idx").alias("depth"))


def conservation_status(
    sequence: DataFrame, entropy: DataFrame, depth: DataFrame, min_depth: int = MIN_DEPTH
) -> DataFrame:
    """One row per chain of ``sequence``: its size, its alignment's and whether that can score it."""
    sizes = sequence.groupBy(*CHAIN).agg(F.count("*").alias("residues"))
    columns = entropy.groupBy("msa_id").agg(F.count("*").alias("columns"))
    checked = sizes.join(columns, "msa_id", "left").join(depth, "msa_id", "left")
    status = (
        F.when(F.col("depth").isNull() | F.col("columns").isNull(), NO_ALIGNMENT)
        .when(F.col("depth") < min_depth, TOO_SHALLOW)
        .when(F.col("columns") < F.col("residues"), TOO_FEW_COLUMNS)
        .otherwise(OK)
    )
    return checked.select(*CHAIN, "residues", "columns", "depth", status.alias("status"))


def score_conservation(
    sequence: DataFrame,
    entropy: DataFrame,
    depth: DataFrame,
    min_depth: int = MIN_DEPTH,
    strict: bool = False,
) -> DataFrame:
    """Entropy column i onto residue i; ``sequence`` carries the msa_id of its chain.

    Chains whose alignment is missing, too shallow or shorter than the chain get
    no scores; ``conservation_status`` lists them, ``strict`` refuses them.
    """
    checked = conservation_status(sequence, entropy, depth, min_depth)
    if strict:
        bad = checked.filter(F.col("status") != OK).limit(1).collect()
        if bad:
            raise ValueError(f"alignment cannot score its chain: {bad[0].asDict()}")
    good = checked.filter(F.col("status") == OK).select(*CHAIN, "depth")
    scored = sequence.join(good, CHAIN).join(
        entropy.withColumnRenamed("col", "pos"), ["msa_id", "pos"]
    )
    return scored.withColumn("conservation", F.lit(1.0) - F.col("entropy"))


def conservation_report(scores: DataFrame, status: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Counts, depth, entropy range and a shallow-alignment flag per chain.

    With ``conservation_status`` also the chains without scores, and why. With the ``limit``
    of a listing, ``truncated`` tells whether the chain has more residues than it lists.
    """
    if limit is not None:
        report = conservation_report(scores, status)
        return report.withColumn("truncated", F.col("residues_scored") > limit)
    report = scores.groupBy("structure_id", "chain_id").agg(
        F.count("*").alias("residues_scored"),
        F.max("depth").alias("depth"),
        F.min("entropy").alias("entropy_min"),
        F.max("entropy").alias("entropy_max"),
        (F.max("depth") < SHALLOW).alias("shallow"),
    )
    if status is None:
        return report
    chains = status.select("structure_id", "chain_id", F.col("depth").alias("_depth"), "status")
    full = chains.join(report, ["structure_id", "chain_id"], "left")
    return full.select(
        "structure_id", "chain_id", F.coalesce("residues_scored", F.lit(0)).alias("residues_scored"),
        F.col("_depth").alias("depth"), "entropy_min", "entropy_max",
        (F.col("_depth") < SHALLOW).alias("shallow"), "status",
    )


def conservation_listing(scores: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` residues of each chain's report."""
    return top_k(scores, ["structure_id", "chain_id"], [F.col("pos")], limit).drop("place")


def percentile_sets(
    scores: DataFrame, lo: float = 25, hi: float = 75, group: list[str] | None = None
) -> DataFrame:
    """Residues at or below the ``lo`` percentile of entropy (conserved) or at or above
    the ``hi`` one (variable), per chain; a residue can be in both."""
    group = group or ["structure_id", "chain_id"]
    cuts = exact_percentiles(scores, group, "entropy", {"low": lo, "high": hi})
    joined = scores.join(cuts, group)
    sets = F.array_compact(
        F.array(
            F.when(F.col("entropy") <= F.col("low"), F.lit("conserved")),
            F.when(F.col("entropy") >= F.col("high"), F.lit("variable")),
        )
    )
    return joined.withColumn("set", F.explode(sets))


def entropy_bands(scores: DataFrame, bins: int = 7, group: list[str] | None = None) -> DataFrame:
    """Equal-width bands from the least to the greatest entropy of each chain.

    Bands are half-open, the last one closed; ``band`` is 0 for the most
    conserved one, ``low`` and ``high`` are its edges.
    """
    if bins < 2:
        raise ValueError(f"bins must be at least 2, got {bins}")
    group = group or ["structure_id", "chain_id"]
    span = scores.groupBy(*group).agg(F.min("entropy").alias("_lo"), F.max("entropy").alias("_hi"))
    joined = scores.join(span, group)
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    # the band edges are lo + i * step, so compare with the edges themselves
    over = F.lit(0)
    for i in range(1, bins):
        over = over + (F.col("entropy") >= F.col("_lo") + F.lit(float(i)) * step).cast("int")
    edge = lambda i: F.col("_lo") + i.cast("double") * step
    high = F.when(F.col("band") == bins - 1, F.col("_hi")).otherwise(edge(F.col("band") + 1))
    return joined.withColumn("band", over).withColumns({"low": edge(F.col("band")), "high": high}).drop("_lo", "_hi")


def value_column(
    atoms: DataFrame, scores: DataFrame, value: str = "entropy", mode: str = "relative"
) -> DataFrame:
    """Per-residue values as a 0..100 atom column ``shown``; unscored residues get 100.

    The measured ``b_factor`` stays as it is.
    """
    chain = ["structure_id", "chain_id"]
    span = scores.groupBy(*chain).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = scores.join(span, chain).withColumn(
        "shown", rescale(F.col(value), F.col("_lo"), F.col("_hi"), mode)
    )
    return attach_field(atoms, scaled, "shown", FULL)
