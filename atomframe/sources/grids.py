"""Alignments (A3M), charges (PQR) and grids (OpenDX) as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scaling import cut_lineage, running_index, running_total
from .lines import read_lines, refuse, stem
from .structures import PART_LINES, write_lines

AXES = "xyz"


def parse_a3m(lines: DataFrame) -> DataFrame:
    """MSA letters (msa_id, seq_idx, col, letter), insertions (lower case) taken out.

    A sequence may wrap over lines: each line's columns start where the
    sequence's earlier lines end.
    """
    header = F.col("value").startswith(">")
    counted = running_total(lines, ["file"], "line_no", header.cast("int"), "record")
    text = F.regexp_replace(F.trim("value"), r"\p{Ll}", "")
    body = counted.filter(~header & (F.trim("value") != "")).withColumn("text", text)
    placed = running_total(body, ["file", "record"], "line_no", F.length("text"), "_end")
    start = F.col("_end") - F.length("text")
    letters = placed.filter(F.length("text") > 0).select(
        stem(F.col("file")).alias("msa_id"), (F.col("record") - 1).alias("seq_idx"), start.alias("_start"),
        F.posexplode(F.split("text", "")).alias("_p", "letter"),
    )
    return letters.select("msa_id", "seq_idx", (F.col("_start") + F.col("_p")).cast("int").alias("col"), "letter")


def read_a3m(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_a3m(read_lines(spark, path))


def parse_pqr(lines: DataFrame, strict: bool = False) -> DataFrame:
    """CHARGES from PQR lines: radius, charge and position counted from the end of a line.

    Lines that do not fit are skipped; ``strict`` refuses a file without atoms.
    """
    fields = F.slice(F.split(F.trim("value"), r"\s+"), -5, 5)
    last = F.transform(fields, lambda v: v.try_cast("double"))
    atoms = lines.filter(F.col("value").rlike("^(ATOM|HETATM)"))
    # a line is split once; the numbers are tested and counted in the written table
    read = cut_lineage(atoms.select("file", "line_no", last.alias("_v")))
    names = ["x", "y", "z", "charge", "radius"]
    parsed = read.select("file", "line_no", *[F.get("_v", F.lit(i)).alias(n) for i, n in enumerate(names)]).dropna()
    if strict:
        empty = lines.select("file").distinct().join(parsed, "file", "left_anti")
        lost = empty.limit(1).collect()
        if lost:
            raise ValueError(f"{lost[0]['file']} holds no atoms")
    numbered = running_index(parsed, ["file"], "line_no", "_i")
    return numbered.select(
        stem(F.col("file")).alias("structure_id"), (F.col("_i") + 1).alias("atom_id"),
        "x", "y", "z", "charge", "radius",
    )


def read_pqr(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    return parse_pqr(read_lines(spark, path), strict)


def parse_dx(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(GRID_META, GRID) from OpenDX lines; the last axis runs fastest.

    A missing definition and a wrong number of values are errors that name the
    file; both show when GRID_META is read.
    """
    text = F.trim("value")
    kept = lines.withColumn("t", text).filter((F.col("t") != "") & ~F.col("t").startswith("#"))
    words = F.split("t", r"\s+")
    t = F.col("t")
    last = [F.get(words, F.size(words) - k).try_cast("long") for k in (3, 2, 1)]
    reals = F.transform(F.slice(words, 2, 3), lambda v: v.try_cast("double"))
    step = F.array_max(F.transform(reals, F.abs))
    is_counts, is_origin, is_delta = (t.startswith(p) for p in ("object 1", "origin", "delta"))
    # headers are a dozen lines per file
    head = kept.filter(is_counts | is_origin | is_delta).groupBy("file").agg(
        F.min(F.when(is_counts, F.array(*last))).alias("_n"),
        F.min(F.when(is_origin, reals)).alias("_o"),
        F.sort_array(F.collect_list(F.when(is_delta, F.struct("line_no", step.alias("h"))))).alias("_h"),
    )
    starts = kept.filter(t.startswith("object 3")).groupBy("file").agg(F.min("line_no").alias("_from"))
    marks = kept.filter(t.rlike("^(attribute|component|object)")).join(starts, "file")
    stops = marks.filter(F.col("line_no") > F.col("_from")).groupBy("file").agg(F.min("line_no").alias("_to"))
    span = starts.join(stops, "file", "left")
    body = kept.join(span, "file").filter(
        (F.col("line_no") > F.col("_from")) & (F.col("_to").isNull() | (F.col("line_no") < F.col("_to")))
    ).withColumn("_w", words)
    placed = running_total(body, ["file"], "line_no", F.size("_w"), "_end")
    values = placed.select(
        "file", (F.col("_end") - F.size("_w")).alias("_start"), F.posexplode("_w").alias("_p", "_v")
    ).select("file", (F.col("_start") + F.col("_p")).alias("p"), F.col("_v").cast("double").alias("value"))

    carried = placed.groupBy("file").agg(F.sum(F.size("_w")).alias("_have"))
    files = lines.select("file").distinct().join(head, "file", "left").join(carried, "file", "left")
    whole = F.col("_n").isNotNull() & F.col("_o").isNotNull() & (F.size("_h") >= 3)
    total = F.get("_n", F.lit(0)) * F.get("_n", F.lit(1)) * F.get("_n", F.lit(2))
    have = F.coalesce("_have", F.lit(0))
    check = (
        F.when(~F.coalesce(whole, F.lit(False)), refuse("grid definition is missing", F.col("file")).cast("long"))
        .when(total != have, refuse("the number of grid values is not the declared one", F.col("file")).cast("long"))
        .otherwise(total)
    )
    meta = files.select(
        "file", check.alias("points"),
        *[F.get("_o", F.lit(i)).alias(f"o{c}") for i, c in enumerate(AXES)],
        *[F.get("_n", F.lit(i)).alias(f"n{c}") for i, c in enumerate(AXES)],
        *[F.get("_h", F.lit(i))["h"].alias(f"h{c}") for i, c in enumerate(AXES)],
    )
    ny, nz, p = F.col("ny"), F.col("nz"), F.col("p")
    plane = ny * nz
    grid = values.join(meta.select("file", "ny", "nz", "points"), "file").filter("points > 0").select(
        stem(F.col("file")).alias("structure_id"),
        F.floor(p / plane).cast("int").alias("i"),
        (F.floor(p / nz) % ny).cast("int").alias("j"),
        (p % nz).cast("int").alias("k"),
        "value",
    )
    named = meta.withColumn("structure_id", stem(F.col("file"))).withColumn("method", F.lit("read from OpenDX"))
    return named.drop("file"), grid


def read_dx(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return parse_dx(read_lines(spark, path))


def _exp(c: Column) -> Column:
    return F.format_string("%.6e", c)


def dx_lines(grid: DataFrame, meta: DataFrame) -> DataFrame:
    """A grid as numbered OpenDX lines: three values a line, last axis fastest."""
    zero = "0.000000e+00"
    size = F.concat_ws(" ", "nx", "ny", "nz")
    total = F.col("nx") * F.col("ny") * F.col("nz")
    method = F.col("method") if "method" in meta.columns else F.lit("grid")
    top = [
        F.concat(F.lit("# "), method),
        F.concat(F.lit("object 1 class gridpositions counts "), size),
        F.concat_ws(" ", F.lit("origin"), *[_exp(F.col(f"o{c}")) for c in AXES]),
        F.concat_ws(" ", F.lit("delta"), _exp(F.col("hx")), F.lit(zero), F.lit(zero)),
        F.concat_ws(" ", F.lit("delta"), F.lit(zero), _exp(F.col("hy")), F.lit(zero)),
        F.concat_ws(" ", F.lit("delta"), F.lit(zero), F.lit(zero), _exp(F.col("hz"))),
        F.concat(F.lit("object 2 class gridconnections counts "), size),
        F.format_string("object 3 class array type double rank 0 items %d data follows", total),
    ]
    bottom = [
        'attribute "dep" string "positions"',
        'object "regular positions regular connections" class field',
        'component "positions" value 1',
        'component "connections" value 2',
        'component "data" value 3',
    ]
    name = F.col("structure_id").cast("string").alias("file")
    header = meta.select(name, F.posexplode(F.array(*top)).alias("line_no", "value"))
    rows = F.ceil(total / F.lit(3)).cast("long") + len(top)
    footer = meta.select(name, rows.alias("_at"), F.posexplode(F.array(*[F.lit(v) for v in bottom])).alias("_p", "value"))
    footer = footer.select("file", (F.col("_at") + F.col("_p")).alias("line_no"), "value")
    box = meta.select("structure_id", "ny", "nz")
    placed = grid.join(box, "structure_id").withColumn(
        "p", (F.col("i") * F.col("ny") + F.col("j")) * F.col("nz") + F.col("k")
    )
    third = F.floor(F.col("p") / 3).cast("long").alias("_line")
    body = placed.groupBy("structure_id", third).agg(
        F.array_sort(F.collect_list(F.struct("p", "value"))).alias("_v")  # three at most
    )
    text = F.array_join(F.transform("_v", lambda v: _exp(v.value)), " ")
    body = body.select(name, (F.col("_line") + len(top)).alias("line_no"), text.alias("value"))
    header = header.withColumn("line_no", F.col("line_no").cast("long"))
    return header.unionByName(body).unionByName(footer)


def write_dx(grid: DataFrame, meta: DataFrame, path: str, part_lines: int = PART_LINES) -> None:
    write_lines(dx_lines(grid, meta), path, part_lines)
