"""Catalogues: what format a volume file is in, and what an identifier names."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import refuse

# fixed values
SUFFIXES = {
    "ccp4": "ccp4", "map": "ccp4", "mrc": "ccp4", "dsn6": "dsn6", "omap": "dsn6",
    "dx": "dx", "cube": "cube", "cub": "cube", "bcif": "dscif",
}
FORMATS = sorted(set(SUFFIXES.values()))
MAGIC, MAGIC_AT = "4D415020", 209  # "MAP " as hex, 1-based byte
HEAD, PIECE = 2048, 65536
STRUCTURE_SUFFIXES = {"pdb": "pdb", "ent": "pdb", "cif": "mmcif", "mmcif": "mmcif"}
ARCHIVE_ID = r"^[0-9][a-zA-Z0-9]{3}$"
ACCESSION = r"^[OPQ][0-9][A-Z0-9]{3}[0-9]$|^[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}$"


@F.pandas_udf(T.BinaryType())
def _unpacked(files: pd.Series) -> pd.Series:
    """First bytes of gzip data; null where any of it does not decompress, its trailers included."""

    def one(packed):
        data, at, head = memoryview(bytes(packed)), 0, b""
        try:
            while at < len(data):
                member = zlib.decompressobj(31)
                while not member.eof:
                    piece = member.unconsumed_tail or bytes(data[at : at + PIECE])
                    if not member.unconsumed_tail:
                        at += len(piece)
                    if not piece:
                        return None
                    out = member.decompress(piece, PIECE)
                    head += out[: HEAD - len(head)]
                at -= len(member.unused_data)
            return head
        except zlib.error:
            return None

    return files.map(one)


def _suffix_format(path: Column) -> Column:
    """Format by the last known extension, a trailing .gz not counted."""
    name = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.gz$", ""))
    parts = F.split(name, r"\.")
    words = F.slice(parts, 2, F.size(parts))
    table = F.create_map(*[F.lit(v) for item in SUFFIXES.items() for v in item])
    known = F.filter(F.transform(F.reverse(words), lambda w: F.try_element_at(table, w)), lambda v: v.isNotNull())
    return F.get(known, F.lit(0))


def classify_volumes(files: DataFrame, format: str = "auto", strict: bool = False) -> DataFrame:
    """(path, content) to path, format, was_compressed, bytes, problem.

    The magic number beats the text sniff, which beats the extension. Packed files
    are unpacked to their end, in pieces; of the rest only the head is looked at. ``strict`` turns a problem into an error.
    """
    if format != "auto" and format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(FORMATS)}")
    content = F.col("content")
    packed = F.hex(F.substring(content, 1, 2)) == "1F8B"
    rows = files.select(
        "path", F.length(content).alias("bytes"), packed.alias("was_compressed"),
        F.when(packed, content).otherwise(F.substring(content, 1, HEAD)).alias("_raw"),
    )
    plain = rows.filter("NOT was_compressed").withColumn("head", F.substring("_raw", 1, HEAD))
    gz = rows.filter("was_compressed").withColumn("head", _unpacked("_raw"))
    rows = plain.unionByName(gz).drop("_raw")
    text = F.decode("head", "ISO-8859-1")
    magic = F.hex(F.substring("head", MAGIC_AT, 4)) == MAGIC
    opens = F.ltrim(F.substring(text, 1, 512)).startswith("#") & text.contains("object")
    found = F.when(magic, "ccp4").when(opens, "dx").otherwise(_suffix_format(F.col("path")))
    problem = (
        F.when(F.col("head").isNull(), "carries the gzip mark but fails to decompress")
        .when(F.length("head") == 0, "is empty")
        .when(F.lit(format == "auto") & found.isNull(), "is of no known format")
    )
    if strict:
        problem = F.when(problem.isNotNull(), refuse("cannot use volume file", F.concat_ws(" ", "path", problem)))
    chosen = found if format == "auto" else F.lit(format)
    return rows.withColumn("problem", problem.cast("string")).select(
        "path", F.when(F.col("problem").isNull(), chosen).alias("format"), "was_compressed", "bytes", "problem"
    )


def catalog_volumes(spark: SparkSession, path: str, format: str = "auto", strict: bool = False) -> DataFrame:
    """Catalogue the files under ``path``. Spark lists no files of zero bytes, so those are absent."""
    return classify_volumes(spark.read.format("binaryFile").load(path), format, strict)


def resolve_ids(ids: DataFrame, held: DataFrame | None = None, source: str = "auto") -> DataFrame:
    """What each ``identifier`` names, its stored name and, for archives, its address.

    Identifiers already held (by ``name``) are left out; ones that name nothing
    get kind ``error``.
    """
    if source not in ("auto", "file", "pdb", "alphafold"):
        raise ValueError(f"unknown source {source!r}")
    raw = F.trim("identifier")
    suffix = F.lower(F.regexp_extract(raw, r"\.([A-Za-z0-9]+)$", 1))
    upper, lower = F.upper(raw), F.lower(raw)

    def asked(kind: str) -> Column:
        return F.lit(source in ("auto", kind))

    kind = (
        F.when(asked("file") & suffix.isin(list(STRUCTURE_SUFFIXES)), "file")
        .when(asked("pdb") & raw.rlike(ARCHIVE_ID), "pdb")
        .when(asked("alphafold") & upper.rlike(ACCESSION), "alphafold")
        .otherwise("error")
    )
    base = F.regexp_extract(raw, r"([^/]+)\.[A-Za-z0-9]+$", 1)
    typed = ids.withColumn("kind", kind)
    named = typed.withColumn(
        "name",
        F.when(F.col("kind") == "file", base)
        .when(F.col("kind") == "pdb", lower)
        .when(F.col("kind") == "alphafold", F.concat(F.lit("AF-"), upper)),
    )
    formats = F.create_map(*[F.lit(v) for item in STRUCTURE_SUFFIXES.items() for v in item])
    out = named.withColumn(
        "format",
        F.when(F.col("kind") == "file", F.try_element_at(formats, suffix)).when(F.col("kind") != "error", "mmcif"),
    ).withColumn(
        "address",
        F.when(F.col("kind") == "pdb", F.concat(F.lit("https://files.rcsb.org/download/"), "name", F.lit(".cif"))).when(
            F.col("kind") == "alphafold",
            F.concat(F.lit("https://alphafold.ebi.ac.uk/files/"), "name", F.lit("-F1-model_v4.cif")),
        ),
    )
    # an identifier that names nothing has no name and so is never held
    return out if held is None else out.join(held.select("name"), "name", "left_anti")
