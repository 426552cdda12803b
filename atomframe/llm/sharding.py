"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled inside each source by a seeded key and ranked; the fractional
rank (rank + 1/2) / rows of the source spreads every source evenly over (0, 1).
Sorted by it, any stretch of rows holds the sources in the corpus' proportions,
so equal cuts give shards that all match the mixture.

Only narrow rows (id, source, size, checksum, key) are shuffled. Ranks are
counted in blocks, so a source with a third of all rows spreads over all tasks.

Defined results: a null text has size 16 and the checksum of no bytes; rows with
a null source form a source of their own; a null id is shuffled as the word
"null"; repeated rows are separate rows; an empty table gives no rows; further
columns of the input are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scaling import cut_lineage
from .common import block_rows, key_block, position, shuffle_key, table

SHARDS = 40
SEED = 17
OVERHEAD = 16


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, fraction, shard, slot) of every row.

    Shard sizes differ by one row at most; slots of a shard run from 0 without gaps.
    """
    if shards < 1:
        raise ValueError(f"shards must be at least 1, got {shards}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.col("source"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shuffle_key(F.lit(seed), F.col("doc_id")).alias("key"),
    )
    total = docs.count()
    per_block = block_rows(total)
    blocks = max(1, -(-total // per_block))
    order = [F.col("key"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    rows = rows.withColumn("block", key_block(F.col("key"), blocks))
    ranked = position(rows, ["source"], "block", order, "rank")
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows_of_source"))
    counts = counts.select(F.col("source").alias("s"), "rows_of_source")
    # One row per source against all rows: written first, so that the planner sees its size.
    with_count = ranked.join(cut_lineage(counts), F.col("source").eqNullSafe(F.col("s")))
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("rows_of_source"))
    placed = with_count.select(
        "doc_id", "source", "size", "text_crc32", "key", fraction.alias("fraction")
    ).withColumn("bin", F.floor(F.col("fraction") * F.lit(blocks)).cast("long"))
    placed = position(
        cut_lineage(placed), [], "bin", [F.col("fraction"), F.col("source"), *order], "place"
    )
    shard = F.expr(f"place * {shards} DIV {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) DIV {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", (F.col("place") - first).cast("long"))
        .select("doc_id", "source", "size", "text_crc32", "fraction", F.col("shard").cast("int").alias("shard"), "slot")
    )


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The checksum goes over the bytes of each text, four bits at a time, with the table of the
#: reflected polynomial EDB88320 made by its rule.
SQL = f"""
WITH nibble AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT range AS i FROM range(16::BIGINT)))
), texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), summed AS (
  SELECT doc_id, source, strlen(text) + {OVERHEAD} AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) >> 4,
        t[(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) & 15) + 1]))) AS text_crc32,
    md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, 'null'))) AS key
  FROM texts, nibble
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, text_crc32, size) - 1 AS r,
    count(*) OVER (PARTITION BY source) AS n FROM summed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST, key,
    doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
  (place * {SHARDS} // total)::INT AS shard,
  (place - ((place * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot,
  NULL::INT AS grown_shard
FROM placed
"""
