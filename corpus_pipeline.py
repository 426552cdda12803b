"""The corpus pipeline: quality, toxicity, near-duplicates, mixing, packing.

Every stage reads what the one before it kept, as written Parquet. Columns beyond those
of ``documents`` pass through the first four stages untouched, whatever their names. An empty
table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomframe.llm import mixing, near_dups, packing, quality, toxicity
from atomframe.scaling import cut_lineage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    Null and empty texts are scored like any text; null ids are kept by their score; repeated
    rows are scored each, so they stay or go together. Without enough labels among the rows
    the share of good labels is every row's score.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.scorer(model)(F.col("text")) >= quality.THRESHOLD)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    Null and empty texts show no sign of toxicity and are scored; null ids and repeated rows
    are treated as in the stage before. Without labels of both classes the share of toxic
    labels is every row's score.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.scorer(model)(F.col("text")) < toxicity.THRESHOLD)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates.

    Null and empty texts and rows without id are never duplicates and stay; rows that share
    an id are one document and stay or go together.
    """
    return near_dups.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by source weight: a large source in part, a small one more than once.

    Null and empty texts cost nothing; a null source is a source of its own; rows that share
    id and size, null ids among them, are drawn together.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each drawn document stands in the padded batches.

    Null and empty texts have length 0; every row, repeated or without id, has a place.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]
#: SQL cannot express the trained classifiers; tests/llm checks every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = cut_lineage(docs)
    return docs
