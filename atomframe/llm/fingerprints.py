"""Document fingerprints by I-Match, in DataFrame functions only.

A term is a lower-case word. Of a document's terms those are kept whose inverse
document frequency ln(N / df) lies in a band: too common terms say nothing and too rare
ones break under any edit. The distinct kept terms, sorted, are hashed for several
randomised subsets of the lexicon: every subset holds each term with a set chance, at
several chances, so that short and long texts alike have subsets with a few terms. A
small edit changes few of the hashes.

The lexicon is bounded: a term within the band occurs in at least exp(-HIGH) of the
documents, so there are at most (mean number of distinct terms of a document) *
exp(HIGH) of them. It becomes one row, an array of buckets, in which a term is looked
up by its hash; document terms are never exploded or shuffled for that. Texts are
shuffled once, to bring each document next to its successor.

Likeness is the share of equal hashes among the subsets in which either text has a
term, at the chance where subsets are best filled (the sparsest one that still fills
a quarter of them; else the densest).

Defined results: a null text is an empty one; a text without a kept term is
fingerprinted by all its terms, so that different texts stay apart; texts without any
term share one fingerprint and are wholly alike; rows with equal ids follow each
other by text; null ids come first; an empty table gives no rows; further columns of
the input are ignored whatever their names.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scaling import cut_lineage
from .common import table

#: The band of ln(N / df).
LOW, HIGH = 2.3, 6.2
SUBSETS = 16
#: One in so many terms is in a subset, from dense to sparse.
CHANCES = (16, 64, 256)
BUCKETS = 1 << 14
SEED = 71
EMPTY_HASH = 42
#: Rows in a block of consecutive documents.
BLOCK_ROWS = 2000


def terms(text: Column) -> Column:
    """Sorted 64-bit hashes of the distinct lower-case words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The hashes of the terms whose inverse document frequency lies in [low, high]."""
    total = docs.count()
    found = docs.select(F.explode(terms(F.coalesce(F.col("text"), F.lit("")))).alias("term"))
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(float(max(total, 1))) / F.col("df"))
    return counts.filter(idf.between(low, high)).select("term")


def as_buckets(found: DataFrame) -> DataFrame:
    """One row: an array in which element pmod(term, BUCKETS) + 1 lists the terms of that remainder."""
    bucket = F.pmod("term", F.lit(BUCKETS)).alias("bucket")
    filled = found.groupBy(bucket).agg(F.collect_list("term").alias("terms"))
    every = found.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    listed = every.join(filled, "bucket", "left").select("bucket", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))
    whole = F.sort_array(F.collect_list(F.struct("bucket", "terms")))
    return cut_lineage(listed.agg(F.transform(whole, lambda e: e["terms"]).alias("buckets")))


def in_band(all_terms: Column, buckets: Column) -> Column:
    """The terms of the lexicon among ``all_terms``, or all of them if none is in it."""
    kept = F.filter(all_terms, lambda t: F.array_contains(F.element_at(buckets, (F.pmod(t, F.lit(BUCKETS)) + 1).cast("int")), t))
    return F.when(F.size(kept) > 0, kept).otherwise(all_terms)


def _slot(term: Column, chance: int) -> Column:
    return F.pmod(F.xxhash64(term, F.lit(SEED + chance)), F.lit(chance))


def _chosen(terms_: str, chance: int, test) -> Column:
    return F.filter(terms_, lambda t: test(_slot(t, chance)))


def with_hashes(df: DataFrame, used: str, out: str) -> DataFrame:
    """Add ``out``: the 32-bit hashes of all subsets of the sorted terms ``used``; null where a subset has none."""
    pools = {c: f"_pool{c}" for c in CHANCES}
    df = df.select("*", *[_chosen(used, c, lambda slot: slot < SUBSETS).alias(p) for c, p in pools.items()])
    hashes = []
    for chance, pool in pools.items():
        for subset in range(SUBSETS):
            chosen = _chosen(pool, chance, lambda slot, s=subset: slot == s)
            # The hash of no elements is its seed.
            hashes.append(F.pmod(F.nullif(F.xxhash64(chosen), F.lit(EMPTY_HASH)), F.lit(2**32)))
    return df.withColumn(out, F.array(*hashes)).drop(*pools.values())


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), ".", "-")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes, 0 to 1, at the best filled chance; texts without terms are alike."""
    share = F.when(a == b, 1.0).otherwise(0.0)
    for i in range(len(CHANCES)):
        both = F.arrays_zip(F.slice(a, 1 + i * SUBSETS, SUBSETS).alias("x"), F.slice(b, 1 + i * SUBSETS, SUBSETS).alias("y"))
        filled = F.size(F.filter(both, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
        equal = F.size(F.filter(both, lambda p: F.coalesce(p["x"] == p["y"], F.lit(False))))
        fits = filled > 0 if i == 0 else filled >= SUBSETS // 4
        share = F.when(fits, equal / filled).otherwise(share)
    return share


def _blocks(keyed: DataFrame, total: int) -> Column:
    """The block of consecutive ids that ``k`` lies in: the number of bounds up to it, found in two steps."""
    count = max(1, total // max(BLOCK_ROWS, 2 * isqrt(total)))
    if count == 1:
        return F.lit(0)
    shares = [i / count for i in range(1, count)]
    bounds = sorted({int(b) for b in keyed.approxQuantile("k", shares, 0.2 / count)})
    step = max(1, isqrt(len(bounds)))
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    coarse = F.size(F.filter(listed(bounds[step - 1 :: step]), lambda b: b <= F.col("k"))) * step
    return coarse + F.size(F.filter(F.slice(listed(bounds), coarse + 1, step), lambda b: b <= F.col("k")))


def with_successor(docs: DataFrame) -> DataFrame:
    """(doc_id, text, block, place, next, first_text): each text beside the next one in order of id.

    ``next`` is null for the last document of a block, whose successor is ``first_text``,
    the first one of the following block (of the first block after the last).
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    blocked = keyed.withColumn("block", _blocks(keyed, docs.count()))
    lowest = cut_lineage(blocked.groupBy("block").agg(F.min("k").alias("low")))
    starts = blocked.join(lowest.select(F.col("low")), F.col("k") == F.col("low")).groupBy("block").agg(F.min("text").alias("first_text"))
    order = Window.orderBy("block")
    opening = F.first("first_text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = cut_lineage(starts.select("block", F.coalesce(F.lead("first_text").over(order), opening).alias("first_text")))
    inside = Window.partitionBy("block").orderBy("k", "text")
    rows = blocked.select("doc_id", "text", "block", F.row_number().over(inside).alias("place"), F.lead("text").over(inside).alias("next"))
    return rows.join(starts, "block")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    buckets = as_buckets(lexicon(docs))
    rows = with_successor(docs)
    n = F.char_length("text")
    rows = rows.select(
        "doc_id", "block", "place", "text", n.cast("long").alias("n_chars"),
        F.expr("concat(substring(text, 1, char_length(text) - char_length(text) DIV 2), "
               "substring(coalesce(next, first_text), 1, CAST(char_length(text) DIV 2 AS INT)))").alias("edited"),
        F.when(F.col("next").isNull(), F.col("first_text")).alias("follower"),
    )
    # The lexicon is one row; each use has a column of its own, so that it is read in place and never copied.
    looked = rows.select(
        "doc_id", "block", "place", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        *[terms(F.col(c)).alias(f"{c}_terms") for c in ("text", "edited", "follower")],
        *[buckets.scalar().alias(f"{c}_lexicon") for c in ("text", "edited", "follower")],
    )
    kept = [in_band(F.col(f"{c}_terms"), F.col(f"{c}_lexicon")).alias(f"{c}_used") for c in ("text", "edited", "follower")]
    done = looked.select("doc_id", "block", "place", "n_chars", "edited_sha256", *kept)
    for c in ("text", "edited", "follower"):
        done = with_hashes(done, f"{c}_used", f"{c}_hashes").drop(f"{c}_used")
    following = F.lead("text_hashes").over(Window.partitionBy("block").orderBy("place"))
    done = done.withColumn("next_hashes", F.coalesce(following, "follower_hashes"))
    return done.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("text_hashes")).alias("fingerprint"),
        as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("text_hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("text_hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op7_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
