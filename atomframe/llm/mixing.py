"""Mixing sources to target weights, in DataFrame functions only.

Temperature mixing: a source with share p of the tokens gets weight p^x / sum p^x.
The exponent x in [0, 1] is bisected until the weights reach a target entropy; if a
source would then be repeated more often than allowed, x is bisected again to the
smallest one that keeps the limit (x = 1 is the corpus as it is: no repeats).
A bisection takes five levels per aggregation, on one row per source.

The weights are realised as budgeted block permutations: source s may spend
round(weight * budget) tokens. Its documents are read in one seeded permutation
after the other, each laid out in blocks. In the pass that the quota does not
complete, every document is drawn that still fits what is left when its turn comes;
the others are left out. All that a document needs to know is its source's row (whole
passes, and the stretches of the unfinished pass), so texts are never shuffled.

Defined results: a null text has no tokens; rows with a null source form a source
of their own; a source without any token has weight 0 and its documents are drawn
once (they cost nothing); rows that share id and size are drawn together; an empty
table gives no rows; further columns are kept untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scaling import cut_lineage, union_all
from .common import block_rows, key_block, position, shuffle_key, table, word_count

SEED = 23
#: Where between the corpus' own entropy (0) and that of equal weights (1) the target lies.
ENTROPY_SHARE = 0.5
MAX_REPEATS = 4.0
LEVELS = 5
ROUNDS = 6
DIGITS = 9


def _bisect(shares: DataFrame, measure, wanted: float) -> float:
    """The exponent in [0, 1] where ``measure`` (falling in it) passes ``wanted``.

    ``shares`` has one row (p) per source with tokens. ``measure`` maps the columns
    z = sum p^x, e = sum p^x ln p, top = max p^(x-1) and x to the measured column.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / 2**LEVELS
        grid = [low + i * step for i in range(2**LEVELS + 1)]
        at = shares.select("p", F.explode(F.array(*[F.lit(x) for x in grid])).alias("x"))
        sums = at.groupBy("x").agg(
            F.sum(F.pow("p", "x")).alias("z"),
            F.sum(F.pow("p", "x") * F.log("p")).alias("e"),
            F.max(F.pow(F.col("p"), F.col("x") - 1)).alias("top"),
        )
        above = sums.filter(measure(F.col("z"), F.col("e"), F.col("top"), F.col("x")) >= wanted)
        found = above.agg(F.max("x")).first()[0]
        low = grid[0] if found is None else min(found, grid[-2])
        high = low + step
    return high


def _entropy(z: Column, e: Column, top: Column, x: Column) -> Column:
    return F.log(z) - x * e / z


def _repeats(z: Column, e: Column, top: Column, x: Column) -> Column:
    return top / z


def exponent(shares: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget_share: float = 1.0) -> float:
    """The bisected exponent for token shares ``p``, rounded to 6 digits."""
    own = shares.agg(F.sum(-F.col("p") * F.log("p")), F.count(F.lit(1))).first()
    if not own[1]:
        return 1.0
    equal = shares.agg(F.log(F.count(F.lit(1)).cast("double"))).first()[0]
    target = own[0] + (equal - own[0]) * entropy_share
    x = _bisect(shares, _entropy, target - 1e-12)
    most = _bisect(shares, lambda z, e, top, x: _repeats(z, e, top, x) * F.lit(budget_share), max_repeats + 1e-12)
    flat = shares.agg(F.max(1 / F.col("p")) / F.count(F.lit(1)) * F.lit(budget_share)).first()[0]
    return round(max(x, most if flat > max_repeats else 0.0), 6)


def _key(seed: int, epoch: Column, doc_id: Column, n_tokens: Column) -> Column:
    """Where a row stands in the permutation of a pass."""
    row = F.concat_ws(":", epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")), n_tokens.cast("string"))
    return shuffle_key(F.lit(seed), row)


def stretches(groups: DataFrame, rest: DataFrame) -> DataFrame:
    """(s3, stretches): which rows of an unfinished pass are drawn, per source.

    ``groups`` holds (s, block, key, n, size): rows of ``n`` tokens that share a key, and
    their tokens together. ``rest`` holds (s, rest): tokens left. A stretch starts behind
    ``after``, ends before ``stop`` (null: not at all) and holds the rows of at most
    ``rest`` tokens in it; at ``stop`` stands what did not fit any more. Each round finds
    the next stretch of every source at once.
    """
    state = rest.select(F.col("s").alias("s2"), "rest", F.lit("").alias("after"))
    found: list[DataFrame] = []
    while True:
        rows = groups.join(state, F.col("s").eqNullSafe(F.col("s2"))).filter((F.col("n") <= F.col("rest")) & (F.col("key") > F.col("after")))
        rows = cut_lineage(rows.select("s", "block", "key", "size", "rest", "after"))
        sums = rows.groupBy("s", "block").agg(F.sum("size").alias("sum"))
        before = Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select(F.col("s").alias("s2"), F.col("block").alias("block2"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
        inside = Window.partitionBy("s", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = rows.join(starts, F.col("s").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("block2")))
        running = running.withColumn("reached", F.col("start") + F.sum("size").over(inside))
        fits = F.col("reached") <= F.col("rest")
        part = running.groupBy("s", "rest", "after").agg(
            F.min(F.when(~fits, F.col("key"))).alias("stop"), F.coalesce(F.max(F.when(fits, F.col("reached"))), F.lit(0)).alias("used"),
        )
        part = cut_lineage(part)
        found.append(part.select(F.col("s").alias("s3"), F.struct("after", "stop", "rest").alias("stretch")))
        state = part.filter("stop IS NOT NULL").select(F.col("s").alias("s2"), (F.col("rest") - F.col("used")).alias("rest"), F.col("stop").alias("after"))
        if state.isEmpty():
            return union_all(found).groupBy("s3").agg(F.collect_list("stretch").alias("stretches"))


def plan(rows: DataFrame, seed: int, entropy_share: float, max_repeats: float, budget: int | None) -> tuple[DataFrame, int, int]:
    """One row per source: s, weight, quota, tokens, passes, stretches (or null); number of blocks; budget.

    ``rows`` holds (doc_id, source, n_tokens).
    """
    sums = cut_lineage(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")))
    total, count = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    budget = total if budget is None else budget
    blocks = max(1, -(-count // block_rows(count)))
    shares = sums.filter("tokens > 0").select((F.col("tokens") / F.lit(max(total, 1))).alias("p"))
    x = exponent(shares, entropy_share, max_repeats, budget / max(total, 1))
    z = shares.agg(F.sum(F.pow("p", F.lit(x)))).first()[0] or 1.0
    weight = F.round(F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(x)) / F.lit(z)).otherwise(0.0), DIGITS)
    quota = F.round(weight * F.lit(budget)).cast("long")
    sources = sums.select(
        F.col("source").alias("s"), "tokens", weight.alias("weight"), quota.alias("quota"),
    )
    passes = F.when(F.col("tokens") > 0, F.expr("quota DIV tokens")).otherwise(1).cast("long")
    rest = F.when(F.col("tokens") > 0, F.expr("quota % tokens")).otherwise(0).cast("long")
    sources = cut_lineage(sources.withColumn("passes", passes).withColumn("rest", rest))
    keyed = rows.join(sources, F.col("source").eqNullSafe(F.col("s")) & (F.col("rest") > 0))
    keyed = keyed.select("s", F.col("n_tokens").alias("n"), _key(seed, F.col("passes"), F.col("doc_id"), F.col("n_tokens")).alias("key"))
    groups = keyed.groupBy("s", "key").agg(F.max("n").alias("n"), F.sum("n").alias("size"))
    groups = cut_lineage(groups.withColumn("block", key_block(F.col("key"), blocks)))
    drawn = stretches(groups, sources.filter("rest > 0").select("s", "rest"))
    full = sources.join(drawn, F.col("s").eqNullSafe(F.col("s3")), "left").drop("s3", "rest")
    return cut_lineage(full), blocks, budget


def _epochs(seed: int, doc_id: Column, n_tokens: Column, passes: Column, parts: Column) -> Column:
    """The passes a row is drawn in: all whole ones, and the unfinished one where a stretch holds the row."""
    key = _key(seed, passes, doc_id, n_tokens)
    inside = lambda p: (key > p["after"]) & (p["stop"].isNull() | (key < p["stop"])) & (n_tokens <= p["rest"])
    drawn = passes + F.coalesce(F.exists(parts, inside).cast("long"), F.lit(0))
    return F.when(drawn > 0, F.sequence(F.lit(0).cast("long"), drawn - 1))


def mix(docs: DataFrame, seed: int = SEED, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget: int | None = None, tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its source's weight asks for; same columns.

    ``budget``: tokens to draw in all, default as many as there are. ``tokens``: the
    size of a row, default its words.
    """
    size = word_count(F.col("text")) if tokens is None else tokens
    rows = cut_lineage(docs.select("doc_id", "source", size.alias("n_tokens")))
    sources, _, _ = plan(rows, seed, entropy_share, max_repeats, budget)
    unused = "_" * max(map(len, docs.columns))
    left, right = docs.withColumn(f"size{unused}", size).alias("d"), sources.alias("m")
    joined = left.join(right, F.col("d.source").eqNullSafe(F.col("m.s")))
    epochs = _epochs(seed, F.col("d.doc_id"), F.col(f"d.size{unused}"), F.col("m.passes"), F.col("m.stretches"))
    return joined.select("d.*", F.explode(epochs).alias(f"epoch{unused}")).drop(f"size{unused}", f"epoch{unused}")


def draws(docs: DataFrame, seed: int = SEED, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, weight, epoch, block, slot): where each drawn row stands.

    A source is read pass by pass (epoch), block by block, slot by slot. Rows that share id
    and size are numbered as one and spread out after.
    """
    rows = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("n_tokens")))
    sources, blocks, _ = plan(rows, seed, entropy_share, max_repeats, budget)
    groups = rows.groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    drawn = groups.join(sources, F.col("source").eqNullSafe(F.col("s")))
    epochs = _epochs(seed, F.col("doc_id"), F.col("n_tokens"), F.col("passes"), F.col("stretches"))
    drawn = drawn.select("doc_id", "source", "n_tokens", "copies", "weight", F.explode(epochs).alias("epoch"))
    key = _key(seed, F.col("epoch"), F.col("doc_id"), F.col("n_tokens"))
    drawn = drawn.withColumn("key", key).withColumn("block", key_block(F.col("key"), blocks))
    inside = Window.partitionBy("source", "epoch", "block").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = drawn.withColumn("upto", F.sum("copies").over(inside))
    places = F.sequence(F.col("upto") - F.col("copies"), F.col("upto") - 1)
    return drawn.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", F.explode(places).alias("slot"))


def op1_mixture_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE rows_ AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS n_tokens FROM documents
), sums AS MATERIALIZED (
  SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_rows FROM rows_ GROUP BY source
), whole AS MATERIALIZED (
  SELECT sum(tokens)::BIGINT AS total, sum(n_rows)::BIGINT AS n,
    list(tokens ORDER BY tokens) FILTER (tokens > 0) AS ts FROM sums
), shares AS MATERIALIZED (
  SELECT list_transform(ts, lambda t: t / total::DOUBLE) AS ps, total, n,
    greatest(1, (n + greatest(4096, 16 * floor(sqrt(n)))::BIGINT - 1) // greatest(4096, 16 * floor(sqrt(n)))::BIGINT) AS blocks FROM whole
), aims AS MATERIALIZED (
  SELECT *, list_sum(list_transform(ps, lambda p: -p * ln(p))) AS own, ln(len(ps)) AS equal,
    list_max(list_transform(ps, lambda p: 1 / p)) / len(ps) AS flat FROM shares
), by_entropy(i, lo, hi) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      ln(list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))))
        - (lo + hi) / 2 * list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2) * ln(p)))
        / list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) >= own + (equal - own) * {ENTROPY_SHARE} - 1e-12 AS up
    FROM by_entropy, aims WHERE i < {LEVELS * ROUNDS})
), by_repeats(i, lo, hi) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      list_max(list_transform(ps, lambda p: pow(p, (lo + hi) / 2 - 1)))
        / list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) >= {MAX_REPEATS} + 1e-12 AS up
    FROM by_repeats, aims WHERE i < {LEVELS * ROUNDS})
), found AS MATERIALIZED (
  SELECT *, round(greatest((SELECT hi FROM by_entropy WHERE i = {LEVELS * ROUNDS}),
    CASE WHEN flat > {MAX_REPEATS} THEN (SELECT hi FROM by_repeats WHERE i = {LEVELS * ROUNDS}) ELSE 0 END), 6) AS x FROM aims
), weighted AS MATERIALIZED (
  SELECT source, tokens, blocks, total, round(CASE WHEN tokens > 0 THEN
    pow(tokens / total::DOUBLE, x) / list_sum(list_transform(ps, lambda p: pow(p, x))) ELSE 0 END, {DIGITS}) AS weight
  FROM sums, found
), quotas AS MATERIALIZED (
  SELECT *, round(weight * total)::BIGINT AS quota FROM weighted
), passes AS MATERIALIZED (
  SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes,
    CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest FROM quotas
), all_ AS (
  SELECT r.doc_id, r.source, n_tokens, weight, tokens, blocks, passes, rest, unnest(range(passes + 1)) AS epoch
  FROM rows_ r JOIN passes p ON r.source IS NOT DISTINCT FROM p.source
), keyed AS MATERIALIZED (
  SELECT *, md5(concat_ws(':', '{SEED}', epoch::VARCHAR, coalesce(doc_id::VARCHAR, 'null'), n_tokens::VARCHAR)) AS key FROM all_
), unfinished AS MATERIALIZED (
  SELECT source, key, any_value(rest) AS rest, sum(n_tokens)::BIGINT AS size FROM keyed WHERE epoch = passes AND rest > 0 GROUP BY source, key
), told AS (
  SELECT source, list(key ORDER BY key) AS ks, list_reduce(list_prepend([0::BIGINT], list([size] ORDER BY key)),
    lambda a, x: CASE WHEN a[1] + x[1] <= any_value(rest) THEN list_concat([a[1] + x[1]], a[2:], [1::BIGINT]) ELSE list_append(a, 0::BIGINT) END) AS fits
  FROM unfinished GROUP BY source
), kept AS MATERIALIZED (SELECT source, unnest(ks) AS key, unnest(fits[2:]) AS fits FROM told
), blocked AS (
  SELECT k.*, floor(('0x' || substr(k.key, 1, 8))::BIGINT * blocks / 4294967296.0)::BIGINT AS block, coalesce(fits, 0) AS fits
  FROM keyed k LEFT JOIN kept f ON k.epoch = k.passes AND k.source IS NOT DISTINCT FROM f.source AND k.key = f.key
)
SELECT doc_id, source, n_tokens, weight, epoch::BIGINT AS epoch, block,
  (row_number() OVER (PARTITION BY source, epoch, block ORDER BY key, n_tokens) - 1)::BIGINT AS slot
FROM blocked WHERE epoch < passes OR fits = 1
"""
