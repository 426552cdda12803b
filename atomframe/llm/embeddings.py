"""Near-duplicate embeddings by lattice hashing.

A table projects every unit vector onto random directions, eight for a block, and
decodes each block to the nearest point of the E8 lattice; the points of all blocks
make the vector's cell. A vector also probes cells in which one block moves to one of
the lattice neighbours nearest to it. Vectors meet where one's cell is among the
other's probes in any table; each met pair is verified by its cosine in double
precision, so no link is false.

With the settings below a pair at cosine 0.95 meets in one of the tables in more than
99 of 100 cases, and closer pairs nearly always. Equal vectors are collapsed before,
and counted back after. Vectors travel once to be collapsed and once per met pair.

Defined results: a vector that is null, empty, zero or has a null or non-finite part
has no links and is its own component; vectors of different lengths never meet; a
null id is kept and not linked; an empty table gives no rows; further columns of the
input are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import component_roots
from ..scaling import cut_lineage
from .common import table

COSINE = 0.95
TABLES, BLOCKS, PROBES = 16, 2, 4
#: Cell size: projections are divided by it before decoding.
SCALE = 1.8
SEED = 11
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def lattice_neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    pairs = [(i, j, a, b) for i in range(8) for j in range(i + 1, 8) for a in (1.0, -1.0) for b in (1.0, -1.0)]
    whole = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in zip(whole, pairs):
        row[i], row[j] = a, b
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.concatenate([whole, 0.5 * signs[signs.prod(axis=1) > 0]])


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum: round, and where the sum is odd, round the worst entry the other way."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    gap = x[odd] - point[odd]
    worst = np.abs(gap).argmax(axis=1)
    point[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of ``x`` (n, 8)."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _point_hash(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of lattice points along the last axis (coordinates are halves)."""
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    h = np.full(points.shape[:-1], salt, dtype=np.uint64)
    for i in range(8):
        h = _mix(h * _P + doubled[..., i])
    return h


def cells(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (n, TABLES) and probed cells (n, TABLES, BLOCKS * PROBES) of unit vectors."""
    n, dim = units.shape
    rng = np.random.default_rng([SEED, dim])
    homes, probes = [], []
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            own, near = [], []
            for b in range(BLOCKS):
                x = units @ rng.normal(size=(dim, 8)) / SCALE
                point = decode(x)
                closest = np.argsort(-((x - point) @ lattice_neighbours().T), axis=1, kind="stable")[:, :PROBES]
                own.append(_point_hash(point, b + 1))
                near.append(_point_hash(point[:, None, :] + lattice_neighbours()[closest], b + 1))
            base = np.uint64((t * 0x10001 + dim) & 0xFFFFFFFF) * _Q
            total = sum(own)
            homes.append(_mix(total + base))
            probes.append(_mix(np.concatenate([(total - own[b])[:, None] + near[b] for b in range(BLOCKS)], axis=1) + base))
    return np.stack(homes, axis=1), np.stack(probes, axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """The rows at length 1; each is brought to size 1 first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        vectors = batch.column(1)
        sizes = np.diff(vectors.offsets.to_numpy())
        flat, starts = vectors.values.to_numpy().astype(np.float64), vectors.offsets.to_numpy()[:-1]
        for dim in np.unique(sizes):
            which = np.flatnonzero(sizes == dim)
            for part in np.array_split(which, max(1, len(which) // 1000)):
                home, probe = cells(unit_rows(flat[starts[part][:, None] + np.arange(dim)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[part]), pa.array(list(home.view(np.int64)), pa.list_(pa.int64())),
                        pa.array(list(probe.reshape(len(part), -1).view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["rep", "home", "probe"],
                )


def _verify(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                lists = batch.column(c)
                sides.append((lists.values.to_numpy().astype(np.float64), lists.offsets.to_numpy()))
            (x, xo), (y, yo) = sides
            keep = []
            if batch.num_rows:
                size = np.diff(xo)
                same = np.flatnonzero(size == np.diff(yo))
                for dim in np.unique(size[same]):
                    part = same[size[same] == dim]
                    a, b = x[xo[part][:, None] + np.arange(dim)], y[yo[part][:, None] + np.arange(dim)]
                    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
                    cosine = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
                    keep.append(part[cosine >= threshold])
            kept = batch.take(pa.array(np.concatenate([np.empty(0, np.int64), *keep]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return work


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    keys = [F.when(usable, F.xxhash64("v")).alias("k1"), F.when(usable, F.xxhash64(F.lit(1), F.col("v"))).alias("k2")]
    keyed = cut_lineage(rows.select("vec_id", *keys))
    reps = keyed.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = cut_lineage(reps)
    found = rows.join(reps.select("rep"), F.col("vec_id") == F.col("rep"), "left_semi").filter(usable)
    distinct = cut_lineage(found.select(F.col("vec_id").alias("rep"), "v").dropDuplicates(["rep"]))
    hashed = cut_lineage(distinct.mapInArrow(_hash, "rep long, home array<long>, probe array<long>"))
    homes = hashed.select(F.col("rep").alias("b"), F.explode("home").alias("cell"))
    seekers = hashed.select(F.col("rep").alias("a"), F.explode(F.array_distinct(F.concat("home", "probe"))).alias("cell"))
    met = seekers.join(homes, "cell").filter("a != b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = distinct.select(F.col("rep").alias("a"), F.col("v").alias("x"))
    second = distinct.select(F.col("rep").alias("b"), F.col("v").alias("y"))
    pairs = met.join(first, "a").join(second, "b").select("a", "b", "x", "y")
    links = cut_lineage(pairs.mapInArrow(_verify(cosine), "a long, b long"))
    roots = component_roots(links, "a", "b").select(F.col("node").alias("rep"), "root")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = ends.join(reps.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    facts = reps.join(weight, "rep", "left").join(roots, "rep", "left")
    facts = facts.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("home"))
    joined = keyed.join(cut_lineage(facts), ["k1", "k2"], "left")
    component = F.coalesce("home", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op6_lattice_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= {COSINE}
), reached(vec_id, other) AS (
  SELECT a, b FROM links UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other
), roots AS (SELECT vec_id, min(other) AS low FROM reached GROUP BY vec_id
), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
