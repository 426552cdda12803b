"""Connected components: forests inside tasks, then alternating star contractions.

A task first joins the edges it holds anyway to a forest, so that only one edge per node
and part leaves it. Every round then rewires each node to the smallest node in reach, so
the number of rounds grows with the logarithm of the longest path. Only edges travel: a
node that already hangs on its root is one edge, and a hub is a hot join key whose other
side holds one row, which the planner broadcasts or splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scaling import cut_lineage, drop_cut

#: Edges that a task joins to one forest at most.
LOCAL = 1 << 20


def _ranks(values: pa.Array) -> np.ndarray:
    """Places of values in their order, from 1; nulls are 0."""
    coded = values.dictionary_encode()
    rank = np.empty(len(coded.dictionary) + 1, np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(rank))
    rank[-1] = 0
    return rank[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)]


def _codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct value, in ascending order, and each value's number. Structs are ordered field by field."""
    key = np.zeros(len(values), np.int64)
    for field in values.flatten() if pa.types.is_struct(values.type) else [values]:
        rank = _ranks(field)
        key = np.unique(key, return_inverse=True)[1] * (int(rank.max(initial=0)) + 1) + rank
    _, first, code = np.unique(key, return_index=True, return_inverse=True)
    return first, code


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of ``n`` nodes joined by edges (u, v)."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _join(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The edges as stars: every node but the smallest of its component, with that one."""
    ends = [pa.concat_arrays([p.column(i) for p in parts]) for i in (0, 1)]
    both = pa.concat_arrays(ends)
    first, code = _codes(both)
    root = forest(code[: len(ends[0])], code[len(ends[0]) :], len(first))
    kept = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([both.take(pa.array(first[x])) for x in (kept, root[kept])], names=["u", "v"])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= LOCAL:
            yield _join(held)
            held, size = [], 0
    if held:
        yield _join(held)


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    return ends.filter("_a IS NOT NULL AND _b IS NOT NULL AND u != v").select("u", "v")


def component_roots(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge to another one; root < node.

    ``edges`` is undirected; loops, repeated edges and rows with a null end say
    nothing. A node without a row here is the smallest of its component, or
    alone. Ids may be numbers, texts or structs of them.
    """
    ends = _ordered(edges, a, b)
    current = cut_lineage(_ordered(ends.mapInArrow(_local, ends.schema), "u", "v").distinct())
    while True:
        nearest = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = nearest.groupBy("u").agg(F.min("v").alias("m")).filter("m < u").select(F.col("u").alias("v"), "m")
        up = current.join(nearest, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        large = cut_lineage(up.groupBy("u", "v").agg(F.max("moved").alias("moved")))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        other = large.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
        rewired = lowest.select("u", F.col("m").alias("v"), F.lit(False).alias("moved")).unionByName(other)
        rewired = cut_lineage(rewired.groupBy("u", "v").agg(F.max("moved").alias("moved")))
        settled = large.filter("moved").isEmpty() and rewired.filter("moved").isEmpty()
        for spent in (current, large):
            drop_cut(spent)
        current = rewired
        if settled:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
