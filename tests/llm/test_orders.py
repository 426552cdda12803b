"""Sharding, mixing and packing."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest

from atomframe.llm import mixing, packing, sharding


def test_shards_match_the_mixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharding.interleave(docs, 5).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    whole = Counter(r["source"] for r in rows)
    for shard in sizes:
        part = Counter(r["source"] for r in rows if r["shard"] == shard)
        for source, n in whole.items():
            assert abs(part[source] - n / 5) <= 1.5


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = sharding.interleave(odd_docs, 3).collect()
    assert len(rows) == 9 and sharding.interleave(no_docs).count() == 0
    nulls = [r for r in rows if r["doc_id"] == 3][0]
    assert (nulls["size"], nulls["text_crc32"]) == (16, 0)
    with pytest.raises(ValueError):
        sharding.interleave(odd_docs, 0)


def test_mixing_meets_entropy_and_limit(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "p double")
    x = mixing.exponent(shares, entropy_share=0.5, max_repeats=9.0)
    w = np.array([0.7, 0.2, 0.1]) ** x
    w /= w.sum()
    p = np.array([0.7, 0.2, 0.1])
    own, now = -(p * np.log(p)).sum(), -(w * np.log(w)).sum()
    assert abs(now - (own + np.log(3)) / 2) < 1e-5
    x = mixing.exponent(shares, entropy_share=1.0, max_repeats=2.0)
    w = p**x / (p**x).sum()
    assert (w / p).max() == pytest.approx(2.0, abs=1e-4)


def test_mixing_spends_the_budget(spark):
    rows = [(i, "w " * (1 + i % 3), "big" if i < 600 else "small") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = sum(1 + i % 3 for i in range(700))
    spent, times = Counter(), Counter()
    for r in mixing.mix(docs, entropy_share=1.0).collect():
        spent[r["source"]] += len(r["text"].split())
        times[r["doc_id"]] += 1
    assert abs(spent["big"] - total / 2) <= 3 and abs(spent["small"] - total / 2) <= 3
    small = [times[i] for i in range(600, 700)]
    assert max(small) - min(small) <= 1 and min(small) >= 3
    placed = mixing.draws(docs, entropy_share=1.0).collect()
    assert Counter(r["doc_id"] for r in placed) == times
    for (_, _), group in itertools.groupby(sorted((r["source"], r["epoch"], r["block"], r["slot"]) for r in placed), key=lambda r: r[:2]):
        assert len(set(group)) > 0


def test_mixing_odd_rows(odd_docs, no_docs):
    out = mixing.mix(odd_docs)
    assert out.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[3] - ids[None] in (0, 1)  # of one source: the row without tokens costs nothing
    assert mixing.mix(no_docs).count() == 0


def test_best_bounds_against_all_choices():
    rng = np.random.default_rng(3)
    for _ in range(60):
        m, k = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        x = np.sort(rng.choice(60, m, replace=False) + 1)
        c = rng.integers(1, 9, m)
        cost = lambda b: sum(int(n) * min(v for v in b if v >= s) for s, n in zip(x, c))
        best = min(cost([*s, x[-1]]) for r in range(min(k, m)) for s in itertools.combinations(x[:-1], r))
        bounds = packing.best_bounds(x, c, k)
        assert len(bounds) <= k and cost(bounds) == best


def test_packing(odd_docs, no_docs):
    rows = packing.pack(odd_docs, buckets=3, token_budget=20).collect()
    assert len(rows) == 9 and packing.pack(no_docs).count() == 0
    for r in rows:
        assert r["n_tokens"] <= r["padded_to"]
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["bucket"], r["batch"])), key=lambda r: (r["bucket"], r["batch"])):
        group = list(group)
        assert len(group) == 1 or len(group) * group[0]["padded_to"] <= 20
        assert sorted(r["slot"] for r in group) == list(range(len(group)))


def greedy(rows, quota, epoch=0):
    """Ids of one source drawn in an unfinished pass: each in its turn, if it still fits."""
    groups = {}
    for i, n in rows:
        key = hashlib.md5(f"{mixing.SEED}:{epoch}:{'null' if i is None else i}:{n}".encode()).hexdigest()
        groups.setdefault(key, []).append((i, n))
    out = []
    for _, group in sorted(groups.items()):
        size = sum(n for _, n in group)
        if size <= quota:
            quota -= size
            out += [i for i, _ in group]
    return Counter(out)


@pytest.mark.parametrize("budget", [1, 37, 4600, 5200])
def test_unfinished_pass_draws_all_that_fits(spark, budget):
    rng = np.random.default_rng(budget)
    sizes = [(i, int(n)) for i, n in enumerate(rng.integers(0, 22, 480))] + [(500, 100_000), (501, 900), (502, 2000), (503, 4000)]
    sizes += [(7, 12)] * 40 + [(None, 3)] * 5 + [(None, 4)]
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in sizes], "doc_id long, text string, source string")
    docs = docs.selectExpr("*", "1 AS n_tokens", "2 AS stretches", "'x' AS passes")
    drawn = mixing.mix(docs, budget=budget)
    assert drawn.columns == docs.columns
    assert Counter(r["doc_id"] for r in drawn.collect()) == greedy(sizes, budget)
    placed = mixing.draws(docs, budget=budget).collect()
    assert Counter(r["doc_id"] for r in placed) == greedy(sizes, budget)
    blocks = {}
    for r in placed:
        blocks.setdefault((r["epoch"], r["block"]), []).append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in blocks.values())
