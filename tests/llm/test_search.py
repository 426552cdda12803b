"""Ranked lexical search and exact top-k search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from atomframe.llm import lexical, topk

TERM = re.compile(lexical.TERM)


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    texts = {i: min((t or "") for j, t in items if j == i) for i in {i for i, _ in items if i is not None}}
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in texts.items():
        scored = []
        for d, c in held:
            n = sum(c.values())
            m = 75 + (25 * n * n_docs) // max(n_terms, 1)
            score = 0
            for t, r in Counter(plain_terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += r * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture
def small_buckets(monkeypatch):
    """Many buckets, item blocks and a small lead, so that every bound is at work."""
    monkeypatch.setattr(lexical, "BUCKET_DOCS", 40)
    monkeypatch.setattr(lexical, "LEAD", 60)
    monkeypatch.setattr(lexical, "ITEMS", 8)
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERIES", 16)


def words(rng, n):
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(n))


def test_lexical_search_is_exact(spark, small_buckets):
    rng = random.Random(4)
    docs = [(i, words(rng, rng.choice([3, 20, 20, 60, 400]))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "!!"), (None, "w1 w300 w301"), (5, docs[7][1]), (6, docs[7][1]), (403, "W1 été-W2_w3.w4 世界")]
    items = [(i, words(rng, 12)) for i in range(20)] + [(20, None), (21, "none of these"), (22, docs[7][1]), (23, "ÉTÉ été 世界 W2"), (None, "w1"), (22, docs[8][1])]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    d = d.selectExpr("*", "1 AS level", "'x' AS bucket", "2 AS n")
    got = [tuple(r) for r in lexical.search(d, q.selectExpr("*", "1 AS q", "2 AS least"), 7).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_search(docs, items, 7)))


def test_equal_scores_are_ranked_by_id(spark, small_buckets):
    docs = [(i, "same words here") for i in range(150)] + [(150 + i, "others stand apart") for i in range(150)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "same here")], "item_id long, text string")
    assert [(r["rank"], r["doc_id"]) for r in lexical.search(d, q, 5).orderBy("rank").collect()] == [(i + 1, i) for i in range(5)]


def test_empty_searches(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == [] == lexical.search(docs, items.limit(0)).collect()
    assert lexical.search(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), items).collect() == []


def test_terms_keep_other_scripts():
    text = "Ab-c_D9 İSTANBUL ÉTÉ 世界 x\x00y\x7fz"
    assert [t.decode() for t in lexical.terms(text.encode())] == plain_terms(text)


def plain_top(rows, k, every):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < topk.LIMIT for x in v):
            q = [math.floor(256 * x) for x in v]
            vectors[i] = min(vectors.get(i, q), q)
    out = []
    for i, q in vectors.items():
        if i % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors.items() if j != i and len(v) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("spread", [3, 400])
def test_top_products_are_exact(spark, small_buckets, spread):
    rng = np.random.default_rng(spread)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-spread, spread + 1, size=(500, 5)) / 256.0)]
    common = rows[3][1]
    rows += [(500 + i, common) for i in range(120)]  # one very common vector
    rows += [(700, None), (701, [1.0, None, 0.0, 0.0, 0.0]), (702, [float("nan")] * 5), (703, [float("inf")] * 5), (704, [0.0] * 5), (705, [1.0, 2.0]), (720, [2.0, 1.0]), (740, []), (760, [1e9] * 5)]
    rows += [(0, [1.0] * 5), (0, [1.0] * 5), (None, common), (780, [60000.0, -60000.0, 3.0, 4.0, 5.0]), (-20, common)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "2 AS block", "'x' AS q")
    got = [tuple(r) for r in topk.top_inner_products(df, 4, 20).collect()]
    assert sorted(got) == sorted(plain_top(rows, 4, 20))


def test_top_products_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_inner_products(df).collect() == []
    alone = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_inner_products(alone).collect() == []


def test_reading_stops_early():
    """Where few rows stand out, bounds exclude the others before the lists are read out."""
    rng = np.random.default_rng(1)
    x = rng.integers(-4, 5, size=(4000, 16))
    x[:6] = 200
    lists = topk.SortedLists(np.arange(4000), x)
    kept = topk.survivors(lists, np.full((1, 16), 50), 5, np.array([-np.inf]), np.array([-1]))[0]
    assert set(range(6)) <= set(kept) and lists.depth < 4000
