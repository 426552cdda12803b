"""The pipeline's stages, each against a plain version on its own input."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from atomframe.llm import common, mixing, near_dups, packing, quality, toxicity


def plain_components(texts, per_cent):
    """Smallest id reachable over all pairs whose shingle sets reach the threshold."""
    sets = {}
    for i, text in texts.items():
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    home = {i: i for i in texts}

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[:at]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= per_cent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                home[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def plain_mixture(rows):
    """How often each id is drawn: exponent by bisection, whole passes, then all that still fits in its turn."""
    size = {r["doc_id"]: len(re.findall(common.WORD, r["text"] or "")) for r in rows}
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += size[r["doc_id"]]
    total = sum(tokens.values())
    p = np.array([n / total for n in tokens.values() if n])

    def lowest(ok):
        low, high = 0.0, 1.0
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (low, mid) if ok(mid) else (mid, high)
        return high

    def entropy(x):
        w = p**x / (p**x).sum()
        return -(w * np.log(w)).sum()

    target = entropy(1.0) + (np.log(len(p)) - entropy(1.0)) * mixing.ENTROPY_SHARE
    x = lowest(lambda x: entropy(x) < target)
    if (1 / p).max() / len(p) > mixing.MAX_REPEATS:
        x = max(x, lowest(lambda x: (p ** (x - 1)).max() / (p**x).sum() < mixing.MAX_REPEATS))
    x = round(x, 6)
    drawn = Counter()
    for source, n in tokens.items():
        ids = [r["doc_id"] for r in rows if r["source"] == source]
        weight = round((n / total) ** x / (p**x).sum(), mixing.DIGITS) if n else 0.0
        passes, rest = divmod(round(weight * total), n) if n else (1, 0)
        turn = lambda i: hashlib.md5(f"{mixing.SEED}:{passes}:{i}:{size[i]}".encode()).hexdigest()  # noqa: E731, B023
        for i in sorted(ids, key=turn):
            fits = rest > 0 and size[i] <= rest if n else False
            # a source's unfinished pass goes on with documents without tokens when nothing is left
            fits = fits or bool(n and size[i] == 0 and round(weight * total) % n)
            drawn[i] += passes + fits
            rest -= size[i] if fits else 0
    return +drawn


def least_padding(lengths, buckets):
    """The least sum of padded lengths with so many buckets, over all choices of bounds."""
    sizes = sorted(n for n in lengths if n)
    cost = {0: 0}
    for _ in range(buckets):
        nxt = dict(cost)
        for i, done in cost.items():
            rows = 0
            for j in range(i, len(sizes)):
                rows += lengths[sizes[j]]
                nxt[j + 1] = min(nxt.get(j + 1, np.inf), done + rows * sizes[j])
        cost = nxt
    return cost[len(sizes)]


@pytest.mark.parametrize("place", range(5))
def test_stages_of_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs, place):
    """Nulls, empty and repeated texts, repeated rows and clashing names pass every stage."""
    name, stage = corpus_pipeline.STAGES[place]
    assert stage(spark, no_docs, sf_dir).collect() == []
    twice = odd_docs.unionByName(odd_docs.filter("doc_id = 5"))
    out = stage(spark, twice, sf_dir)
    ids = Counter(r["doc_id"] for r in out.collect())
    if name != "packing":
        assert out.columns == odd_docs.columns
    if name == "near_duplicates":
        assert ids[1] == 1 and ids[2] == 0 and ids[None] == 1 and ids[5] == 2
    if name == "packing":
        assert sum(ids.values()) == 10


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        after = [r.asDict() for r in out.collect()]
        if name == "quality":
            model = quality.train(docs, labels)
            scores = model.score(np.array([quality.statistics(r["text"] or "") for r in before]))
            assert out.columns == columns
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, s in zip(before, scores) if s >= quality.THRESHOLD)
        elif name == "toxicity":
            model = toxicity.train(docs, labels)
            scores = model.score(np.array([toxicity.features(r["text"] or "", model.lexicon, {}) for r in before]))
            assert out.columns == columns
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, s in zip(before, scores) if s < toxicity.THRESHOLD)
        elif name == "near_duplicates":
            home = plain_components({r["doc_id"]: r["text"] for r in before}, near_dups.THRESHOLD)
            assert sorted(r["doc_id"] for r in after) == sorted(i for i, h in home.items() if i == h)
        elif name == "mixing":
            assert out.columns == columns
            assert Counter(r["doc_id"] for r in after) == plain_mixture(before)
        else:
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)
            lengths = Counter(r["n_tokens"] for r in after)
            assert lengths == Counter(len(re.findall(common.WORD, r["text"] or "")) for r in before)
            assert all(r["n_tokens"] <= r["padded_to"] for r in after)
            assert sum(r["padded_to"] for r in after) == least_padding(lengths, packing.BUCKETS)
        docs = spark.createDataFrame(after, docs.schema) if name != "packing" else docs
