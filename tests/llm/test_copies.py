"""Near-duplicate texts, near vectors and fingerprints, against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash

from atomframe.llm import embeddings, fingerprints, near_dups


def _roots(n, links):
    home = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(home[a], home[b])
            if home[a] != low or home[b] != low:
                home[a] = home[b] = low
                changed = True
    return home


def _set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(base)] * 3
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(120)] = f"n{rng.randrange(9)}"
        texts.append(" ".join(words))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(40)) for _ in range(40)]
    texts += ["", "A b", "a  B", "x"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    home = _roots(len(sets), links)
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(docs).collect()}
    assert [got[i]["n_shingles"] for i in range(len(sets))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(sets))] == home
    assert [got[i]["kept"] for i in range(len(sets))] == [h == i for i, h in enumerate(home)]


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(odd_docs).collect()}
    assert got[2]["component_id"] == 1 and not got[2]["kept"]
    assert all(got[i]["kept"] for i in (1, 3, 4, 5, 6, 7, 8, None))
    kept = near_dups.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 8
    assert near_dups.near_duplicates(no_docs).count() == 0


def test_least_matches_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    equal = rng.random((20000, 128)) < 0.75
    lost = np.zeros(len(equal), bool)
    for step, need in enumerate(near_dups.least_matches(0.75), 1):
        lost |= equal[:, : step * near_dups.BATCH].sum(axis=1) < need
    assert lost.mean() < 1e-3


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 64))
    v = [c / np.linalg.norm(c) + rng.normal(size=64) * s / 8 for c in centres for s in (0, 0.1, 0.2, 0.3, 0.35, 0.0)]
    v = np.array(v, dtype=np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 64), (n + 3, [float("nan")] + [1.0] * 63), (n + 4, [None] + [1.0] * 63), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0])]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    z = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = (z @ z.T) >= 0.95
    np.fill_diagonal(near, False)
    assert [got[i]["n_links"] for i in range(n)] == near.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(n)] == _roots(n, list(zip(*np.nonzero(near))))
    assert all(got[n + i]["n_links"] == 0 and got[n + i]["kept"] for i in range(5))
    assert got[n + 6]["component_id"] == n + 5 and got[n + 5]["n_links"] == 1


def test_vectors_of_any_size_are_compared_in_double_precision(spark):
    close = [3.0, 1.0, 2.0 + 1e-12]
    rows = [(0, [1e-60, 0.0]), (1, [1e-60, 0.0]), (2, [0.0, 1e60]), (3, [0.0, 2e60]), (4, [-1e300, 1e300]), (5, [-1e-300, 1e-300]), (6, [3.0, 1.0, 2.0]), (7, close)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rep", "2 AS k1", "'x' AS v", "3 AS cell")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(docs).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}


def test_vectors_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(none).collect() == []
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] is not None) == [(1, 1), (1, 1)]
    assert all(r["n_links"] == 0 and r["component_id"] is None and r["kept"] for r in got if r["vec_id"] is None) and len(got) == 4


@pytest.mark.parametrize("dim", [16, 64])
def test_recall_just_above_the_threshold(dim):
    """Pairs at cosine 0.9505 to 0.956 meet in one of the tables."""
    rng = np.random.default_rng(dim)
    x = embeddings.unit_rows(rng.normal(size=(800, dim)))
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    cosine = rng.uniform(0.9505, 0.956, size=(len(x), 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * embeddings.unit_rows(side)
    (home_x, probe_x), (home_y, probe_y) = embeddings.cells(x), embeddings.cells(y)
    near = [(home_x[:, :, None] == np.concatenate([home_y[:, :, None], probe_y], axis=2)), home_y[:, :, None] == probe_x]
    met = near[0].any(axis=(1, 2)) | near[1].any(axis=(1, 2))
    assert met.mean() > 0.99


def test_lattice_decoding_is_nearest():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8)) * 2
    point = embeddings.decode(x)
    roots = embeddings.lattice_neighbours()
    assert len(roots) == 240 and np.allclose((roots**2).sum(axis=1), 2)
    own = ((x - point) ** 2).sum(axis=1)
    others = ((x[:, None] - point[:, None] - roots[None]) ** 2).sum(axis=2).min(axis=1)
    assert (own <= others + 1e-9).all() and (own <= 1 + 1e-9).all()


def test_fingerprints(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(fingerprints.fingerprints(docs).collect(), key=lambda r: r["doc_id"])
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").collect()]
    by_text = {}
    for i, (r, t) in enumerate(zip(rows, texts)):
        following, half = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert np.mean([r["near_edited"] for r in rows]) > 5 * np.mean([r["near_next"] for r in rows])
    odd = {r["doc_id"]: r for r in fingerprints.fingerprints(odd_docs).collect()}
    assert odd[1]["near_next"] == 1.0 and odd[1]["fingerprint"] == odd[2]["fingerprint"]
    assert odd[3]["fingerprint"] == odd[4]["fingerprint"] and odd[3]["near_next"] == 1.0
    assert fingerprints.fingerprints(no_docs).count() == 0


def test_lexicon_counts_all_documents(spark):
    docs = spark.createDataFrame([(i, f"all half{i % 2} one{i}") for i in range(100)], "doc_id long, text string")
    found = fingerprints.lexicon(docs, 0.5, 1.0).count()
    assert found == 2 and fingerprints.lexicon(docs, 4.0, 5.0).count() == 100


def _hash(*values):
    """Spark's xxhash64 of texts, longs, and ints given as (int, 4)."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - 2**64 if h >= 2**63 else h


def _plain_fingerprint(terms, lexicon):
    used = sorted(terms & lexicon) or sorted(terms)
    out = []
    for chance in fingerprints.CHANCES:
        slots = {t: _hash(t, (fingerprints.SEED + chance, 4)) % chance for t in used}
        for subset in range(fingerprints.SUBSETS):
            chosen = [t for t in used if slots[t] == subset]
            out.append(_hash(*chosen) % 2**32 if chosen else None)
    return out


def _plain_likeness(a, b):
    n, share = fingerprints.SUBSETS, float(a == b)
    for i in range(len(fingerprints.CHANCES)):
        pairs = [(x, y) for x, y in zip(a[i * n : (i + 1) * n], b[i * n : (i + 1) * n]) if x is not None or y is not None]
        if len(pairs) >= (1 if i == 0 else n // 4):
            share = sum(x == y for x, y in pairs) / len(pairs)
    return share


def test_fingerprints_against_a_plain_version(spark, sf_dir):
    """Lexicon band, subsets, hashes and likeness of every document and its edit, recomputed one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "..."), (903, "zzqx")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    terms = lambda text: {_hash(w) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}
    df = Counter(t for text in texts.values() for t in terms(text))
    lexicon = {t for t, n in df.items() if fingerprints.LOW <= math.log(len(texts) / n) <= fingerprints.HIGH}
    own = {i: _plain_fingerprint(terms(t), lexicon) for i, t in texts.items()}
    said = lambda hashes: ".".join("-" if h is None else f"{h:08x}" for h in hashes)
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    for i, following in zip(ids, [*ids[1:], ids[0]]):
        text, half = texts[i], len(texts[i]) // 2
        edited = _plain_fingerprint(terms(text[: len(text) - half] + texts[following][:half]), lexicon)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (said(own[i]), said(edited))
        assert got[i]["near_edited"] == pytest.approx(_plain_likeness(own[i], edited))
        assert got[i]["near_next"] == pytest.approx(_plain_likeness(own[i], own[following]))
