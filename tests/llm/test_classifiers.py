"""Quality and toxicity: held-out ranking, odd rows, and the parts against plain versions."""

import numpy as np
import pytest

from atomframe.llm import quality, toxicity


def _auc(score, label):
    score, label = np.asarray(score), np.asarray(label)
    good, bad = score[label == 1], score[label == 0]
    return ((good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()) if len(good) and len(bad) else 1.0


def _labelled(spark, text_of, label, n=600):
    rng = np.random.default_rng(9)
    rows = [(i, text_of(rng, i % 3 == 0), int(i % 3 == 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {label} int")
    return docs, labels, np.array([y for *_, y in rows])


def _words(rng, n):
    return [f"w{rng.integers(300)}x" for _ in range(n)]


def test_quality_separates(spark):
    def text(rng, good):
        words = _words(rng, int(rng.integers(20, 90)))
        return " ".join(words) + "." if good else " ".join(w for w in words[:9] for _ in range(6))

    docs, labels, y = _labelled(spark, text, "quality", 200)
    model = quality.train(docs, labels)
    got = sorted(docs.select("doc_id", quality.scorer(model)("text").alias("s")).collect())
    assert _auc([r["s"] for r in got], y) > 0.99
    assert np.mean([(r["s"] >= quality.THRESHOLD) == t for r, t in zip(got, y)]) > 0.98


def test_quality_score_is_the_density_difference():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(200, 3)) @ np.diag([1, 2, 0.5]) + 1])
    y = np.repeat([0, 1], [300, 200])
    model = quality.fit(x, y)
    z = (x - model.centre) / model.scale
    logs = []
    for k in (0, 1):
        cov = np.linalg.inv(model.whiten[k].T @ model.whiten[k])
        d = z - model.means[k]
        logs.append(np.log((y == k).mean()) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov)))
    d = logs[1] - logs[0]
    assert np.allclose(np.sign(d) * np.log1p(np.abs(d)), model.difference(x))


def test_toxicity_finds_words_and_stems(spark):
    def text(rng, toxic):
        words = _words(rng, 60)
        if toxic:
            words[int(rng.integers(60))] = ["nastyword", f"grumb{_words(rng, 1)[0]}"][int(rng.integers(2))]
        return " ".join(words)

    docs, labels, y = _labelled(spark, text, "toxic")
    model = toxicity.train(docs, labels)
    assert "nastyword" in model.lexicon and "5:grumb" in model.lexicon
    got = sorted(docs.select("doc_id", toxicity.scorer(model)("text").alias("s")).collect())
    assert _auc([r["s"] for r in got], y) > 0.98


def test_toxicity_undoes_disguises():
    lexicon = {"stupid": (5.0, 50.0)}
    plain, hidden = (toxicity.features(t, lexicon, {}) for t in ("so nice all of you", "so s7upid all stuuupid"))
    assert sum(hidden) > sum(plain) and hidden != plain


def test_isotonic_against_definition():
    rng = np.random.default_rng(8)
    p = rng.random(60).round(1)
    y = (rng.random(60) < p).astype(int)
    knots, heights = toxicity.isotonic(p, y)
    assert (np.diff(heights) >= 0).all() and (np.diff(knots) >= 0).all()
    fitted = np.interp(p, knots, heights)
    assert abs(fitted.mean() - y.mean()) < 1e-9
    # min-max formula of the monotone fit
    levels = np.unique(p)
    for x in levels:
        best = max(min(y[(p >= a) & (p <= b)].mean() for b in levels[levels >= x]) for a in levels[levels <= x])
        assert np.interp(x, knots, heights) == pytest.approx(best)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_few_labels(spark, odd_docs, no_docs, module, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    few = spark.createDataFrame([(1, 1), (2, None), (None, 1), (5, 0)], f"doc_id long, {label} int")
    for labels in (none, few):
        model = module.train(odd_docs, labels)
        scores = [r["v"] for r in odd_docs.select(module.scorer(model)("text").alias("v")).collect()]
        assert len(scores) == 9 and all(0 <= s <= 1 for s in scores)
    assert no_docs.select(module.scorer(model)("text")).count() == 0


def test_measures_of_odd_texts():
    for text in ("", " ", "a", "x" * 100000, "A\n" * 5000, "😀".encode("utf-16", "surrogatepass").decode("utf-16")):
        assert np.isfinite(quality.statistics(text)).all()
        assert np.isfinite(toxicity.features(text, {}, {})).all()


def test_sample_is_bounded_by_ids(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(i, "other") for i in range(100, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 1), (7, 0)], "doc_id long, quality int")
    rows = quality.labelled_sample(docs, labels, "quality", quality.FOLDS, quality.HELD_OUT, 150).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) <= 150
    assert [r["text"] for r in rows if r["doc_id"] == 7] in ([], ["text 0"])


def test_quality_shrinks_covariances():
    """The kept factors against the definition of the shrunken class covariances."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)), rng.normal(size=(120, 4)) + 1])
    y = np.repeat([0, 1], [200, 120])
    model = quality.fit(x, y)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    own = [sum(np.outer(r - z[y == k].mean(axis=0), r - z[y == k].mean(axis=0)) for r in z[y == k]) / (y == k).sum() for k in (0, 1)]
    pooled = sum(o * (y == k).mean() for k, o in enumerate(own))
    for k in (0, 1):
        mixed = (1 - quality.TO_POOLED) * own[k] + quality.TO_POOLED * pooled
        wanted = mixed * (1 - quality.TO_DIAGONAL) + np.diag(np.diag(mixed)) * quality.TO_DIAGONAL + 1e-4 * np.eye(4)
        factor = np.linalg.inv(model.whiten[k])
        assert np.allclose(factor @ factor.T, wanted)


def test_first_tree_takes_the_best_cuts():
    """The first tree against a search over all cuts, feature by feature and node by node."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, size=(400, 3)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] < 4) | (rng.random(400) < 0.1)).astype(float)
    start, trees = toxicity.boost(x, y)
    p = y.mean()
    slope, curve = np.full(400, p) - y, np.full(400, p * (1 - p))
    assert start == pytest.approx(np.log(p / (1 - p)))
    score = lambda rows: slope[rows].sum() ** 2 / (curve[rows].sum() + toxicity.SMOOTH)

    def grow(rows, node, depth):
        tree = trees[0]
        if depth == toxicity.DEPTH:
            value = -toxicity.RATE * slope[rows].sum() / (curve[rows].sum() + toxicity.SMOOTH)
            assert tree.value[node - (2**depth - 1)] == pytest.approx(value)
            return
        cuts = [(score(rows[x[rows, f] <= v]) + score(rows[x[rows, f] > v]) - score(rows), f, v) for f in range(3) for v in range(6)]
        best = max(c[0] for c in cuts)
        right = x[rows, tree.feature[node]] > tree.bound[node]
        if best > 1e-6:
            assert score(rows[~right]) + score(rows[right]) - score(rows) == pytest.approx(best)
        grow(rows[~right], 2 * node + 1, depth + 1)
        grow(rows[right], 2 * node + 2, depth + 1)

    grow(np.arange(400), 0, 0)


@pytest.mark.parametrize("name,label,query", [("op2", "quality", quality.op2_quality_discriminant), ("op3", "toxic", toxicity.op3_toxicity_trees)])
def test_held_out_documents_are_told_apart(spark, sf_dir, name, label, query):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in query(spark, folder).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(rows) > 300 and _auc([r["score"] for r in rows], [labels[r["doc_id"]] for r in rows]) > 0.95
