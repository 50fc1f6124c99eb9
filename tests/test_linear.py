"""Linear classifiers against plain numpy, and the rules of tuning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import features, linear

RNG = np.random.default_rng(3)
N, WIDTH, K = 120, 25, 3
X = np.where(RNG.random((N, WIDTH)) < 0.2, RNG.random((N, WIDTH)), 0)
Y = (X @ RNG.normal(size=(WIDTH, K)) + RNG.normal(size=(N, K)) * 0.3).argmax(axis=1)


def slope(method, w, strength):
    """Gradient of the objective, dense and row by row."""
    g, pull = np.zeros_like(w), w / (strength * N)
    if method == "logistic":
        pull[:, -1] = 0
    for x, y in zip(X, Y, strict=True):
        z = np.append(x, 1.0)
        s = w @ z
        if method == "logistic":
            p = np.exp(s - s.max())
            r = p / p.sum() - (np.arange(K) == y)
        else:
            sign = np.where(np.arange(K) == y, 1, -1)
            r = -2 * sign * np.maximum(0, 1 - sign * s)
        g += np.outer(r, z)
    return g / N + pull


@pytest.mark.parametrize("method", ["logistic", "svm"])
def test_fits_reach_the_optimum(spark, method):
    rows = spark.createDataFrame([(k, int(Y[k]), np.flatnonzero(X[k]).tolist(), X[k][X[k] != 0].tolist()) for k in range(N)], "row_id long, y int, idx array<int>, w array<double>").repartition(3)
    for strength in (0.1, 10.0):
        m = linear.fit(rows, method, K, WIDTH, strength, steps=300, tolerance=1e-5)
        assert m.slope <= 1e-5 and np.abs(slope(method, m.weights, strength)).max() < 2e-5
    got = {r.row_id: r for r in linear.predict(m, rows).collect()}
    want = (np.column_stack([X, np.ones(N)]) @ m.weights.T).argmax(axis=1)
    assert [got[k].label for k in range(N)] == want.tolist()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in got.values()) if method == "logistic" else got[0].probabilities is None
    empty = spark.createDataFrame([(1, 0, [], [])], rows.schema)
    assert linear.predict(m, empty).count() == 1 and linear.predict(m, rows.limit(0)).count() == 0


def corpus(spark, test_label=0):
    words = {0: "red apple tree", 1: "blue river boat"}
    rows = [(k, f"{words[k % 2]} common words number {k % 5}", k % 2, "train" if k < 24 else "validation") for k in range(36)]
    rows += [(100 + k, f"{words[k % 2].split()[0]} {words[k % 2].split()[2]} something", test_label, "test") for k in range(6)]
    return spark.createDataFrame(rows, "row_id long, text string, label int, split string")


def test_tuning_looks_at_validation_and_not_at_test_labels(spark):
    candidates = [("logistic", 0.1), ("logistic", 1.0), ("bayes", 1.0)]
    runs = [features.tuned(corpus(spark, y), candidates, 2, words=200, chars=300) for y in (0, 1)]
    labels = [sorted((r.row_id, r.label) for r in p.collect()) for p, _ in runs]
    assert labels[0] == labels[1] == [(100 + k, k % 2) for k in range(6)]
    trials = runs[0][1].orderBy("trial").collect()
    assert [t.macro_f1 for t in trials] == [1.0, 1.0, 1.0] and [t.chosen for t in trials] == [True, False, False]  # the first of equal ones
    assert runs[0][0].where(F.col("latency_s") > 0).count() == 6


def test_equal_budgets_fit_one_fixed_candidate(spark):
    predictions, trials = features.tuned(corpus(spark), [("logistic", c) for c in (0.1, 1.0, 10.0)], 2, per_class=3, words=200, chars=300)
    t = trials.collect()
    assert len(t) == 1 and t[0].strength == 1.0 and t[0].macro_f1 is None and t[0].chosen and predictions.count() == 6
    with pytest.raises(ValueError):
        features.tuned(corpus(spark).where("label = 0"), [("logistic", 1.0)], 2, per_class=3)


def test_slopes_from_the_feature_table(spark):
    rows = corpus(spark).where("split <> 'test'").withColumnRenamed("split", "source_split")
    vectors, weights, width = features.text_vectors(rows, 200, 300)
    train = vectors.where("source_split = 'train'")
    m = features.fit_text("logistic", train, 1.0, 2, width)
    assert features.optimality(m, train, weights, 1.0).first().steepest < 2e-5
    m.weights[0, 3] += 1
    assert features.optimality(m, train, weights, 1.0).first().steepest > 1e-3


def test_terms_are_neither_shuffled_by_row_nor_written(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "Ab cd ab cd", 0, "train"), (1, "cd ef", 1, "train"), (2, "ab zz", 0, "test"), (3, None, 0, "train")], "row_id long, text string, label int, source_split string")
    monkeypatch.setattr(features, "materialized", None)
    for terms, size in ((features.word_terms(rows), 5), (features.char_terms(rows, 3, 4), 9)):
        out = features.tfidf(terms, rows, size)
        assert "term" not in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in x)
        norms = out.groupBy("row_id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()
        assert {r.row_id for r in norms} == {1, 2} and all(abs(r.s - 1) < 1e-9 for r in norms)
    # labels of a row that repeats are counted apart
    counts = {(r.row_id, r.label, r.term): r.tf for r in features.term_counts(features.word_terms(rows)).collect()}
    assert counts == {(1, 0, "ab"): 2, (1, 0, "cd"): 2, (1, 0, "ab cd"): 2, (1, 0, "cd ab"): 1, (1, 1, "cd"): 1, (1, 1, "ef"): 1, (1, 1, "cd ef"): 1, (2, 0, "ab"): 1, (2, 0, "zz"): 1, (2, 0, "ab zz"): 1}


def test_vectors_hold_the_terms_weights(spark):
    rows = spark.createDataFrame([(1, "Ab cd ab cd", 0, "train"), (1, "cd ef", 1, "train"), (2, "ab zz a", 0, "test"), (3, None, 0, "train"), (4, "zz cd\tzz", 1, "train")], "row_id long, text string, label int, source_split string")
    vectors, _, width = features.text_vectors(rows, 4, 9)
    want: dict = {}
    for terms, size in ((features.char_terms(rows, 3, 5), 9), (features.word_terms(rows), 4)):
        for r in features.tfidf(terms, rows, size).collect():
            want.setdefault(r.row_id, []).append(round(r.w, 9))
    got = vectors.collect()
    assert width == 13 and sorted(r.row_id for r in got) == [1, 1, 2, 3, 4] and sorted(r.y for r in got) == [0, 0, 0, 1, 1]
    assert {r.row_id: sorted(round(w, 9) for w in r.w) for r in got if r.w} == {k: sorted(v) for k, v in want.items()}


def test_a_step_shuffles_no_more_with_more_files(spark, monkeypatch):
    """Blocks are packed once, and a step has no more tasks than there are cores."""
    rows = spark.createDataFrame([(k, k % 2, [k % 7], [1.0]) for k in range(64)], "row_id long, y int, idx array<int>, w array<double>").repartition(40)
    blocks, seen = linear.packed(rows), []
    assert linear.packed(blocks) is blocks and sum(len(r.y) // 4 for r in blocks.collect()) == 64
    real = linear.summed
    monkeypatch.setattr(linear, "summed", lambda b, *a: seen.append(b) or real(b, *a))
    m = linear.fit(rows, "logistic", 2, 7, 1.0)
    assert m.slope <= 1e-5 and all(b.dtypes == blocks.dtypes for b in seen) and linear.fit(blocks, "logistic", 2, 7, 1.0, start=m.weights).steps == 0


def test_naive_bayes_is_sparks(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.linalg import Vectors

    data = [(int(Y[k]), Vectors.dense(X[k])) for k in range(N)]
    rows = spark.createDataFrame([(k, int(Y[k]), np.flatnonzero(X[k]).tolist(), X[k][X[k] != 0].tolist()) for k in range(N)], "row_id long, y int, idx array<int>, w array<double>")
    want = NaiveBayes(smoothing=0.1).fit(spark.createDataFrame(data, ["label", "features"]))
    got = linear.bayes(rows, K, WIDTH, 0.1).weights
    assert np.abs(got[:, :-1] - want.theta.toArray()).max() < 1e-9 and np.abs(got[:, -1] - want.pi.toArray()).max() < 1e-9
