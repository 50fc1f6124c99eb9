"""Boosted trees against plain loops, and what they must not look at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import boosting

RNG = np.random.default_rng(11)
N, K = 90, 3
X = np.column_stack([RNG.integers(0, 12, N), RNG.integers(0, 2, N), np.round(RNG.normal(size=N), 1)]).astype(float)
X[RNG.random((N, 3)) < 0.1] = np.nan
Y = (np.nan_to_num(X[:, 0]) // 4).astype(int) % K
Y[RNG.random(N) < 0.1] = 0
TRAIN = 60


def table(spark, y=Y):
    rows = [(k, [None if np.isnan(v) else float(v) for v in X[k]], int(Y[k] if k < TRAIN else y[k]), "train" if k < TRAIN else "test") for k in range(N)]
    return spark.createDataFrame(rows, "row_id long, features array<double>, y int, split string")


def plain(rounds, depth, rate=0.1, ridge=1.0, least=1e-6):
    """Row by row and split by split on the values themselves."""
    x = X.copy()
    for f in range(x.shape[1]):
        x[np.isnan(x[:, f]), f] = np.nanmedian(X[:TRAIN, f])
    share = np.bincount(Y[:TRAIN], minlength=K) / TRAIN
    raw = np.tile(np.log(share), (N, 1))
    unit = 1 << 24
    for _ in range(rounds):
        p = np.exp(raw) / np.exp(raw).sum(axis=1, keepdims=True)
        for k in range(K):
            g = [int(np.rint((p[i, k] - (Y[i] == k)) * unit)) for i in range(TRAIN)]
            h = [int(np.rint(p[i, k] * (1 - p[i, k]) * unit)) for i in range(TRAIN)]
            part = lambda s: (sum(g[i] for i in s) / unit) ** 2 / (sum(h[i] for i in s) / unit + ridge)  # noqa: E731, B023

            def grow(inside, everyone, level):
                best = None
                if level < depth:
                    for f in range(x.shape[1]):
                        for cut in sorted({x[i, f] for i in inside})[:-1]:
                            a, b = [i for i in inside if x[i, f] <= cut], [i for i in inside if x[i, f] > cut]
                            gain = part(a) + part(b) - part(inside)
                            if gain > least and (best is None or gain > best[0] + 1e-12):
                                best = (gain, f, cut, a, b)
                if best is None:
                    value = -rate * (sum(g[i] for i in inside) / unit) / (sum(h[i] for i in inside) / unit + ridge)
                    raw[everyone, k] += value
                    return
                _, f, cut, a, b = best
                grow(a, [i for i in everyone if x[i, f] <= cut], level + 1)
                grow(b, [i for i in everyone if x[i, f] > cut], level + 1)

            grow(list(range(TRAIN)), list(range(N)), 0)
    e = np.exp(raw)
    return e / e.sum(axis=1, keepdims=True)


def result(rows, **options):
    got = boosting.boosted(rows, K, **options).orderBy("row_id").collect()
    return [r.label for r in got], np.array([r.probabilities for r in got])


def test_trees_are_those_of_plain_loops(spark):
    # 12 rounds: scores are written once on the way
    labels, p = result(table(spark).repartition(3), rounds=12, depth=2, rate=0.1)
    want = plain(12, 2)[TRAIN:]
    assert np.abs(p - want).max() < 1e-6
    assert labels == want.argmax(axis=1).tolist()
    assert np.mean(np.array(labels) == Y[TRAIN:]) > 0.7


def test_partitions_and_test_labels_change_nothing(spark):
    a = result(table(spark).repartition(5), rounds=3, depth=3)
    b = result(table(spark, np.zeros(N, int)).coalesce(1), rounds=3, depth=3)
    assert a[0] == b[0] and (a[1] == b[1]).all()


def test_budgets_classes_and_missing_columns(spark):
    rows = table(spark)
    few = result(rows, per_class=4, rounds=2, depth=2)
    assert len(few[0]) == N - TRAIN
    with pytest.raises(ValueError):
        boosting.boosted(rows.where("y <> 1 or split = 'test'"), K)
    nothing = rows.withColumn("features", F.array(F.lit(None).cast("double"), F.lit(None).cast("double")))
    labels, p = result(nothing, rounds=2, depth=2)
    # without any value every row gets the classes' shares
    assert len(set(labels)) == 1 and np.abs(p - np.bincount(Y[:TRAIN], minlength=K) / TRAIN).max() < 1e-6
    assert boosting.predict(boosting.fit(rows.where("split = 'train'"), K, rounds=1, depth=1), rows.limit(0)).count() == 0


def test_missing_categories_have_a_slot_and_no_value_may_spell_it(spark):
    from gradeloom.operators import features

    rows = spark.createDataFrame([(1, 2.0, "a"), (2, None, None), (3, 1.0, "b"), (4, 0.0, "new")], "row_id long, acctbal double, nation string")
    train = rows.where("row_id < 4")
    got = {r.row_id: list(r.features) for r in features.numeric_matrix(rows, train, ["acctbal"], "nation").collect()}
    # slots in order: the marker, a, b; a level that training lacks is all zeros
    assert got == {1: [2.0, 0, 1, 0], 2: [None, 1, 0, 0], 3: [1.0, 0, 0, 1], 4: [0.0, 0, 0, 0]}
    with pytest.raises(ValueError):
        features.one_hot(rows.withColumn("nation", F.lit(features.MISSING_LEVEL)), train, "nation")


def test_rows_of_one_file_are_dealt_over_all_cores(spark):
    train = spark.createDataFrame([([float(k % 9), None if k % 5 == 0 else 1.0], k % 2) for k in range(400)], "features array<double>, y int").coalesce(1)
    start = boosting._start(boosting.begin(train, 2), train)
    assert start.count() == 400 and start.select(F.spark_partition_id()).distinct().count() == min(400, spark.sparkContext.defaultParallelism)
