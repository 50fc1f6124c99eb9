"""Forests from counts: against plain loops over the rows of a bag, Spark ML's forest, and what must not matter."""

import numpy as np
import pytest

from gradeloom.operators import features, forest

RNG = np.random.default_rng(5)
SCHEMA = "row_id long, acctbal double, nation string, label int"


def made(n=400):
    """A class that follows from the number's sign and the level, but for one row in ten."""
    out = []
    for k in range(n):
        v, s = float(np.round(RNG.normal(), 2)), "abcd"[RNG.integers(4)]
        label = int(RNG.integers(3)) if RNG.random() < 0.1 else int(v > 0) + int(s == "b" and v > 0)
        out.append((k, None if RNG.random() < 0.1 else v, None if RNG.random() < 0.05 else s, label))
    return out


ROWS = made()


def plain_tree(rows, cell, depth):
    """Shares of the leaf that ``cell`` falls in; every feature is tried in every node. rows: (bin, slot, label)."""
    n = len(rows)
    share = lambda some: [sum(r[2] == k for r in some) for k in range(3)]
    gini = lambda some: 1 - sum((x / len(some)) ** 2 for x in share(some))
    best = (1e-9, None)
    if depth and gini(rows) > 0:
        for test in [*[(0, c) for c in range(5)], *[(1, s) for s in range(3)]]:
            left = [r for r in rows if (r[0] <= test[1] if test[0] == 0 else r[1] != test[1])]
            right = [r for r in rows if r not in left]
            if left and right:
                gain = gini(rows) - len(left) / n * gini(left) - len(right) / n * gini(right)
                best = max(best, (gain, test), key=lambda x: x[0])
    if best[1] is None:
        return [x / n for x in share(rows)]
    f, c = best[1]
    goes = lambda r: r[0] <= c if f == 0 else r[1] != c
    return plain_tree([r for r in rows if goes(r) == goes(cell)], cell, depth - 1)


def test_a_tree_of_counts_is_the_tree_of_its_rows():
    for depth in (1, 3, 30):
        rows = [(int(RNG.integers(6)), int(RNG.integers(4)), int(RNG.choice(3, p=[0.6, 0.3, 0.1]))) for _ in range(60)]
        bag = np.zeros((6, 4, 3))
        np.add.at(bag, tuple(np.array(rows).T), 1)

        class Every:
            def choice(self, width, tries, replace):
                return np.arange(width)

        got = forest.tree(bag, Every(), 4, depth)
        for b, s, _ in rows:
            assert np.allclose(got[b, s], plain_tree(rows, (b, s), depth)), (depth, b, s)


def result(spark, train, test=None, **options):
    a, b = (x if hasattr(x, "columns") else spark.createDataFrame(x, SCHEMA) for x in (train, test or train))
    return {r.row_id: (r.y, r.label) for r in forest.forest(a, b, "acctbal", "nation", **options).collect()}


def test_order_and_partitions_of_the_rows_change_nothing(spark):
    one = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    many = spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(7)
    assert result(spark, one, ROWS, trees=40) == result(spark, many, ROWS, trees=40)


def test_as_good_as_spark_mls_forest(spark):
    train, test = ROWS[:300], ROWS[300:]
    ours = result(spark, train, test)
    theirs = features.fit_predict_native(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA), 50, 10).collect()
    right = np.mean([a == b for a, b in ours.values()])
    assert len(ours) == 100 and right > 0.7
    assert abs(right - np.mean([r.y == r.label for r in theirs])) < 0.1
    assert np.mean([ours[r.row_id][1] == r.label for r in theirs]) > 0.85


def test_missing_values_new_levels_and_empty_training(spark):
    train = [(k, None, None, 1) for k in range(5)]
    assert set(result(spark, train, [(9, 3.0, "new", 0), (10, None, None, 0)], trees=20).values()) == {(0, 1)}
    with pytest.raises(ValueError, match="training rows"):
        result(spark, spark.createDataFrame([], SCHEMA), train)


def test_bins(spark):
    few = spark.createDataFrame([(float(v),) for v in [1] * 500 + [2, 4]], "v double")
    assert forest.cuts_of(few, "v", 32) == [1.5, 3.0]
    many = spark.range(1000).selectExpr("cast(id as double) v")
    assert forest.cuts_of(many, "v", 4) == [249.75, 499.5, 749.25]
