"""Random forests on one numeric and one categorical feature, grown from counts instead of rows.

A tree sees a row only through its cell, the numeric value's bin and the level, and its class; so one pass counts the rows
of every (bin, level, class), and no later step depends on how many there are. A bag draws every row Poisson(1) times, so
a cell of n rows is drawn Poisson(n) times: the trees take these draws, a task growing some of the trees. What a tree gives
each cell is summed over the trees, and test rows look up their cell. The table of cells is bounded by bins x levels x classes.

As in Spark ML's forest, levels are single (one-hot) features, every node tries the root of their number, drawn anew,
splits lessen the Gini impurity, and a node whose drawn features cannot is a leaf.

Defined results: missing numbers take the training median (0 where training has none); missing levels and levels that
training lacks are no level; cuts are midpoints of up to ``bins`` distinct values, else exact quantiles; shares are summed
in whole units of 2^-40, so that the order and partitions of the rows change nothing; ties go to the lower class.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import materialized
from .rank import quantiles

UNIT = 1 << 40


def cuts_of(values: DataFrame, column: str, bins: int) -> list[float]:
    """At most bins - 1 cuts; a bin's values lie above the cut before it, up to its own."""
    few = sorted(r[0] for r in values.select(column).distinct().limit(bins + 1).collect())
    if len(few) <= bins:
        return [(a + b) / 2 for a, b in pairwise(few)]
    found = quantiles(values, [], column, {f"q{k}": k / bins for k in range(1, bins)}).first()
    return sorted(set(found))


def best_split(by_bin: np.ndarray, by_level: np.ndarray, tried: Iterable[int]) -> tuple[int, int] | None:
    """(feature, last bin of the left side) that lessens the impurity most; feature 0 is the numeric one, feature f
    the level f - 1. None if no tried feature does."""
    total = by_bin.sum(axis=0)
    best, most = None, total @ total / total.sum() * (1 + 1e-12)
    for f in tried:
        left = by_bin[:-1].cumsum(axis=0) if f == 0 else (total - by_level[f - 1])[None]
        n_left = left.sum(axis=1)
        right, n_right = total - left, total.sum() - n_left
        sound = (n_left > 0) & (n_right > 0)
        if sound.any():
            squares = (left**2).sum(axis=1) / np.maximum(n_left, 1) + (right**2).sum(axis=1) / np.maximum(n_right, 1)
            at = int(np.where(sound, squares, -1).argmax())
            if squares[at] > most:
                best, most = (f, at), squares[at]
    return best


def tree(bag: np.ndarray, rng: np.random.Generator, tries: int, depth: int) -> np.ndarray:
    """The class shares of every cell's leaf, for drawn counts (bins x levels and none x classes)."""
    out, width = np.zeros(bag.shape), bag.shape[1]
    nodes = [(0, bag.shape[0], np.arange(width), 0)]
    while nodes:
        a, b, levels, at_depth = nodes.pop()
        held = bag[a:b, levels]
        by_bin, by_level = held.sum(axis=1), np.zeros((width, bag.shape[2]))
        by_level[levels] = held.sum(axis=0)
        total = by_bin.sum(axis=0)
        pure = total.max() == total.sum()
        split = None if pure or at_depth == depth else best_split(by_bin, by_level, rng.choice(width, tries, replace=False))
        if split is None:
            out[a:b, levels] = total / max(total.sum(), 1)
        elif split[0] == 0:
            cut = a + split[1] + 1
            nodes += [(a, cut, levels, at_depth + 1), (cut, b, levels, at_depth + 1)]
        else:
            own = levels == split[0] - 1
            nodes += [(a, b, levels[~own], at_depth + 1), (a, b, levels[own], at_depth + 1)]
    return out


def _cells(rows: DataFrame, levels: DataFrame, n_levels: int, numeric: str, categorical: str, median: float, cuts: list[float]) -> DataFrame:
    """``rows`` with the places of their cell, bin and slot."""
    value: Column = F.coalesce(F.col(numeric).cast("double"), F.lit(median))
    edges = F.array(*map(F.lit, cuts)).cast("array<double>")
    rows = rows.withColumn("bin", F.size(F.filter(edges, lambda c: c < value)))
    return rows.join(levels, rows[categorical] == levels["__level"], "left").withColumn("slot", F.coalesce("slot", F.lit(n_levels)))


def forest(train: DataFrame, test: DataFrame, numeric: str, categorical: str, trees: int = 200, depth: int = 30, bins: int = 32, seed: int = 42) -> DataFrame:
    """(row_id, y, label): ``test`` with its labels as y and those of a forest on ``train``, labels being 0, 1, ..."""
    spark, cores = train.sparkSession, train.sparkSession.sparkContext.defaultParallelism
    # read several times: dealt over all cores, however few files or row groups the rows come from
    train = materialized(train.select(F.col(numeric).cast("double").alias(numeric), categorical, "label").repartition(cores), "forest-training")
    n_classes, n_levels = train.agg(F.max("label") + 1, F.count_distinct(categorical)).first()
    if n_classes is None:
        raise ValueError("a forest needs training rows")
    middle = quantiles(train, [], numeric, {"m": 0.5}).first()
    median = middle["m"] if middle else 0.0
    cuts = cuts_of(train.select(F.coalesce(numeric, F.lit(median)).alias("v")), "v", bins)
    levels = train.where(F.col(categorical).isNotNull()).select(F.col(categorical).alias("__level")).distinct()
    # a row per level
    levels = F.broadcast(levels.withColumn("slot", (F.row_number().over(Window.orderBy("__level")) - 1).cast("int")))
    place = (levels, n_levels, numeric, categorical, median, cuts)
    counts = _cells(train, *place).groupBy("bin", "slot", "label").agg(F.count("*").alias("n"))

    shape, tries = (len(cuts) + 1, n_levels + 1, n_classes), int(np.ceil(np.sqrt(n_levels + 1)))

    def grow(key, cells):
        import pandas as pd

        rng, n = np.random.default_rng([seed, int(key[0])]), np.zeros(shape)
        n[cells["bin"], cells["slot"], cells["label"]] = cells["n"]
        shares = tree(rng.poisson(n).astype(float), rng, tries, depth)
        b, s, k = np.indices(shape).reshape(3, -1)
        return pd.DataFrame({"bin": b, "slot": s, "k": k, "share": np.rint(shares.ravel() * UNIT).astype(np.int64)})

    each = counts.crossJoin(F.broadcast(spark.range(trees).withColumnRenamed("id", "tree"))).repartition(cores, "tree")
    votes = each.groupBy("tree").applyInPandas(grow, "bin int, slot int, k int, share long").groupBy("bin", "slot", "k").agg(F.sum("share").alias("share"))
    best = votes.groupBy("bin", "slot").agg((-F.max(F.struct("share", (-F.col("k")).alias("k")))["k"]).alias("best"))
    rows = _cells(test.select("row_id", F.col("label").alias("y"), numeric, categorical), *place)
    return rows.join(F.broadcast(best), ["bin", "slot"], "left").select("row_id", "y", F.col("best").alias("label"))
