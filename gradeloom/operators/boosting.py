"""Histogram gradient boosting for several classes with a joint softmax loss, grown level by level.

Features become bins at quantiles of the training rows. A tree per class and round is grown for all classes at
once: for every level one job sums gradients and curvatures per (class, node, feature, bin), partition by
partition and then by key, and picks the best split of each node where the sums are; a row per node comes back.
Gradients are counted in whole units of 2^-24, so sums, and with them the trees, do not depend on the order or
the partitions of the rows. Scores are written every ``KEPT`` rounds; between, tasks add the few trees since.

Defined results: missing values take the training median (0 where training has no value at all); ties of splits
go to the lower feature, then the lower bin; ties of classes to the lower class; a training class without rows is
an error; labels of rows that are only predicted are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialized
from .rank import quantiles

UNIT = 1 << 24
KEPT = 10


@dataclass
class Boosted:
    medians: np.ndarray
    cuts: list[np.ndarray]
    prior: np.ndarray
    #: per round: feature (-1 in leaves), last bin of the left side and value, each classes x nodes of a full tree
    rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, features: np.ndarray) -> np.ndarray:
        """Bin of every value: how many cuts lie below it."""
        filled = np.where(np.isnan(features), self.medians, features)
        out = np.empty(filled.shape, np.int16)
        for k, cut in enumerate(self.cuts):
            out[:, k] = np.searchsorted(cut, filled[:, k], "left")
        return out


def _matrix(batch, name: str, width: int) -> np.ndarray:
    """A list column of an Arrow batch, nulls in the lists as nan, without a Python object per row."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64 if flat.dtype == np.int16 else float).reshape(len(batch), width)


def _lists(matrix: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1], matrix.ravel())


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of a tree that each row comes to within ``levels`` levels."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(levels):
        f = feature[node]
        right = bins[rows, np.maximum(f, 0)] > cut[node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def add_trees(raw: np.ndarray, bins: np.ndarray, rounds, depth: int) -> np.ndarray:
    raw = raw.copy()
    for feature, cut, value in rounds:
        for k in range(raw.shape[1]):
            raw[:, k] += value[k][walk(bins, feature[k], cut[k], depth)]
    return raw


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def units(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the softmax loss per row and class, in whole units."""
    p = softmax(raw)
    return np.rint((p - (np.arange(p.shape[1]) == y[:, None])) * UNIT), np.rint(p * (1 - p) * UNIT)


def prepared(train: DataFrame, width: int, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Training medians and cuts per feature: two lists whose length the features and bins bound."""
    values = train.select(F.posexplode("features").alias("f", "v"))
    medians = np.zeros(width)
    for r in quantiles(values, ["f"], "v", {"m": 0.5}).collect():
        medians[r["f"]] = r["m"]
    filled = values.withColumn("v", F.coalesce("v", F.get(F.array(*map(F.lit, medians.tolist())), F.col("f"))))
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    cuts: list[np.ndarray] = [np.zeros(0)] * width
    for r in filled.groupBy("f").agg(F.percentile_approx("v", shares, 100 * bins).alias("cuts")).collect():
        cuts[r["f"]] = np.unique(r["cuts"])
    return medians, cuts


def _histograms(rows: DataFrame, rounds, tree, level: int, depth: int, n_classes: int, width: int, n_bins: int) -> DataFrame:
    """(k, node, f, b, g, h, n): sums of each partition over the rows in the nodes of ``level``."""
    first, nodes = (1 << level) - 1, 1 << level
    size = nodes * width * n_bins

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((n_classes, 3, size), np.int64)
        for batch in batches:
            bins = _matrix(batch, "bins", width)
            g, h = units(add_trees(_matrix(batch, "raw", n_classes), bins, rounds, depth), batch.column("y").to_numpy())
            for k in range(n_classes):
                node = walk(bins, tree[0][k], tree[1][k], level) - first
                live = np.flatnonzero(node >= 0)
                # a row counts in one bin of every feature
                at = ((node[live, None] * width + np.arange(width)) * n_bins + bins[live]).ravel()
                for j, w in enumerate((g[live, k], h[live, k], np.ones(len(live)))):
                    sums[k, j] += np.bincount(at, np.repeat(w, width), size).astype(np.int64)
        for k in range(n_classes):
            at = np.flatnonzero(sums[k, 2])
            rest, b = np.divmod(at, n_bins)
            node, f = np.divmod(rest, width)
            small = [np.full(len(at), k), node + first, f, b]
            yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in small], *map(pa.array, sums[k][:, at])], ["k", "node", "f", "b", "g", "h", "n"])

    return rows.select("bins", "raw", "y").mapInArrow(run, "k int, node int, f int, b int, g long, h long, n long")


def best_splits(histograms: DataFrame, ridge: float, least_rows: int, least_gain: float) -> DataFrame:
    """(k, node, g, h, s) per node: its sums, and as s the best split (gain, f, b and the sums of its left side), null
    where none gains. All rows of a feature in a node meet in one window: a row per bin and partition at most."""
    per = histograms.repartition("k", "node", "f").groupBy("k", "node", "f", "b").agg(*[F.sum(c).alias(c) for c in "ghn"])
    whole = Window.partitionBy("k", "node", "f")
    left = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.select("k", "node", "f", "b", *[F.sum(c).over(left).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(whole).alias(c) for c in "ghn"])
    real = lambda c: c.cast("double") / UNIT
    part = lambda g, h: real(g) * real(g) / (real(h) + ridge)
    gain = part(F.col("gl"), F.col("hl")) + part(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - part(F.col("g"), F.col("h"))
    fits = (F.col("nl") >= least_rows) & (F.col("n") - F.col("nl") >= least_rows) & (gain > least_gain)
    told = F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), "gl", "hl")
    return per.groupBy("k", "node").agg(F.max("g").alias("g"), F.max("h").alias("h"), F.max(F.when(fits, told)).alias("s"))


ROW = "bins array<short>, y int, raw array<double>"


def _most_bins(model: Boosted) -> int:
    return 1 + max([0, *map(len, model.cuts)])


def _start(model: Boosted, train: DataFrame) -> DataFrame:
    """The training rows in bins, each with the classes' shares as its scores, dealt over all cores, however few files
    or row groups they come from."""
    prior, width = model.prior, len(model.cuts)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = model.bins(_matrix(batch, "features", width))
            yield pa.RecordBatch.from_arrays([_lists(found), batch.column("y"), _lists(np.tile(prior, (len(batch), 1)))], ["bins", "y", "raw"])

    dealt = train.select("features", "y").repartition(train.sparkSession.sparkContext.defaultParallelism)
    return materialized(dealt.mapInArrow(run, ROW), "boosting-rows")


def begin(train: DataFrame, n_classes: int, bins: int = 256) -> Boosted:
    """Medians, cuts and the classes' shares of ``train``; no tree yet."""
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(counts) != set(range(n_classes)):
        raise ValueError("training rows must cover every class")
    width = train.select(F.max(F.size("features"))).first()[0]
    share = np.array([counts[k] for k in range(n_classes)], float)
    return Boosted(*prepared(train, width, bins), np.log(share / share.sum()))


def first_splits(train: DataFrame, n_classes: int, ridge: float = 1.0, least_rows: int = 1, least_gain: float = 1e-6, bins: int = 256) -> DataFrame:
    """(k, f, b, gain): the split at the root of each class's first tree, null where none gains."""
    model = begin(train, n_classes, bins)
    tree = (np.full((n_classes, 1), -1), np.zeros((n_classes, 1), int))
    sums = _histograms(_start(model, train), [], tree, 0, 1, n_classes, len(model.cuts), _most_bins(model))
    return best_splits(sums, ridge, least_rows, least_gain).select("k", (-F.col("s.f")).alias("f"), (-F.col("s.b")).alias("b"), "s.gain")


def fit(train: DataFrame, n_classes: int, rounds: int = 100, depth: int = 3, rate: float = 0.05, ridge: float = 1.0, least_rows: int = 1, least_gain: float = 1e-6, bins: int = 256) -> Boosted:
    """A model of ``train(features array<double>, y int)``; ``rounds`` times ``depth`` jobs."""
    model = begin(train, n_classes, bins)
    width = len(model.cuts)
    rows, n_bins = _start(model, train), _most_bins(model)
    written = 0
    for at in range(rounds):
        if at - written == KEPT:
            since = model.rounds[written:at]

            def add(batches, since=since):
                import pyarrow as pa

                for batch in batches:
                    raw = add_trees(_matrix(batch, "raw", n_classes), _matrix(batch, "bins", width), since, depth)
                    yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), _lists(raw)], ["bins", "y", "raw"])

            rows, written = materialized(rows.mapInArrow(add, ROW), "boosting-rows"), at
        model.rounds.append(grow(rows, model.rounds[written:], n_classes, width, n_bins, depth, rate, ridge, least_rows, least_gain))
    return model


def grow(rows: DataFrame, since, n_classes: int, width: int, n_bins: int, depth: int, rate: float, ridge: float, least_rows: int, least_gain: float):
    """The trees of one round, one a class."""
    size = (2 << depth) - 1
    feature, cut, value = np.full((n_classes, size), -1), np.zeros((n_classes, size), int), np.zeros((n_classes, size))
    leaf = lambda g, h: -rate * (g / UNIT) / (h / UNIT + ridge)
    for level in range(depth):
        found = best_splits(_histograms(rows, list(since), (feature.copy(), cut.copy()), level, depth, n_classes, width, n_bins), ridge, least_rows, least_gain).collect()
        for r in found:
            k, node, s = r["k"], r["node"], r["s"]
            if level == 0:
                value[k, 0] = leaf(r["g"], r["h"])
            if s is None:
                continue
            feature[k, node], cut[k, node] = -s["f"], -s["b"]
            value[k, 2 * node + 1] = leaf(s["gl"], s["hl"])
            value[k, 2 * node + 2] = leaf(r["g"] - s["gl"], r["h"] - s["hl"])
        if all(r["s"] is None for r in found):
            break
    return feature, cut, value


def predict(model: Boosted, rows: DataFrame) -> DataFrame:
    """(row_id, y, label, probabilities)."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    width, n_classes = len(model.cuts), len(model.prior)

    def run(batches):
        import pyarrow as pa

        m = held.value
        depth = int(np.log2(m.rounds[0][0].shape[1] + 1)) - 1 if m.rounds else 0
        for batch in batches:
            bins = m.bins(_matrix(batch, "features", width)).astype(np.int64)
            p = softmax(add_trees(np.tile(m.prior, (len(batch), 1)), bins, m.rounds, depth))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("y"), pa.array(p.argmax(axis=1).astype(np.int32)), _lists(p)], ["row_id", "y", "label", "probabilities"])

    return rows.select("row_id", "y", "features").mapInArrow(run, f"row_id {rows.schema['row_id'].dataType.simpleString()}, y int, label int, probabilities array<double>")


def boosted(rows: DataFrame, n_classes: int, per_class: int | None = None, seed: int = 42, **options) -> DataFrame:
    """Predictions for the test rows of ``rows(row_id, features, y, split)``; with ``per_class`` that many train rows of
    every class are selected. One candidate with fixed options is fitted: validation rows are not used."""
    from .prep import select_examples

    train = rows.where("split = 'train'")
    if per_class is not None:
        picked = select_examples(train.select("row_id", F.col("y").alias("label")), per_class, seed).select("row_id")
        train = train.join(picked, "row_id", "left_semi")
    return predict(fit(train, n_classes, **options), rows.where("split = 'test'"))
