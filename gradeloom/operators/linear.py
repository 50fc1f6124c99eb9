"""Linear text classifiers over sparse rows: multinomial logistic regression and one-against-the-rest machines with
squared hinge loss, both with half the squared weights plus C times the loss of all rows, to the optimum.

Rows are packed into blocks once, or come as blocks that are read as rows (``Blocks``). A step's loss and slope are one job over the blocks: each of about as many tasks as
there are cores adds up its own, and slopes are summed in parts, so what is shuffled does not grow with the rows and what
reaches the driver is one number per weight, bounded by classes times vocabulary. Naive Bayes takes one such job. Steps follow from the last
few slopes (limited-memory BFGS). Features are not rescaled inside: rare terms keep the penalty they have."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialized, passing

#: Numbers that a task sums at a time.
PART = 1 << 16
#: Entries of rows that a task adds up at least.
TASK_ENTRIES = 1_000_000
#: Entries of a block, about.
BLOCK = 1 << 18
PACKED = ["y", "row", "idx", "w"]


@dataclass
class Linear:
    """Weights [class, feature], the last feature being the intercept, and the largest slope left."""

    method: str
    weights: np.ndarray
    slope: float
    steps: int


@dataclass
class Blocks:
    """Rows in blocks with a form of their own. ``read`` gives for a batch, block by block, (row ids, y, row of each y, parts): a
    row may have several labels, and a part is (entries of each row, idx, w, what each row's w are multiplied by)."""

    frame: DataFrame
    read: Callable
    kind: str = "long"


def _scores(batch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores [row, class], idx, w, row) of an Arrow batch with list columns idx and w."""
    idx, w = batch.column("idx").flatten().to_numpy(), batch.column("w").flatten().to_numpy()
    row = np.repeat(np.arange(len(batch)), batch.column("idx").value_lengths().to_numpy())
    scores = np.stack([np.bincount(row, w * c[idx], len(batch)) + c[-1] for c in weights], axis=1)
    return scores, idx, w, row


def _loss(method: str, scores: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the rows' losses, and its slope by score."""
    hot = y[:, None] == np.arange(scores.shape[1])
    if method == "logistic":
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return float(-np.log(np.maximum(p[hot], 1e-300)).sum()), p - hot
    sign = np.where(hot, 1.0, -1.0)
    short = np.maximum(0, 1 - sign * scores)
    return float((short**2).sum()), -2 * sign * short


def summed(rows: DataFrame, size: int, add: Callable) -> np.ndarray:
    """The sum of what ``add(batch, total)`` adds to ``size`` numbers for every Arrow batch of ``rows``: a task for each
    core adds up its own, then each part of the numbers, as bytes, is added up over the tasks."""

    def run(batches):
        import pyarrow as pa

        flat = np.zeros(size)
        for batch in batches:
            if len(batch):
                add(batch, flat)
        parts = [flat[at : at + PART].tobytes() for at in range(0, size, PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "x"])

    def total(table):
        import pyarrow as pa

        x = sum(np.frombuffer(x.as_buffer()) for x in table.column("x"))
        return pa.table({"part": table.column("part").slice(0, 1), "x": pa.array([x.tobytes()], pa.binary())})

    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    kind = "part int, x binary"
    with passing(rows.sparkSession):
        parts = sorted(rows.mapInArrow(run, kind).groupBy("part").applyInArrow(total, kind).collect())
    return np.concatenate([np.zeros(0), *[np.frombuffer(r["x"]) for r in parts]]) if parts else np.zeros(size)


def packed(rows: DataFrame) -> DataFrame:
    """``rows(y, idx, w)`` as blocks of about ``BLOCK`` entries, written: labels of their rows, and entries by feature (so
    that steps go through the weights in order), all as bytes. A longer row has a block of its own."""
    if dict(rows.dtypes)["idx"] == "binary":
        return rows
    entries = rows.agg(F.sum(F.size("idx"))).first()[0] or 0

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column("idx").value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            idx, w, y = batch.column("idx").flatten().to_numpy(), batch.column("w").flatten().to_numpy(), batch.column("y").to_numpy()
            at = 0
            while at < len(sizes):
                first = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, first + BLOCK, "right")))
                last = ends[to - 1]
                order = np.argsort(idx[first:last], kind="stable")
                row = np.repeat(np.arange(to - at), sizes[at:to])
                own = [y[at:to].astype(np.int32), row[order].astype(np.int32), idx[first:last][order].astype(np.int32), w[first:last][order].astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in own], PACKED)
                at = to

    blocks = rows.select("y", "idx", "w").mapInArrow(run, "y binary, row binary, idx binary, w binary")
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, max(1, -(-entries // TASK_ENTRIES)))
    return materialized(blocks.repartition(tasks), "text-blocks")


def _unpacked(batch):
    """(y, row, idx, w) of every block of a batch; row is the entry's row."""
    for block in zip(*[batch.column(c) for c in PACKED], strict=True):
        y, row, idx = (np.frombuffer(x.as_buffer(), np.int32) for x in block[:3])
        yield y, row, idx, np.frombuffer(block[3].as_buffer())


def _row_scores(parts: list, rows: int, weights: np.ndarray) -> np.ndarray:
    """Scores [row, class]; ``weights`` [feature, class], the last one the intercept."""
    scores = np.repeat(weights[-1:], rows, axis=0)
    for sizes, idx, w, scale in parts:
        ends = np.cumsum(sizes).tolist()
        for k in np.flatnonzero(sizes).tolist():
            first = ends[k - 1] if k else 0
            scores[k] += scale[k] * (w[first : ends[k]] @ weights.take(idx[first : ends[k]], axis=0))
    return scores


def _row_sums(parts: list, values: np.ndarray, sums: np.ndarray) -> None:
    """Adds ``values`` [row, class] times the rows' features to ``sums`` [class, feature], the last feature being 1."""
    for sizes, idx, w, scale in parts:
        for c, own in enumerate(values.T):
            sums[c, :-1] += np.bincount(idx, w * np.repeat(own * scale, sizes), sums.shape[1] - 1)
    sums[:, -1] += values.sum(axis=0)


def _slope(blocks: DataFrame | Blocks, method: str, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and slope of all rows at ``weights``."""
    frame, read = (blocks.frame, blocks.read) if isinstance(blocks, Blocks) else (blocks, None)
    sent = frame.sparkSession.sparkContext.broadcast(weights if read is None else np.ascontiguousarray(weights.T))
    k, width = weights.shape

    def add_rows(batch, total):
        slope = total[:-1].reshape(k, width)
        for ids, y, at, parts in read(batch):
            more, r = _loss(method, _row_scores(parts, len(ids), sent.value)[at], y)
            total[-1] += more
            _row_sums(parts, np.stack([np.bincount(at, x, len(ids)) for x in r.T], axis=1), slope)

    def add(batch, total):
        slope = total[:-1].reshape(k, width)
        for y, row, idx, w in _unpacked(batch):
            scores = np.stack([np.bincount(row, w * c[idx], len(y)) + c[-1] for c in sent.value], axis=1)
            more, r = _loss(method, scores, y)
            total[-1] += more
            for c in range(k):
                slope[c, :-1] += np.bincount(idx, w * r[:, c][row], width - 1)
                slope[c, -1] += r[:, c].sum()

    flat = summed(frame, k * width + 1, add if read is None else add_rows)
    sent.destroy()
    return float(flat[-1]), flat[:-1].reshape(k, width)


def bayes(rows: DataFrame | Blocks, n_classes: int, width: int, strength: float) -> Linear:
    """Multinomial naive Bayes of ``rows(y, idx, w)`` with smoothing ``strength``, also of the classes' shares."""

    read = rows.read if isinstance(rows, Blocks) else None

    def add_rows(batch, total):
        sums = total.reshape(n_classes, width + 1)
        for ids, y, at, parts in read(batch):
            _row_sums(parts, np.stack([np.bincount(at, y == c, len(ids)) for c in range(n_classes)], axis=1), sums)

    def add(batch, total):
        sums = total.reshape(n_classes, width + 1)
        for y, row, idx, w in _unpacked(batch):
            sums += np.bincount(y[row] * (width + 1) + idx, w, sums.size).reshape(sums.shape)
            sums[:, -1] += np.bincount(y, minlength=n_classes)

    frame, own = (packed(rows), add) if read is None else (rows.frame, add_rows)
    sums = summed(frame, n_classes * (width + 1), own).reshape(n_classes, width + 1)
    terms, n = sums[:, :-1], sums[:, -1]
    own = np.log(terms + strength) - np.log(terms.sum(axis=1, keepdims=True) + strength * width)
    share = np.log(n + strength) - np.log(n.sum() + strength * n_classes)
    return Linear("bayes", np.column_stack([own, share]), 0.0, 0)


def fit(rows: DataFrame | Blocks, method: str, n_classes: int, width: int, strength: float, steps: int = 100, tolerance: float | None = None, start: np.ndarray | None = None) -> Linear:
    """The optimum for ``rows(y, idx, w)``, which may be ``packed`` or ``Blocks``, with C = ``strength``; steps begin at ``start``, if given.
    The logistic intercept is free, the machines' is penalized like a weight."""
    rows = rows if isinstance(rows, Blocks) else packed(rows)
    frame = rows.frame if isinstance(rows, Blocks) else rows
    n = max(frame.agg(F.sum(F.octet_length("y") / 4)).first()[0] or 0, 1)
    tolerance = tolerance or (1e-5 if method == "logistic" else 1e-4)
    penalty = np.full((n_classes, width + 1), 1 / (strength * n))
    if method == "logistic":
        penalty[:, -1] = 0

    def value(w):
        loss, slope = _slope(rows, method, w)
        return loss / n + 0.5 * float((penalty * w * w).sum()), slope / n + penalty * w

    w = np.zeros((n_classes, width + 1)) if start is None else start
    f, g = value(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for done in range(steps):
        if np.abs(g).max() <= tolerance:
            break
        # two-loop recursion over the last changes of weights and slope
        q, held = g.copy(), []
        for s, y in reversed(past):
            a = float((s * q).sum() / (s * y).sum())
            held.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= float((s * y).sum() / (y * y).sum())
        for (s, y), a in zip(past, reversed(held), strict=True):
            q += (a - float((y * q).sum() / (s * y).sum())) * s
        down, size = float((g * q).sum()), 1.0 if past else 1 / float(np.sqrt((g * g).sum()))
        while True:
            new_f, new_g = value(w - size * q)
            if new_f <= f - 1e-4 * size * down or size < 1e-10:
                break
            size /= 2
        step, change = -size * q, new_g - g
        if float((step * change).sum()) > 0:
            past = [*past, (step, change)][-10:]
        w, f, g = w + step, new_f, new_g
    else:
        done = steps
    return Linear(method, w, float(np.abs(g).max()), done)


def steepest(model: Linear, rows: Blocks, strength: float) -> DataFrame:
    """(steepest): the largest slope of the logistic objective at the fitted weights: per class and feature the mean of
    probability less truth times feature, plus the weight's own pull; 0 where they are optimal."""
    k, width = model.weights.shape
    read, sent = rows.read, rows.frame.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.weights.T))

    def add(batch, total):
        for ids, y, at, parts in read(batch):
            scores = _row_scores(parts, len(ids), sent.value)
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p *= (np.bincount(at, minlength=len(ids)) / p.sum(axis=1))[:, None]
            truth = np.stack([np.bincount(at, y == c, len(ids)) for c in range(k)], axis=1)
            _row_sums(parts, p - truth, total[:-1].reshape(k, width))
            total[-1] += len(y)

    flat = summed(rows.frame, k * width + 1, add)
    slopes, n = flat[:-1].reshape(k, width), max(flat[-1], 1)
    slopes[:, :-1] += model.weights[:, :-1] / strength
    return rows.frame.sparkSession.createDataFrame([(float(np.abs(slopes / n).max()),)], "steepest double")


def predict(model: Linear, rows: DataFrame | Blocks) -> DataFrame:
    """(row_id, y, label, probabilities) of ``rows(row_id, y, idx, w)``; machines have no probabilities."""
    method = model.method
    if isinstance(rows, Blocks):
        return _predict_blocks(model, rows)
    sent = rows.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                yield _told(method, batch.column("row_id"), batch.column("y"), _scores(batch, sent.value)[0])

    return rows.select("row_id", "y", "idx", "w").mapInArrow(run, "row_id long, y int, label int, probabilities array<double>")


def _told(method: str, ids, y, scores: np.ndarray):
    """An Arrow batch of predictions."""
    import pyarrow as pa

    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    p = list(e / e.sum(axis=1, keepdims=True)) if method != "svm" else [None] * len(ids)
    return pa.RecordBatch.from_arrays([ids, y, pa.array(scores.argmax(axis=1).astype(np.int32)), pa.array(p, pa.list_(pa.float64()))], ["row_id", "y", "label", "probabilities"])


def _predict_blocks(model: Linear, rows: Blocks) -> DataFrame:
    read, method = rows.read, model.method
    sent = rows.frame.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.weights.T))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, y, at, parts in read(batch):
                scores = _row_scores(parts, len(ids), sent.value)[at]
                yield _told(method, ids.take(pa.array(at)), pa.array(y, mask=y == np.iinfo(np.int32).min), scores)

    return rows.frame.mapInArrow(run, f"row_id {rows.kind}, y int, label int, probabilities array<double>")

