"""Batches of texts inside Spark tasks: Arrow batches cut by bytes, and code-point arrays for numpy scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters scored at a time; a longer text is a batch of its own.
BATCH_CHARS = 1 << 20
#: Bytes of text that are Python strings at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def chunks(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with about ``limit`` characters."""
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, k
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def slices(batches, text_col: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """Runs of rows of Arrow batches with about ``limit`` bytes of text each, so that however wide a batch
    is, only a slice of it becomes Python objects."""
    for batch in batches:
        column = batch.column(text_col)
        if not len(column):
            continue
        width = np.dtype(np.int64 if "large" in str(column.type) else np.int32)
        ends = np.frombuffer(column.buffers()[1], width, len(column) + 1, column.offset * width.itemsize).astype(np.int64)
        # null entries have no bytes; a row counts as one byte at least, so that many empty ones are cut too
        ends = ends - ends[0] + np.arange(len(ends)) * 64
        first = 0
        while first < len(column):
            end = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
            yield batch.slice(first, end - first)
            first = end


def texts_of(batch, text_col: str = "text") -> list[str]:
    """The texts of an Arrow batch; null is empty."""
    return [t or "" for t in batch.column(text_col).to_pylist()]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and the offsets where each text starts (and the end)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
