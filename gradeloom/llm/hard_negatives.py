"""Hard-negative mining: exact integer inner products, several candidates to a multiplication.

Candidates are packed in blocks. Of each component a block holds wide integers (64 bits) in whose fields stand
the biased components of several candidates side by side; one multiplication by an anchor's component
multiplies all of them, and after the sum over the components each field holds one candidate's score plus the
bias times the anchor's own sum, which is known and taken off again. A field is as wide as the largest product
of two norms needs (Cauchy-Schwarz), so no sum runs into its neighbour, and arithmetic modulo 2^64 is exact.

1. Rows are sorted by label in ranges that a hash of the row splits within a label, and packed once; blocks are
   dealt to about sqrt(rows) groups. Anchors, a stated share of the rows, are packed in chunks.
2. Chunks meet the blocks of each group (an equality join on the group). The first pass looks only at blocks
   whose range of labels meets the chunk's and keeps the best of the same label; the second one, with the
   anchors' windows known, keeps per positive the best of other labels inside its window. Tasks keep the best
   few per anchor while they read; what meets in a shuffle is a few rows per anchor and task.

Defined results: rows with a null label, a null vector, or a null, NaN or infinite component take no part; scores
exist between rows with equally many components only; a null vec_id is never an anchor's and comes last among
ties; repeated rows are rows of their own: each is another row to its copies, and an anchor that stands there
twice gives its rows twice; an anchor without another row of its label, or without a row in a positive's window,
gives none; an empty table gives an empty result; further columns are ignored. Scores of 2^55 or more raise an error.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clustering import integer_vectors
from .shared import materialize

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: Scores are right between LEAST / OF and MOST / OF of the positive's.
LEAST, MOST, OF = 30, 90, 100
BLOCK_ROWS, CHUNK_ROWS = 512, 256
#: Chunks whose best rows a task keeps while blocks come in (0.2 MB each at most); the oldest leave first.
HELD_CHUNKS = 256
NO_SCORE = -(1 << 62)
LAST = (1 << 63) - 1


class Packed:
    """How components stand in a wide integer: ``fields`` of ``bits`` bits, components raised by ``bias``."""

    def __init__(self, norm2: float, least: int):
        self.bits = int(norm2 * (1 + 1e-9) + 1).bit_length() + 2
        self.fields, self.bias = max(1, 64 // self.bits), max(0, -least)

    def pack(self, vectors: np.ndarray) -> np.ndarray:
        """Wide integers [component, word] of candidates; field j of the words holds the j-th run of them."""
        words = -(-len(vectors) // self.fields)
        raised = np.zeros((self.fields * words, vectors.shape[1]), np.uint64)
        raised[: len(vectors)] = vectors + self.bias
        out = np.zeros((vectors.shape[1], words), np.uint64)
        for j in range(self.fields):
            out |= raised[j * words : (j + 1) * words].T << np.uint64(j * self.bits)
        return out

    def scores(self, anchors: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """Inner products [anchor, candidate] of ``n`` candidates."""
        a = anchors.view(np.uint64)
        # the bias's share of each field goes, and half a field comes, so that negative scores stay in their field
        half = np.uint64(1 << (self.bits - 1))
        right = half - np.uint64(self.bias) * a.sum(axis=1)
        packed = a @ words
        for j in range(self.fields):
            packed += (right << np.uint64(j * self.bits))[:, None]
        mask, parts = np.uint64((1 << self.bits) - 1), []
        for j in range(self.fields):
            parts.append(((packed >> np.uint64(j * self.bits)) & mask).astype(np.int64) - np.int64(half))
        return np.concatenate(parts, axis=1)[:, :n]


def _array(scalar, kind) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), kind)


def _pack_rows(batches, size: int, columns: list[str], pack):
    """Record batches of one row for each run of ``size`` rows of equal length; ``pack`` gets the rows' columns."""
    import pyarrow as pa

    def flush(held):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
        return pack(len(rows), {c: rows.column(c) for c in columns})

    held, n, dims = [], 0, None
    for batch in batches:
        lengths = batch.column("dims").to_numpy()
        at = 0
        while at < len(batch):
            if n and lengths[at] != dims:
                yield flush(held)
                held, n = [], 0
            dims = lengths[at]
            other = np.flatnonzero(lengths[at : at + size - n] != dims)
            step = min(size - n, len(batch) - at, int(other[0]) if len(other) else size)
            held.append(batch.slice(at, step))
            n, at = n + step, at + step
            if n == size:
                yield flush(held)
                held, n = [], 0
    if n:
        yield flush(held)


def _matrix(column, n: int) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1), np.int64)


def pack_blocks(rows: DataFrame, packed: Packed, groups: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of candidates, in order of their keys, dealt to groups."""

    def run(batches):
        import pyarrow as pa

        turn = None

        def pack(n, c):
            nonlocal turn
            keys, labels = c["key"].to_numpy(), c["label"].to_numpy()
            order = np.argsort(keys, kind="stable")
            keys, labels = keys[order], labels[order]
            words = packed.pack(_matrix(c["v"], n)[order])
            turn = zlib.crc32(keys.tobytes()) if turn is None else turn + 1
            values = [turn % groups, words.shape[0], int(labels.min()), int(labels.max()), keys.tobytes(), labels.tobytes(), words.tobytes()]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["group", "dims", "from_label", "to_label", "keys", "labels", "words"])

        yield from _pack_rows(batches, block_rows, ["key", "label", "v"], pack)

    key = F.coalesce("vec_id", F.lit(LAST))
    dealt = rows.select(key.alias("key"), "label", F.size("v").alias("dims"), "v").repartitionByRange("dims", "label", F.xxhash64("key", "v"))
    return materialize(dealt.sortWithinPartitions("dims", "label").mapInArrow(run, "group long, dims int, from_label long, to_label long, keys binary, labels binary, words binary"), "negatives-blocks")


def pack_chunks(anchors: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of ``anchors(n, label, dims, v, wanted)``; wanted are the scores of an anchor's positives."""

    def run(batches):
        import pyarrow as pa

        def pack(n, c):
            numbers, labels = c["n"].to_numpy(), c["label"].to_numpy()
            wanted = np.full((n, POSITIVES), NO_SCORE, np.int64)
            for k, some in enumerate(c["wanted"].to_pylist()):
                wanted[k, : len(some)] = some
            values = [int(numbers[0]), int(labels.min()), int(labels.max()), len(c["v"][0]), numbers.tobytes(), labels.tobytes(), _matrix(c["v"], n).tobytes(), wanted.tobytes()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["chunk", "a_from", "a_to", "dims", "ns", "a_labels", "a", "wanted"])

        yield from _pack_rows(batches, chunk_rows, ["n", "label", "v", "wanted"], pack)

    dealt = anchors.repartitionByRange("dims", "label", F.xxhash64("n")).sortWithinPartitions("dims", "label")
    return materialize(dealt.mapInArrow(run, "chunk long, a_from long, a_to long, dims int, ns binary, a_labels binary, a binary, wanted binary"), "negatives-chunks")


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` along the last axis, higher scores first, smaller keys first among equal ones."""
    order = np.lexsort((keys, -scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(keys, order, -1)


def _search(pairs: DataFrame, packed: Packed, same: bool, k: int) -> DataFrame:
    """(n, slot, score, key): of every chunk's anchors the best ``k`` in the blocks that a task met with it, of
    the same label (slot 0), or of other labels inside the window of each positive (its slot)."""
    slots = 1 if same else POSITIVES

    def run(batches):
        import pyarrow as pa

        held: dict[int, tuple] = {}

        def told(chunk):
            ns, scores, keys = held.pop(chunk)
            anchor, slot, at = np.nonzero(scores != NO_SCORE)
            columns = [pa.array(ns[anchor]), pa.array(slot.astype(np.int32)), pa.array(scores[anchor, slot, at]), pa.array(keys[anchor, slot, at])]
            return pa.RecordBatch.from_arrays(columns, ["n", "slot", "score", "key"])

        for batch in batches:
            for r in range(len(batch)):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                keys, labels = _array(row["keys"], np.int64), _array(row["labels"], np.int64)
                ns, a_labels = _array(row["ns"], np.int64), _array(row["a_labels"], np.int64)
                chunk = row["chunk"].as_py()
                if chunk not in held:
                    if len(held) == HELD_CHUNKS:
                        yield told(next(iter(held)))
                    empty = np.full((len(ns), slots, k), NO_SCORE, np.int64)
                    held[chunk] = (ns, empty, np.full_like(empty, LAST))
                dims = row["dims"].as_py()
                scores = packed.scores(_array(row["a"], np.int64).reshape(len(ns), dims), _array(row["words"], np.uint64).reshape(dims, -(-len(keys) // packed.fields)), len(keys))
                scores = np.where((labels == a_labels[:, None]) == same, scores, NO_SCORE)
                # keys ascend within a block, so a stable order puts smaller ones first
                order = np.argsort(-scores, axis=1, kind="stable")
                scores, keys = np.take_along_axis(scores, order, 1), keys[order]
                found, names = [], []
                for s in range(slots):
                    at = np.zeros(len(ns), np.int64)
                    least = np.full(len(ns), NO_SCORE + 1)
                    if not same:
                        p = _array(row["wanted"], np.int64).reshape(len(ns), POSITIVES)[:, s]
                        # whole scores inside the window; an absent positive has no window
                        least = np.where(p == NO_SCORE, -NO_SCORE, -(-LEAST * p // OF))
                        at = (scores > (MOST * p // OF)[:, None]).sum(axis=1)
                    take = at[:, None] + np.arange(k)
                    there = take < scores.shape[1]
                    take = np.minimum(take, scores.shape[1] - 1)
                    x = np.take_along_axis(scores, take, 1)
                    found.append(np.where(there & (x >= least[:, None]), x, NO_SCORE))
                    names.append(np.take_along_axis(keys, take, 1))
                _, best, best_keys = held[chunk]
                held[chunk] = (ns, *_best(np.concatenate([best, np.stack(found, 1)], -1), np.concatenate([best_keys, np.stack(names, 1)], -1), k))
        for chunk in list(held):
            yield told(chunk)

    found = pairs.mapInArrow(run, "n long, slot int, score long, key long")
    place = F.row_number().over(Window.partitionBy("n", "slot").orderBy(F.desc("score"), "key"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _pairs(chunks: DataFrame, blocks: DataFrame, groups: int, meet: Column) -> DataFrame:
    """Every chunk with the blocks that it may have a match in."""
    dealt = chunks.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return dealt.join(blocks, ["group", "dims"]).where(meet)


def hard_negatives(rows: DataFrame, anchor: Column, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``rows(vec_id, label, v)``
    with integer vectors, for the rows where ``anchor`` holds."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    n, norm, least = rows.agg(F.count("*"), F.max(norm2), F.min(F.array_min("v"))).first()
    if n and norm >= 2.0**55:
        raise ValueError("scores of 2^55 or more")
    packed, groups = Packed(norm or 0.0, least or 0), max(1, round(n**0.5 / 8))
    blocks = pack_blocks(rows, packed, groups, block_rows)
    copies = rows.where(anchor & F.col("vec_id").isNotNull()).groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies"))
    own = F.aggregate("v", F.lit(0).cast("long"), lambda acc, x: acc + x * x)
    anchors = materialize(copies.select(F.monotonically_increasing_id().alias("n"), "vec_id", F.col("label").cast("long").alias("label"), F.size("v").alias("dims"), "v", "copies", own.alias("own")), "negatives-anchors")

    chunks = pack_chunks(anchors.select("n", "label", "dims", "v", F.array().cast("array<long>").alias("wanted")), chunk_rows)
    near = _search(_pairs(chunks, blocks, groups, (F.col("a_from") <= F.col("to_label")) & (F.col("from_label") <= F.col("a_to"))), packed, True, POSITIVES + 1)
    # POSITIVES + 1 rows an anchor; one of the anchor's copies among them is the anchor itself
    lists = near.groupBy("n").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "key"))).alias("best"))
    lists = anchors.select("n", "vec_id", "copies", "own").join(lists, "n")
    itself = F.array_position("best", F.struct((-F.col("own")).alias("low"), F.col("vec_id").alias("key")))
    lists = lists.withColumn("itself", itself).withColumn("best", F.slice(F.filter("best", lambda x, k: k + 1 != F.col("itself")), 1, POSITIVES))
    lists = materialize(lists.where(F.size("best") > 0), "negatives-positives")

    wanted = lists.select("n", F.transform("best", lambda x: -x["low"]).alias("wanted"))
    chunks = pack_chunks(anchors.select("n", "label", "dims", "v").join(wanted, "n"), chunk_rows)
    one_label = (F.col("a_from") == F.col("a_to")) & (F.col("from_label") == F.col("to_label")) & (F.col("a_from") == F.col("to_label"))
    found = _search(_pairs(chunks, blocks, groups, ~one_label), packed, False, NEGATIVES)
    positives = lists.select("n", "vec_id", "copies", F.posexplode("best").alias("slot", "p"))
    out = positives.join(found, ["n", "slot"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    named = {c: F.when(F.col(k) != LAST, F.col(k)) for c, k in (("positive_id", "p.key"), ("negative_id", "key"))}
    return out.select(F.col("vec_id").alias("anchor_id"), named["positive_id"].alias("positive_id"), F.col("place").cast("int").alias("rank"), named["negative_id"].alias("negative_id"), (-F.col("p.low")).alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every anchor (vec_id divisible by 100) and each of its positives, its hardest negatives."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = integer_vectors(rows.where("label IS NOT NULL"), SCALE, None, label=label)
    return hard_negatives(rows, F.col("vec_id") % EVERY == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE = {
    "op11_hard_negatives": """
WITH k AS (SELECT vec_id AS i, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: isfinite(v))) = len(embedding)),
s AS (SELECT a.i AS a, a.l AS al, k.i, k.l, CAST(list_inner_product(a.e, k.e) AS BIGINT) AS s FROM k a, k WHERE a.i % 100 = 0 AND len(a.e) = len(k.e) AND a.i <> k.i),
p AS (SELECT a, al, i AS p, s AS ps FROM s WHERE l = al QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, i) <= 5)
SELECT p.a AS anchor_id, p.p AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.s DESC, s.i) AS INTEGER) AS rank, s.i AS negative_id, ps AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND s.l <> p.al AND 30 * ps <= 100 * s.s AND 100 * s.s <= 90 * ps QUALIFY rank <= 10"""
}
