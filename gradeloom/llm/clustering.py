"""Centroid clustering of vectors, exact in integers, with zone maps along a space-filling curve.

1. Vectors become integers; sums and second moments over all of them give their principal axes.
2. Vectors are ordered along a Hilbert curve through their coordinates on the leading axes, dealt by ranges of
   the curve (a hash of the row splits places that many rows share), and packed in blocks with the least and
   greatest coordinate on every axis: the block's box. Blocks are written once to the shared folder.
3. In each round a block asks first which centroids can be nearest to anything in its box: of the centroid
   nearest to the box's middle and another one, the difference of squared distances is linear in the vector, so
   its greatest value over the box is a sum over the axes. A centroid farther everywhere is left out; a slack far
   beyond rounding keeps this sound. What is left is compared exactly, a block at a time, ties to the smaller number.
4. Sums per centroid and component leave each task added up; the driver holds the ``k`` centroids only.

Defined results: rows with another number of components, a null vector or any null, NaN or infinite component
take no part; a null vec_id takes part, but is the last to be a first centroid; rows of one vec_id are rows of
their own, as first centroids in order of their components; with fewer rows than ``k`` there are as many
centroids as rows; an empty table gives an empty result; further columns are ignored. Scaled components beyond
2^27 raise an error, since squared distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize

K, ROUNDS, SCALE, DIMS, SEED = 16, 3, 64, 64, "1"
BLOCK_ROWS = 256
#: Leading axes and bits of each that place a vector on the curve.
CURVE_AXES, CURVE_BITS = 8, 8
LARGEST = 1 << 27


def integer_vectors(rows: DataFrame, scale: int, dims: int | None, id_col: str = "vec_id", vector_col: str = "embedding", **more) -> DataFrame:
    """(vec_id, v, more columns) of rows whose vector is whole and finite: v = floor(scale * x) as longs."""
    x = F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")) & ~F.isnan(e))
    if dims is not None:
        sound &= F.size(x) == dims
    # the comparison keeps what doubles hold exactly from being cast when it is beyond a long
    scaled = F.transform(x, lambda e: F.floor(F.greatest(F.least(e.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))))
    return rows.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"), *[c.alias(n) for n, c in more.items()])


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column whose lists are of one length, as one array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def curve_places(coords: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates below 2^bits (axes x bits <= 64).

    From the top bit on, an axis's bit says how the lower bits are reflected (set) or exchanged with the first
    axis's (not set); a Gray code of what results is the place, bit by bit across the axes."""
    x = coords.T.astype(np.uint64).copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit = one << np.uint64(b)
        low = bit - one
        for k in range(n):
            set_ = (x[k] & bit) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= flip
    place = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            place = place << one | (x[k] >> np.uint64(b) & one)
    return place


def _moments(kept: DataFrame, dims: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Number of vectors, largest component by amount, mean and covariance; a row for each cell leaves a task."""
    cells = dims * dims + dims + 2

    def run(batches):
        import pyarrow as pa

        total = np.zeros(cells)
        most = 0
        for batch in batches:
            if len(batch):
                v = matrix(batch.column("v")).astype(float)
                most = max(most, float(np.abs(v).max()))
                total[:-2] += np.concatenate([(v.T @ v).ravel(), v.sum(axis=0)])
                total[-2] += len(batch)
        if total[-2]:
            total[-1] = most
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], ["cell", "x"])

    parts = kept.select("v").mapInArrow(run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x"), F.max("x").alias("most"))
    rows = {r.cell: r for r in parts.collect()}
    if not rows:
        return 0, 0, np.zeros(dims), np.eye(dims)
    x = np.array([rows[k].x for k in range(cells)])
    n = int(x[-2])
    mean = x[dims * dims : -2] / n
    return n, int(rows[cells - 1].most), mean, x[: dims * dims].reshape(dims, dims) / n - np.outer(mean, mean)


def zone_blocks(kept: DataFrame, mean: np.ndarray, cov: np.ndarray, block_rows: int) -> tuple[DataFrame, np.ndarray]:
    """Blocks (ids, points, lo, hi) in order of the curve, and the axes of their boxes."""
    spread, axes = np.linalg.eigh(cov)
    axes = np.ascontiguousarray(axes[:, ::-1])
    m = min(CURVE_AXES, len(mean))
    unit = np.sqrt(np.maximum(spread[::-1][:m], 0)) + 1e-9

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                at = (matrix(batch.column("v")) - mean) @ axes[:, :m] / unit
                cell = np.clip((at + 3) / 6 * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.uint64)
                key = (curve_places(cell, CURVE_BITS) ^ np.uint64(1 << 63)).view(np.int64)  # in the order of signed longs
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("vec_id"), batch.column("v")], ["place", "vec_id", "v"])

    def pack(batches):
        import pyarrow as pa

        def block(rows: pa.RecordBatch):
            v = np.ascontiguousarray(matrix(rows.column("v")), dtype="<i8")
            turned = v @ axes
            columns = [[rows.column("vec_id").to_pylist()], [v.tobytes()], [turned.min(axis=0).tobytes()], [turned.max(axis=0).tobytes()]]
            kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ids", "points", "lo", "hi"])

        held, size = [], 0
        for batch in batches:
            for k in range(0, len(batch), block_rows):
                held.append(batch.slice(k, block_rows))
                size += len(held[-1])
                if size >= block_rows:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=size)[0]
                    yield block(rows.slice(0, block_rows))
                    held, size = [rows.slice(block_rows)], size - block_rows
        if size:
            yield block(pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=size)[0])

    placed = kept.mapInArrow(place, "place long, vec_id long, v array<long>")
    ordered = placed.repartitionByRange("place", F.xxhash64("vec_id", "v")).sortWithinPartitions("place")
    return materialize(ordered.mapInArrow(pack, "ids array<long>, points binary, lo binary, hi binary"), "zone-blocks"), axes


class Zones:
    """Nearest centroids of the vectors of a block."""

    def __init__(self, centroids: list[list[int]], axes: np.ndarray, most: int):
        self.centroids = np.array(centroids, np.int64)
        self.turned = self.centroids @ axes
        self.norm = (self.turned**2).sum(axis=1)
        # whole numbers below 2^53 are exact as doubles, in whatever order they are added
        self.exact = 4 * self.centroids.shape[1] * max(most, int(np.abs(self.centroids).max())) ** 2 < 1 << 53
        self.as_float = self.centroids.astype(float)

    def candidates(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Centroids that may be nearest to a point of the box."""
        first = ((self.turned - (lo + hi) / 2) ** 2).sum(axis=1).argmin()
        step = self.turned - self.turned[first]
        parts = np.maximum(lo * step, hi * step)
        ahead = self.norm[first] - self.norm + 2 * parts.sum(axis=1)
        slack = 1e-9 * (self.norm + self.norm[first] + 2 * np.abs(parts).sum(axis=1))
        return np.flatnonzero(ahead >= -slack)

    def nearest(self, points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) of each point, and the number of centroids compared."""
        some = self.candidates(lo, hi)
        if self.exact:
            x, c = points.astype(float), self.as_float[some]
            far = (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)
        else:
            far = np.stack([((points - c) ** 2).sum(axis=1) for c in self.centroids[some]], axis=1)
        best = far.argmin(axis=1)
        return some[best], far[np.arange(len(points)), best].astype(np.int64), len(some)

    def blocks(self, batches) -> Iterator[tuple]:
        """(ids, points, centroid, distance, compared) of each block of Arrow batches."""
        dims = self.centroids.shape[1]
        for batch in batches:
            for k in range(len(batch)):
                points = np.frombuffer(batch.column("points")[k].as_buffer(), "<i8").reshape(-1, dims)
                lo, hi = (np.frombuffer(batch.column(c)[k].as_buffer(), "<f8") for c in ("lo", "hi"))
                yield batch.column("ids")[k].values, points, *self.nearest(points, lo, hi)


def _moved(blocks: DataFrame, centroids: list[list[int]], axes: np.ndarray, most: int) -> list[list[int]]:
    """Centroids after one round."""
    dims = len(centroids[0])

    def run(batches):
        import pyarrow as pa

        zones = Zones(centroids, axes, most)
        total, size = np.zeros((len(centroids), dims), np.int64), np.zeros(len(centroids), np.int64)
        for _, points, label, _, _ in zones.blocks(batches):
            np.add.at(total, label, points)
            size += np.bincount(label, minlength=len(centroids))
        if size.any():
            at = np.arange(total.size)
            columns = [pa.array((at // dims).astype(np.int32)), pa.array((at % dims).astype(np.int32)), pa.array(total.ravel()), pa.array(np.repeat(size, dims))]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "dim", "total", "n"])

    parts = blocks.mapInArrow(run, "cluster int, dim int, total long, n long")
    sums = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).where("n > 0").collect()
    out = [list(c) for c in centroids]
    for r in sums:
        out[r.cluster][r.dim] = int(r.total) // r.n
    return out


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: str = SEED, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, compared, cluster_inertia, inertia, centroid_sha256) per vector; compared is the
    number of centroids that its block's box left."""
    spark = rows.sparkSession
    kept = integer_vectors(rows, scale, dims, id_col, vector_col)
    n, most, mean, cov = _moments(kept, dims)
    if not n:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, compared int, cluster_inertia long, inertia long, centroid_sha256 string")
    if most > LARGEST:
        raise ValueError(f"a scaled component of {most} is beyond {LARGEST}: squared distances may not fit 64 bits")
    first = kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    centroids = [list(r.v) for r in first.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]
    blocks, axes = zone_blocks(kept, mean, cov, block_rows)
    for _ in range(rounds):
        centroids = _moved(blocks, centroids, axes, most)

    def assign(batches):
        import pyarrow as pa

        for ids, _, label, far, compared in Zones(centroids, axes, most).blocks(batches):
            columns = [ids, pa.array(label.astype(np.int32)), pa.array(far), pa.array(np.full(len(far), compared, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "compared"])

    found = materialize(blocks.mapInArrow(assign, "vec_id long, cluster int, distance long, compared int"), "zone-assigned")
    # a row per centroid, k at most
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    inertia = sum(r.s for r in sums)
    per = [(r.cluster, r.s, inertia, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in sums]
    per = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "compared", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's centroid after three rounds, with distances and checksums."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("compared")


def _round(n: int) -> str:
    """SQL of one round: the nearest of centroids c<n>, and centroids c<n + 1>."""
    return f"""
a{n} AS (SELECT i, arg_min(c, far * 1000 + c)::INTEGER AS c, min(far) AS far FROM (SELECT x.i, m.c, sum((x.x - m.x) * (x.x - m.x))::BIGINT AS far FROM x JOIN c{n} m USING (d) GROUP BY x.i, m.c) GROUP BY i),
s{n} AS (SELECT a.c, x.d, sum(x.x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{n} a JOIN x USING (i) GROUP BY a.c, x.d),
c{n + 1} AS (SELECT m.c, m.d, CASE WHEN s.n IS NULL THEN m.x ELSE s.s // s.n - CASE WHEN s.s % s.n < 0 THEN 1 ELSE 0 END END::BIGINT AS x FROM c{n} m LEFT JOIN s{n} s ON s.c = m.c AND s.d = m.d)"""


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
ORACLE = {
    "op13_centroid_clustering": f"""
WITH kept AS (SELECT vec_id AS i, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: isfinite(v))) = 64),
x AS (SELECT i, generate_subscripts(e, 1) AS d, CAST(floor(64 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM kept),
f AS (SELECT i, row_number() OVER (ORDER BY sha256('1:' || i)) - 1 AS c FROM kept QUALIFY c < 16),
c0 AS (SELECT f.c, x.d, x.x FROM f JOIN x USING (i)),{_round(0)},{_round(1)},{_round(2)},{_round(3)},
named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS name FROM c3 GROUP BY c)
SELECT i AS vec_id, a.c AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia, name AS centroid_sha256
FROM a3 a JOIN named USING (c)"""
}
