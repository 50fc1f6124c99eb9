"""Exact dedup (native): an extendible-hash index on shared files.

Every text is hashed to a 64-bit key. Keys live in buckets addressed by their leading bits; a bucket
holding more than ``capacity`` entries is split, and the directory doubles until every bucket fits; its
depth follows the number of entries. The index is a Parquet table in the shared folder, one folder per
bucket, written by owner tasks that each hold a range of keys. Different texts that collide on a key form a
chain of entries; the entries of a chain of two or more hold their texts.

Rows are looked up through the directory: key, cell, bucket, chain. Where a chain has one entry, every
text with that key went into it, compared byte by byte when it was built; in longer chains the row's
bytes are compared with each entry's. Copies are combined before the shuffle, so a text held by a third of
all rows is one entry, and the lookup join can be split by adaptive execution.

Defined results: null text counts as empty; all equal texts form one group whatever their other
columns; repeated rows with the surviving doc_id and text all count as the surviving row; null doc_ids
survive only where a group has no other; an empty table gives an empty result; further columns are ignored
by the report and kept by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, shared_dir, text_of

CAPACITY = 1 << 16
#: Cells of the directory that are broadcast at most; a larger one is joined.
BROADCAST_CELLS = 1 << 16
KEY_BITS = 64


def _keyed(docs: DataFrame, id_col: str, text_col: str, key_bits: int = KEY_BITS) -> DataFrame:
    """doc_id, key, text; fewer ``key_bits`` make texts collide (for tests)."""
    text = text_of(text_col)
    key = F.shiftleft(F.xxhash64(text), KEY_BITS - key_bits)
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), text.alias("text"))


def _leading_bits(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def depth_for(entries: int, capacity: int) -> int:
    """Directory depth at which even uneven buckets of ``capacity`` can be told apart."""
    return min(32, max(1, (max(entries, 1) // capacity).bit_length() + 3))


def build_directory(keys: DataFrame, capacity: int, depth: int) -> DataFrame:
    """(cell, bucket, local_depth) for each of the 2^depth cells that hold a key of ``keys(key)``.

    A cell's bucket is the shortest prefix of its bits whose entries fit ``capacity`` (the state that
    repeated splits of overfull buckets reach). Buckets are numbered as in a heap: ``2^depth + prefix``.
    """
    hist = keys.groupBy(_leading_bits(F.col("key"), depth).alias("cell")).agg(F.count("*").alias("n"))

    def ladder(depths: Column) -> DataFrame:
        return hist.select("cell", "n", F.explode(depths).alias("depth")).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - depth)"))

    sums = ladder(F.sequence(F.lit(0), F.lit(depth))).groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    fits = sums.where((F.col("held") <= capacity) | (F.col("depth") == depth))
    # depths at which nothing fits are left out, so that a prefix below never has more than ``capacity`` cells
    some = sorted(r["depth"] for r in fits.select("depth").distinct().collect()) or [depth]
    shortest = ladder(F.array(*map(F.lit, some))).join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix")).alias("at"))
    return shortest.select("cell", F.expr("shiftleft(1L, at.depth) + at.prefix").alias("bucket"), F.col("at.depth").alias("local_depth"))


class Index:
    """The written index (bucket, key, chain, links, sha, keep_id, group_size, text) and its directory."""

    def __init__(self, entries: DataFrame, directory: DataFrame, depth: int):
        self.entries, self.directory, self.depth = entries, directory, depth

    def addressed(self, rows: DataFrame) -> DataFrame:
        """``rows(key, ...)`` with the bucket that the directory gives for the key."""
        cells = self.directory.select("cell", "bucket")
        if cells.count() <= BROADCAST_CELLS:
            cells = F.broadcast(cells)
        return rows.withColumn("cell", _leading_bits(F.col("key"), self.depth)).join(cells, "cell").drop("cell")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size, sha of each row of ``rows(doc_id, key, text)``."""
        found = ["doc_id", "keep_id", "group_size", "sha"]
        chained = self.entries.where("links > 1")
        keys = chained.select("key").distinct()
        collide = not keys.isEmpty()
        plain = (rows.join(keys, "key", "left_anti") if collide else rows).select("doc_id", "key")
        out = self.addressed(plain).join(self.entries.drop("text"), ["bucket", "key"]).select(*found)
        if collide:
            other = self.addressed(rows.join(keys, "key", "left_semi")).withColumnRenamed("text", "own")
            out = out.union(other.join(chained, ["bucket", "key"]).where("own = text").select(*found))
        return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> Index:
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col, key_bits)
    entries = rows.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = materialize(entries.select("key", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"), "dedup-entries")
    depth = depth_for(entries.count(), capacity)
    directory = materialize(build_directory(entries.select("key"), capacity, depth), "dedup-directory")
    by_key = Window.partitionBy("key")
    entries = entries.withColumns({"chain": F.row_number().over(by_key.orderBy("sha")), "links": F.count("*").over(by_key)})
    entries = materialize(entries, "dedup-chains")
    # texts of entries that share their key with others, from the rows they stand for
    ends = entries.where("links > 1").select("key", "chain", "sha", F.col("keep_id").alias("id"))
    if ends.isEmpty():
        texts = entries.select("key", "chain", F.lit(None).cast("string").alias("text")).limit(0)
    else:
        texts = rows.withColumnRenamed("key", "k").join(ends, (F.col("k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.unhex(F.sha2("text", 256)) == F.col("sha")))
        texts = texts.select("key", "chain", "text").distinct()
    index = Index(entries, directory, depth)
    path = shared_dir(spark, "dedup-index")
    placed = index.addressed(entries).join(texts, ["key", "chain"], "left")
    placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain").write.partitionBy("bucket").parquet(path)
    id_type = entries.schema["keep_id"].dataType.simpleString()
    index.entries = spark.read.schema(f"key long, chain int, sha binary, keep_id {id_type}, group_size long, links long, text string, bucket long").parquet(path)
    return index


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = build_index(docs, id_col, text_col, capacity, key_bits).lookup(_keyed(docs, id_col, text_col, key_bits))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """The rows of ``docs`` that survive, with all their columns."""
    keep = exact_dedup(docs, id_col, text_col, capacity, key_bits).where("kept").select(F.col("doc_id").alias("__keep"), F.unhex("text_sha256").alias("__sha")).distinct()
    same = docs[id_col].eqNullSafe(keep["__keep"]) & (F.unhex(F.sha2(text_of(text_col), 256)) == keep["__sha"])
    return docs.join(keep, same, "left_semi")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLE = {
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
