"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes (words) are summed per source; targets are weight shares of the whole, a source stopping at
   ``max_epochs`` times its size while the excess is reshared by weight (water filling).
2. Each source is dealt, by a keyed hash of doc_id, into permuted blocks of about ``block_rows`` rows.
   Whole epochs take every block; what is left of the target takes blocks in permuted order. In the block
   where it ends documents are taken in hash order, the one that crosses the target if that is nearer.
3. The block draws of all sources are split among the output shards by a tree: each node draws, from
   the exact per-source quotas it was handed, those of its left half by the multivariate hypergeometric
   law; the right half gets the rest. Leaves hold the quotas of a shard, summing exactly to the draws.
4. Within a source, permuted draws fill the shards' quotas place by place, so shards hold disjoint blocks. A
   document is taken once for each place that its block has got; ``write_mix`` lays out each shard in a
   keyed-hash order.

Ranks and prefix sums over blocks, draws and shards are taken bucket by bucket (``operators.rank``), so
no source has to fit one task; windows see a table of sources or the rows of one block.

Defined results: null text has size 0 and takes no words; null source is a source of its own, ranked
last; repeated rows count as rows; a null doc_id hashes as zeros; empty tables give empty results; further
columns are kept by ``mix_documents``, where rows alike in doc_id, source and text are taken alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rank import ranked, running_total
from .shared import WORD, materialize, text_of

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK_ROWS = 1024
SHARD_WORDS = 4_000_000
SEED = "mix"


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, sid, source_size, n_rows, target) per source from ``sizes(source, size)``; a row per source,
    so the windows below see a table of sources only."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("ratio", max_epochs * F.col("source_size") / F.col("w"))
    # filled in order of ratio, source j stops when the level of the others exceeds its ratio
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(max_epochs * F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(onward)
    per = per.withColumn("level", level)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return per.select("source", "sid", "source_size", "n_rows", F.least((max_epochs * F.col("source_size")).cast("double"), level * F.col("w")).alias("target"))


def _split_node(pdf, seed: int, levels: int):
    """Split a node's quotas down to leaves, or ``levels`` levels deep; numpy draws, one vector a node."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("sid")
    sources, out = pdf["sid"].to_numpy(), []
    todo = [(int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]), pdf["n"].to_numpy(np.int64), 0)]
    while todo:
        lo, hi, quota, depth = todo.pop()
        if hi - lo == 1 or depth == levels:
            out.append(pd.DataFrame({"sid": sources, "lo": lo, "hi": hi, "n": quota}))
            continue
        mid, total = (lo + hi) // 2, int(quota.sum())
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(quota, total * (mid - lo) // (hi - lo), method="marginals")
        todo += [(mid, hi, quota - left, depth + 1), (lo, mid, left, depth + 1)]
    return pd.concat(out)[["sid", "lo", "hi", "n"]]


def split_quotas(quotas: DataFrame, shards: int, seed: int = 7, levels: int = 6) -> DataFrame:
    """(sid, lo, n): exact quotas of each shard ``lo`` from ``quotas(sid, n)``."""
    tree = quotas.select(F.col("sid").cast("int").alias("sid"), F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.col("n").cast("long").alias("n"))
    depth = 0
    while depth == 0 or (1 << depth) < shards:
        tree = tree.groupBy("lo", "hi").applyInPandas(lambda pdf: _split_node(pdf, seed, levels), "sid int, lo long, hi long, n long")
        depth += levels
    return tree.select("sid", "lo", "n")


def place_draws(blocks: DataFrame, shards: int, seed: str) -> DataFrame:
    """(sid, block, drawn): the shards of each block's draws, from ``blocks(sid, block, draws)``. The tree
    gives every shard its number of places per source; permuted draws take the places in turn."""
    quotas = materialize(split_quotas(blocks.groupBy("sid").agg(F.sum("draws").alias("n")), shards), "mix-quotas")
    first = running_total(quotas, ["sid"], F.floor(F.col("lo") / 4096), ["lo"], "n", "first").where("n > 0")
    places = first.select("sid", F.col("lo").alias("shard"), F.explode(F.expr("sequence(first + 1, first + n)")).alias("at"))
    draw = blocks.where("draws > 0").select("sid", "block", F.explode(F.expr("sequence(1L, draws)")).alias("epoch"))
    draw = draw.withColumn("lot", F.md5(F.concat_ws(":", F.lit(seed), "sid", "block", "epoch")))
    draw = ranked(draw, ["sid"], F.substring("lot", 1, 3), ["lot", "block", "epoch"], "at")
    placed = draw.join(places, ["sid", "at"])
    return placed.groupBy("sid", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "shard"))), lambda x: x["shard"]).alias("drawn"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block_rows: int = BLOCK_ROWS, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """A row per document: doc_id, source, text_key, size, source_size, target, copies, taken, shards (one output
    shard per copy)."""
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    h = F.coalesce(F.md5(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("string"))), F.lit("0" * 32))
    rows = materialize(docs.select("doc_id", "source", F.xxhash64(text_of()).alias("text_key"), size.alias("size"), h.alias("h")), "mix-sizes")
    plan = materialize(source_plan(rows, weights, max_epochs), "mix-plan")
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, round(total / shard_words))

    epochs = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))
    plan = plan.withColumns({
        "epochs": F.when(F.col("source_size") > 0, epochs).otherwise(0).cast("long"),
        "nb": F.ceil(F.col("n_rows") / block_rows).cast("long"),
    }).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    p, r = plan.alias("p"), rows.alias("r")
    block = F.floor(F.conv(F.substring("r.h", 1, 8), 16, 10).cast("long") * F.col("p.nb") / (1 << 32)).cast("long")
    dealt = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", "p.sid", block.alias("block"))

    blocks = dealt.groupBy("sid", "block").agg(F.sum("size").alias("block_size"))
    blocks = running_total(blocks, ["sid"], F.floor(F.col("block") / 4096), ["block"], "block_size", "base")
    blocks = blocks.join(plan.select("sid", "source_size", "target", "epochs", "rest"), "sid")
    more = (F.col("base") < F.col("rest")).cast("long")
    blocks = materialize(blocks.withColumn("draws", F.col("epochs") + more), "mix-blocks")
    placed = blocks.join(place_draws(blocks, shards, seed), ["sid", "block"], "left")

    # a document is drawn as often as its block has places; the last place of the block where the target
    # ends holds only the documents up to there
    within = Window.partitionBy("sid", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = dealt.withColumn("cum", F.sum("size").over(within)).join(placed, ["sid", "block"])
    end = F.col("base") + F.col("cum")
    reached = (end <= F.col("rest")) | ((end - F.col("size") < F.col("rest")) & (end - F.col("rest") < F.col("rest") - (end - F.col("size"))))
    drawn = F.coalesce("drawn", F.array().cast("array<long>"))
    copies = F.size(drawn) - F.when((F.size(drawn) > F.col("epochs")) & ~reached, 1).otherwise(0)
    out = d.select("doc_id", "source", "text_key", "size", "source_size", "target", copies.cast("long").alias("copies"), drawn.alias("drawn"))
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.slice("drawn", F.lit(1), F.col("copies").cast("int")).alias("shards"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` once per copy taken (repeats are repeated rows), with the
    shard it goes to in ``__shard``."""
    taken = mix(docs, **options).where("copies > 0").groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_key").alias("__key")).agg(F.min("shards").alias("__shards"))
    same = docs["doc_id"].eqNullSafe(taken["__id"]) & docs["source"].eqNullSafe(taken["__source"]) & (F.xxhash64(text_of()) == taken["__key"])
    return docs.join(taken, same).withColumn("__shard", F.explode("__shards")).drop("__shards", "__id", "__source", "__key")


def write_mix(docs: DataFrame, path: str, seed: str = SEED, **options) -> None:
    """One Parquet folder per shard, each in a keyed-hash order."""
    mixed = mix_documents(docs, seed=seed, **options)
    mixed.repartition("__shard").sortWithinPartitions("__shard", F.md5(F.concat_ws(":", F.lit(seed), "doc_id"))).write.partitionBy("__shard").parquet(path)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLE = {
    "op9_mix_sources": r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || doc_id) AS h FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER) AS w FROM s GROUP BY source),
rated AS (SELECT *, CAST(3 * source_size AS DOUBLE) / w AS ratio FROM per),
lev AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
               / CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM rated),
one AS (SELECT arg_min(level, ratio) AS level FROM lev WHERE level <= ratio),
plan AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), one.level * w) AS target FROM lev, one),
ep AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS epochs FROM plan),
run AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM s)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN cum <= target - epochs * source_size OR (cum - size < target - epochs * source_size AND cum - (target - epochs * source_size) < target - epochs * source_size - (cum - size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run JOIN ep ON run.source IS NOT DISTINCT FROM ep.source"""
}
