"""A training-data pipeline over ``documents``: five stages, each written as Parquet and reread.

toxicity drops what is predicted toxic; exact dedup keeps the row with the largest doc_id of equal
texts; the n-gram Jaccard join keeps the least doc_id of each component of near copies; mixing repeats
or leaves out documents towards the sources' target weights; the last stage encodes the texts.

Defined results: null and empty texts are clean, equal to each other, near no other text, take part in mixing
with size 0 (so whole epochs repeat them and a rest leaves them out) and have no pieces; rows with null doc_id
pass like others, but are no one's near copy; repeated rows stay repeated where their doc_id survives; ties go
as the operators state; further columns are kept up to the last stage; an empty table gives an empty result.
Long texts are taken whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import exact_dedup, jaccard_join, mixing, sentence_pieces, toxicity
from gradeloom.llm.shared import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs).drop("__shard")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentence_pieces.encode(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("sentence pieces", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
