"""Readers and writers of evaluation files on Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prep import fingerprint
from .shared import materialized, shared_folder

#: Fields that stand for a missing one.
NULL_MARKERS = ("", "NA", "?")


def read_csv(spark: SparkSession, path: str, schema: str, recode: dict[str, dict[str, str]] | None = None, header: bool = True) -> DataFrame:
    """A CSV table with declared columns. Null markers become null in every column before it takes its type;
    ``recode`` maps the codes of a column to names (codes it lacks become null)."""
    declared = T.StructType.fromDDL(schema)
    rows = spark.read.csv(path, header=header, schema=T.StructType([T.StructField(f.name, T.StringType()) for f in declared]), enforceSchema=False)
    out = []
    for f in declared:
        text = F.trim(f.name)
        value = F.when(~F.coalesce(text, F.lit("")).isin(*NULL_MARKERS), text)
        if recode and f.name in recode:
            value = F.element_at(F.create_map(*[F.lit(x) for pair in recode[f.name].items() for x in pair]), value)
        out.append(value.try_cast(f.dataType).alias(f.name))
    return rows.select(*out)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, complete: bool = True) -> DataFrame:
    """JSON lines by a declared schema. A record that does not parse is an error, but for the last one of a
    file of an unfinished run (``complete=False``), which may be torn and is left out.

    Lines are ordered by the offset of their split and their place in it, so a file may be split among tasks."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    lines = lines.where(F.trim("value") != "")
    full = f"{schema}, __torn string"
    parsed = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__torn"}))
    torn = F.col("r.__torn").isNotNull()
    if complete:
        bad = parsed.where(torn)
    else:
        last = lines.groupBy("file").agg(F.max("at").alias("last"))
        bad = parsed.where(torn).join(last, "file").where("at <> last")
    first = bad.select("file").head(1)
    if first:
        raise ValueError(f"a record of {first[0]['file']} is not JSON")
    return parsed.where(~torn).select("r.*").drop("__torn")


def write_report(rows: DataFrame, path: str) -> None:
    """A flat CSV sheet: fields of structs become columns of their own, arrays and maps JSON text."""
    out = []
    for f in rows.schema:
        if isinstance(f.dataType, T.StructType):
            out += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType]
        elif isinstance(f.dataType, T.ArrayType | T.MapType):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    rows.select(*out).write.csv(path, header=True)


def save_prepared(rows: DataFrame, path: str, columns: list[str], split: str = "split") -> None:
    """A prepared dataset, partitioned by split, with a manifest of counts and content fingerprints."""
    rows.select(*columns, split).write.partitionBy(split).parquet(f"{path}/rows")
    fingerprint(rows, columns, [split]).write.parquet(f"{path}/manifest")


def load_prepared(spark: SparkSession, path: str, columns: list[str], split: str = "split") -> tuple[DataFrame, DataFrame]:
    """(rows, check): the check has per split the rows found and whether count and content match the manifest."""
    rows = spark.read.parquet(f"{path}/rows")
    now = fingerprint(rows, columns, [split])
    then = spark.read.parquet(f"{path}/manifest").select(F.col(split).alias("s"), F.col("n_rows").alias("n"), F.col("fingerprint").alias("f"))
    both = now.join(then, F.col(split).eqNullSafe(F.col("s")), "full_outer")
    same = F.col("n_rows").eqNullSafe(F.col("n")) & F.col("fingerprint").eqNullSafe(F.col("f"))
    return rows, both.select(F.coalesce(split, "s").alias(split), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), same.alias("intact"))
