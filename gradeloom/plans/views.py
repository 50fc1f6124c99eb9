"""Evaluation tables derived from the given tables, in Spark and as SQL for the checks.

``examples`` is a text corpus of 4 language classes; ``predictions`` applies hash-defined runs of known
accuracy to its test rows; ``ledger`` reads ``events`` as reservations and settlements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import coded, keyed, normalized_text

N_CLASSES = 4
LANGS = ("de", "en", "es", "fr")
#: run_id, model, arm, train_per_class, seed, status, source_run_id, percent right
RUNS = [
    ("base", "m1", "source", 4, 42, "complete", None, 60),
    ("review", "m1", "review", 4, 42, "complete", "base", 75),
    ("direct", "m1", "direct", 4, 42, "complete", None, 70),
    ("weak", "m2", "source", 4, 42, "complete", None, 0),
    ("hosted", "m3", "source", None, 42, "complete", None, 80),
    ("zero", "m1", "source", 0, 42, "complete", None, 50),
    ("pending", "m2", "review", 4, 42, "running", "weak", 0),
]
RUN_SCHEMA = "run_id string, model string, arm string, train_per_class int, seed int, status string, source_run_id string, acc int"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def examples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    label = (F.array_position(F.array(*map(F.lit, LANGS)), F.col("lang")) - 1).cast("int")
    split = F.when(keyed("split", F.col("doc_id")) % 5 == 0, "test").otherwise("train")
    return docs.select(F.col("doc_id").alias("row_id"), "text", normalized_text(F.col("text")).alias("norm"), label.alias("label"), split.alias("source_split"))


def runs(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(v).cast(t.split()[1]).alias(t.split()[0]) for v, t in zip(r, RUN_SCHEMA.split(", "), strict=True)]) for r in RUNS])
    return spark.range(1).select(F.inline(rows)).withColumn("dataset", F.lit("docs"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """One row per complete run and test row, with the truth y, the coded class and usage."""
    test = examples(spark, d).where("source_split = 'test'").select("row_id", F.col("label").alias("y"), F.length("text").alias("chars"))
    # the list of runs is a literal of a few rows
    rows = test.crossJoin(F.broadcast(runs(spark).where("status = 'complete'").select("run_id", "source_run_id", "acc")))
    run, row = F.col("run_id"), F.col("row_id")
    x = keyed(run, row) % 100
    failed = (x >= 97) & (run != "weak")
    wrong = ((F.col("y") + 1 + keyed(F.concat(run, F.lit(":w")), row) % 3) % N_CLASSES).cast("int")
    label = F.when(run == "weak", 1).when(failed, None).when(x < F.col("acc"), F.col("y")).otherwise(wrong)
    kinds = ["network_error: reset", "http_error: status=402; credit", "http_error: status=500; retry", "invalid_output: text"]
    error = F.when(failed, F.element_at(F.array(*map(F.lit, kinds)), (keyed("e", row) % 4 + 1).cast("int")))
    top = F.lit(0.4) + (keyed(F.concat(F.lit("p"), run), row) % 60) / 100
    p = F.when(F.col("label").isNotNull() & (run != "hosted"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when(k == F.col("label"), F.col("top")).otherwise((1 - F.col("top")) / 3)))
    out = rows.select("run_id", "source_run_id", "row_id", "y", label.cast("int").alias("label"), error.alias("error"), top.alias("top"), ((keyed(F.concat(F.lit("t"), run), row) % 2000) / 1000).alias("latency_s"), F.when(keyed("k", row) % 50 != 0, F.floor(F.col("chars") / 4)).alias("input_tokens"), F.lit(4).cast("long").alias("output_tokens"))
    return out.withColumn("probabilities", p).withColumn("pred", coded(F.col("label"), N_CLASSES, F.col("error"))).drop("top")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Reserve, result and settle events of each ledger in order of ``seq`` (header: seq 0)."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("ledger_id"), "ts", "event_type", F.ceil(F.col("value").cast("decimal(18,6)") * 1_000_000_000).cast("long").alias("reserved_nano"))
    outcome = F.when(F.col("event_type").isin("purchase", "click", "view"), "returned").when(F.col("event_type") == "error", "prediction_error")
    kinds = F.filter(F.array(F.lit("reserve"), F.when(F.col("event_type") != "signup", "result"), F.when(F.col("event_type") == "purchase", "settle")), lambda k: k.isNotNull())
    e = e.withColumn("outcome", outcome).select("*", F.posexplode(kinds).alias("step", "type"))
    from ..operators.rank import ranked

    e = ranked(e, ["ledger_id"], F.date_format("ts", "yyyyMMddHH"), ["ts", "event_id", "step"], "seq")
    charged = F.when(F.col("type") == "settle", F.expr("(reserved_nano * 8 + 9) div 10"))
    return e.select("ledger_id", "seq", "type", F.col("event_id").alias("reservation_id"), F.when(F.col("type") == "reserve", F.col("reserved_nano")).alias("reserved_nano"), charged.alias("charged_nano"), F.when(F.col("type") == "result", F.col("outcome")).alias("outcome"), "ts")


def u(tag: str, key: str) -> str:
    return f"('0x' || substr(md5({tag} || ':' || {key}), 1, 8))::BIGINT"


_RUN_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in RUNS)
VIEWS = rf"""WITH ex AS (SELECT doc_id AS row_id, text, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS norm,
  CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER) AS label, CASE WHEN {u("'split'", "doc_id")} % 5 = 0 THEN 'test' ELSE 'train' END AS source_split FROM documents),
runs AS (SELECT *, 'docs' AS dataset FROM (VALUES {_RUN_ROWS}) t(run_id, model, arm, train_per_class, seed, status, source_run_id, acc)),
p0 AS (SELECT run_id, source_run_id, acc, row_id, label AS y, length(text) AS chars, {u("run_id", "row_id")} % 100 AS x FROM ex, runs WHERE source_split = 'test' AND status = 'complete'),
p1 AS (SELECT *, x >= 97 AND run_id <> 'weak' AS failed, CAST(CASE WHEN run_id = 'weak' THEN 1 WHEN x >= 97 THEN NULL WHEN x < acc THEN y ELSE (y + 1 + {u("run_id || ':w'", "row_id")} % 3) % 4 END AS INTEGER) AS label,
  0.4::DOUBLE + ({u("'p' || run_id", "row_id")} % 60) / 100 AS top FROM p0),
pred AS (SELECT run_id, source_run_id, row_id, y, label, coalesce(label, -1) AS pred,
  CASE WHEN failed THEN ['network_error: reset', 'http_error: status=402; credit', 'http_error: status=500; retry', 'invalid_output: text'][{u("'e'", "row_id")} % 4 + 1] END AS error,
  CASE WHEN label IS NOT NULL AND run_id <> 'hosted' THEN [CASE WHEN label = 0 THEN top ELSE (1 - top) / 3 END, CASE WHEN label = 1 THEN top ELSE (1 - top) / 3 END, CASE WHEN label = 2 THEN top ELSE (1 - top) / 3 END, CASE WHEN label = 3 THEN top ELSE (1 - top) / 3 END] END AS p,
  ({u("'t' || run_id", "row_id")} % 2000) / 1000 AS latency_s, CASE WHEN {u("'k'", "row_id")} % 50 <> 0 THEN chars // 4 END AS input_tokens, 4 AS output_tokens FROM p1),
ev AS (SELECT event_id, user_id % 10 AS ledger_id, ts, event_type, CAST(ceil(CAST(value AS DECIMAL(18,6)) * 1000000000) AS BIGINT) AS nano FROM events),
ev2 AS (SELECT *, unnest(list_filter(['reserve', CASE WHEN event_type <> 'signup' THEN 'result' END, CASE WHEN event_type = 'purchase' THEN 'settle' END], lambda k: k IS NOT NULL)) AS type FROM ev),
ledger AS (SELECT ledger_id, row_number() OVER (PARTITION BY ledger_id ORDER BY ts, event_id, CASE type WHEN 'reserve' THEN 0 WHEN 'result' THEN 1 ELSE 2 END) AS seq, type, event_id AS reservation_id,
  CASE WHEN type = 'reserve' THEN nano END AS reserved_nano, CASE WHEN type = 'settle' THEN (nano * 8 + 9) // 10 END AS charged_nano,
  CASE WHEN type = 'result' THEN CASE WHEN event_type = 'error' THEN 'prediction_error' ELSE 'returned' END END AS outcome, ts FROM ev2),
cells AS (SELECT run_id, y, pred, count(*) AS n FROM pred GROUP BY ALL),
cls AS (SELECT unnest([0, 1, 2, 3]) AS c)
"""
