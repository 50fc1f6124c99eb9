"""Queries for sources, guards and audits that compare two sides (IO, S2, A3, A5-A7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import keyed
from ..operators import audit, score
from ..sources import files
from .prep import NATIVE, PREPARED, _native, _prepared
from ..sources.shared import materialized
from .registry import query
from .scoring import CONF, per_class_sql
from .views import N_CLASSES, VIEWS, examples, predictions, runs, table, u

SEGMENTS = {"AUTOMOBILE": "cars", "BUILDING": "houses", "MACHINERY": "machines"}


@query("io02_csv", f"SELECT c_custkey AS row_id, CASE WHEN {u(chr(39) + 'gap' + chr(39), 'c_custkey')} % 4 = 0 THEN CAST(c_acctbal AS DOUBLE) END AS acctbal, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'cars' WHEN 'BUILDING' THEN 'houses' WHEN 'MACHINERY' THEN 'machines' END AS segment FROM customer")
def io02(spark, d):
    gap = keyed("gap", F.col("c_custkey")) % 4
    mark = F.when(gap == 1, "NA").when(gap == 2, "?").when(gap == 3, "")
    path = files.shared_folder(spark, "csv")
    table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.coalesce(mark, F.col("c_acctbal").cast("string")).alias("acctbal"), F.col("c_mktsegment").alias("segment")).write.csv(path, header=True)
    return files.read_csv(spark, path, "row_id long, acctbal double, segment string", {"segment": SEGMENTS})


@query("io03_jsonl", VIEWS + "SELECT run_id, row_id, label, round(latency_s, 9) AS latency_s, error FROM pred")
def io03(spark, d):
    path = files.shared_folder(spark, "jsonl")
    files.write_jsonl(predictions(spark, d).select("run_id", "row_id", "label", "latency_s", "error"), path)
    return files.read_jsonl(spark, path, "run_id string, row_id long, label int, latency_s double, error string").withColumn("latency_s", F.round("latency_s", 9))


@query("io04_torn_record", "SELECT user_id % 5 AS run, count(*) - 1 AS n FROM events GROUP BY 1")
def io04(spark, d):
    """An unfinished run per file: the last record of each was cut while being written."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("run"))
    last = e.groupBy("run").agg(F.max("event_id").alias("last"))
    line = F.to_json(F.struct("event_id", "run"))
    rows = e.join(last, "run").select("run", "event_id", F.when(F.col("event_id") == F.col("last"), F.substr(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value"), F.col("run").alias("folder"))
    path = files.shared_folder(spark, "torn")
    rows.repartition("run").sortWithinPartitions("run", "event_id").select("value", "folder").write.partitionBy("folder").text(path)
    return files.read_jsonl(spark, f"{path}/*", "event_id long, run long", complete=False).groupBy("run").agg(F.count("*").alias("n"))


@query("io05_report", CONF + f", {per_class_sql()} SELECT run_id, n_rows, round(accuracy, 6) AS scores_accuracy, round(macro_f1, 6) AS scores_macro_f1 FROM sc")
def io05(spark, d):
    s = score.scores(score.confusion(predictions(spark, d), N_CLASSES))
    path = files.shared_folder(spark, "report")
    files.write_report(s.select("run_id", "n_rows", F.struct(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1")).alias("scores")), path)
    return files.read_csv(spark, path, "run_id string, n_rows long, scores_accuracy double, scores_macro_f1 double")


@query("io06_prepared", PREPARED + "SELECT split, count(*) AS n_rows, true AS intact FROM prepared WHERE split IS NOT NULL GROUP BY 1")
def io06(spark, d):
    path, columns = files.shared_folder(spark, "prepared"), ["row_id", "label", "norm"]
    files.save_prepared(_prepared(spark, d).where("split is not null"), path, columns)
    return files.load_prepared(spark, path, columns)[1]


@query("io06_damaged", PREPARED + "SELECT split, count(*) + CASE split WHEN 'train' THEN 1 ELSE 0 END AS n_rows, split = 'test' AS intact FROM prepared WHERE split IS NOT NULL GROUP BY 1")
def io06_damaged(spark, d):
    """A row added to the saved training split, and another label in one row of the validation split."""
    path, columns = files.shared_folder(spark, "prepared"), ["row_id", "label", "norm"]
    rows = materialized(_prepared(spark, d).where("split is not null").select(*columns, "split"), "prepared-rows")
    files.save_prepared(rows, path, columns)
    least = rows.where("split = 'validation'").agg(F.min("row_id")).first()[0]
    rows.where("split = 'train'").orderBy("row_id").limit(1).select(*columns).write.mode("append").parquet(f"{path}/rows/split=train")
    changed = rows.where("split = 'validation'").withColumn("label", F.when(F.col("row_id") == least, (F.col("label") + 1) % 4).otherwise(F.col("label")))
    changed.select(*columns).write.mode("overwrite").parquet(f"{path}/rows/split=validation")
    return files.load_prepared(spark, path, columns)[1]


GUARD = [("acctbal", "numeric"), ("nation", "categorical")]


@query("s02_schema_guards", NATIVE + f""", g AS (SELECT *, {u("'bad'", "row_id")} AS b FROM tab) SELECT 'non_finite' AS rule, 'acctbal' AS field, count(*) FILTER (WHERE b % 71 = 0) AS n FROM g
UNION ALL SELECT 'unknown_category', 'nation', count(*) FILTER (WHERE b % 73 = 0) FROM g UNION ALL SELECT 'extra_field', 'note', count(*) FILTER (WHERE b % 79 = 0) FROM g""")
def s02(spark, d):
    audit.check_features(GUARD, "label", ("split",))
    b = keyed("bad", F.col("row_id"))
    rows = _native(spark, d).withColumns({
        "acctbal": F.when(b % 71 == 0, float("nan")).otherwise(F.col("acctbal")),
        "nation": F.when(b % 73 == 0, "nowhere").otherwise(F.col("nation")),
        "note": F.when(b % 79 == 0, "x"),
    })
    levels = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("level"))
    return audit.schema_violations(rows, GUARD, {"nation": levels}, ["row_id", "label", "split", "acctbal", "nation"])


def _manifests(spark, d):
    """Two manifests per event: the second with some values changed, leaves lost, and notes added."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", keyed("man", F.col("event_id")).alias("h"))
    run = F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user"), F.array(F.col("event_id"), F.lit(1)).alias("ids")).alias("who"))
    left = e.select("event_id", F.to_json(F.struct(F.lit(1).alias("version"), run.alias("run"))).alias("manifest"))
    kind = F.when(F.col("h") % 83 == 0, "edited").otherwise(F.when(F.col("h") % 89 != 0, F.col("event_type")))
    note = F.when(F.col("h") % 7 == 0, F.struct(F.lit("kept apart").alias("note")))
    other = F.when(F.col("h") % 97 == 0, "x")
    who = F.struct(F.col("user_id").alias("user"), F.array(F.col("event_id"), F.lit(1)).alias("ids"))
    right = e.select("event_id", F.to_json(F.struct(F.lit(1).alias("version"), F.struct(kind.alias("kind"), who.alias("who"), other.alias("owner")).alias("run"), note.alias("supplement"))).alias("manifest"))
    return left, right


@query("a03_manifest_diff", f"""WITH e AS (SELECT event_id, {u("'man'", "event_id")} AS h FROM events), x AS (SELECT '$.run.kind' AS path, CASE WHEN h % 83 = 0 THEN 'changed' WHEN h % 89 = 0 THEN 'missing' END AS status FROM e
UNION ALL SELECT '$.run.owner', CASE WHEN h % 97 = 0 THEN 'added' END FROM e) SELECT path, status, count(*) AS n FROM x WHERE status IS NOT NULL GROUP BY 1, 2""")
def a03(spark, d):
    return audit.manifest_diff(*_manifests(spark, d), "event_id", "manifest", [r"^\$\.supplement"]).groupBy("path", "status").agg(F.count("*").alias("n"))


DEEP = 12


@query("a03_deep_diff", f"""WITH e AS (SELECT {u("'man'", "event_id")} AS h FROM events), x AS (SELECT '$' || repeat('.in[1]', {DEEP}) || '.kind' AS path, CASE WHEN h % 83 = 0 THEN 'changed' END AS status FROM e
UNION ALL SELECT '$' || repeat('.in[1]', {DEEP}) || '.list[0]', CASE WHEN h % 89 = 0 THEN 'missing' END FROM e UNION ALL SELECT '$' || repeat('.in[1]', {DEEP}) || '.list', CASE WHEN h % 89 = 0 THEN 'added' END FROM e) SELECT path, status, count(*) AS n FROM x WHERE status IS NOT NULL GROUP BY 1, 2""")
def a03_deep(spark, d):
    """Differences twelve objects and lists down: a changed value, and a list that lost its only entry."""
    e = table(spark, d, "events").select("event_id", "event_type", keyed("man", F.col("event_id")).alias("h"))

    def manifest(kind, entries):
        inner = F.to_json(F.struct(kind.alias("kind"), entries.alias("list")))
        return F.concat(F.lit('{"in":[null,' * DEEP), inner, F.lit("]}" * DEEP)).alias("manifest")

    left = e.select("event_id", manifest(F.col("event_type"), F.array("event_id")))
    kind = F.when(F.col("h") % 83 == 0, "edited").otherwise(F.col("event_type"))
    entries = F.when(F.col("h") % 89 == 0, F.array().cast("array<long>")).otherwise(F.array("event_id"))
    return audit.manifest_diff(left, e.select("event_id", manifest(kind, entries)), "event_id", "manifest", []).groupBy("path", "status").agg(F.count("*").alias("n"))


@query("a05_saved_metrics", VIEWS + "SELECT run_id, metric, CASE WHEN run_id = 'hosted' THEN 'not_saved' WHEN run_id = 'zero' AND metric = 'accuracy' THEN 'different' ELSE 'equal' END AS status FROM (SELECT DISTINCT run_id FROM pred), (SELECT unnest(['accuracy', 'failure_rate']) AS metric)")
def a05(spark, d):
    """Metrics from confusion cells against ones saved from plain row averages; one was saved wrong, one not at all."""
    p = predictions(spark, d)
    saved = p.groupBy("run_id").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"), F.avg((F.col("pred") < 0).cast("double")).alias("failure_rate"))
    path = files.shared_folder(spark, "saved-metrics")
    saved.where("run_id <> 'hosted'").withColumn("accuracy", F.col("accuracy") + F.when(F.col("run_id") == "zero", 1e-6).otherwise(0.0)).write.parquet(path)
    return audit.saved_metrics(score.scores(score.confusion(p, N_CLASSES)), spark.read.parquet(path), ["accuracy", "failure_rate"])


@query("a06_imported_runs", VIEWS + f""", i AS (SELECT run_id, row_id, pred, {u("'imp'", "row_id")} AS h FROM pred), j AS (SELECT *, run_id = 'base' AND h % 101 = 0 AS edited, run_id = 'direct' AND h % 103 = 0 AS lost FROM i)
SELECT model, arm, train_per_class, seed, count(*) FILTER (WHERE NOT lost) AS matched, count(*) FILTER (WHERE lost) AS local_only, 0::BIGINT AS imported_only, count(*) FILTER (WHERE NOT lost AND NOT edited) AS same, count(*) FILTER (WHERE lost OR edited) = 0 AS replicated
FROM j JOIN runs USING (run_id) WHERE train_per_class IS NOT NULL GROUP BY 1, 2, 3, 4""")
def a06(spark, d):
    keys = ["model", "arm", "train_per_class", "seed"]
    local = predictions(spark, d).join(F.broadcast(runs(spark).select("run_id", *keys)), "run_id").where("train_per_class is not null")
    h = keyed("imp", F.col("row_id"))
    imported = local.where(~((F.col("run_id") == "direct") & (h % 103 == 0))).withColumn("pred", F.when((F.col("run_id") == "base") & (h % 101 == 0), F.col("pred") + 1).otherwise(F.col("pred")))
    return audit.imported_match(local, imported, keys)


@query("a07_snapshots", VIEWS + f""", s AS (SELECT source_split, {u("'snap'", "row_id")} AS h FROM ex) SELECT count(*) FILTER (WHERE source_split = 'train' AND h % 53 <> 0 AND h % 59 <> 0) AS kept, count(*) FILTER (WHERE source_split = 'train' AND h % 53 = 0) AS missing,
count(*) FILTER (WHERE source_split = 'train' AND h % 53 <> 0 AND h % 59 = 0) AS changed, count(*) FILTER (WHERE source_split = 'test' AND h % 53 <> 0) AS added FROM s""")
def a07(spark, d):
    h = keyed("snap", F.col("row_id"))
    ex = examples(spark, d).select("row_id", "source_split", F.sha2("text", 256).alias("content"), h.alias("h"))
    new = ex.where("h % 53 <> 0").withColumn("content", F.when(F.col("h") % 59 == 0, F.concat("content", F.lit("+"))).otherwise(F.col("content")))
    return audit.snapshot_diff(ex.where("source_split = 'train'"), new, "row_id", "content")
