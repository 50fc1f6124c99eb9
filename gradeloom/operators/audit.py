"""Audits: leaf diffs of nested manifests, saved metrics, imported runs, snapshots, schema guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import valid_probabilities
from ..sources.files import materialized


#: Levels of a manifest that are opened between two writes.
LEVELS = 6
_HOLDS = "coalesce(v IS NOT NULL AND left(value, 1) IN ('{', '[') AND value NOT IN ('{}', '[]'), false)"
_NAME = "CASE WHEN x.key IS NULL THEN '[' || x.pos || ']' WHEN x.key RLIKE '^[A-Za-z0-9_-]+$' THEN '.' || x.key ELSE '[' || to_json(named_struct('k', x.key)) || ']' END"


def leaves(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value) of every leaf of a JSON text, however deep: a scalar, null, or an empty object or list,
    as JSON. Texts are read as VARIANT values once and opened level by level, some levels at a time; what is still
    to be opened then is written, so no plan grows with the depth. A text that is no JSON is a leaf itself."""
    spark, out = rows.sparkSession, None
    parsed = F.try_parse_json(json)
    value = F.when(parsed.isNull() & F.col(json).isNotNull(), F.to_json(F.struct(json))).otherwise(F.to_json(parsed))
    now = rows.select(key, F.lit("$").alias("path"), value.alias("value"), parsed.alias("v"))
    while True:
        for _ in range(LEVELS):
            # what does not hold anything stays as it is
            now = spark.sql(
                f"""SELECT t.`{key}`, CASE WHEN holds THEN t.path || {_NAME} ELSE t.path END AS path, CASE WHEN holds THEN to_json(x.value) ELSE t.value END AS value, CASE WHEN holds THEN x.value ELSE t.v END AS v
                FROM (SELECT *, {_HOLDS} AS holds FROM {{now}}) t, LATERAL variant_explode(CASE WHEN holds THEN t.v ELSE parse_json('[0]') END) x""".replace("IN ('{', '[')", "IN ('{{', '[')").replace("'{}'", "'{{}}'"),
                now=now,
            )
        now = materialized(now, "leaves")
        ended = now.where(f"NOT {_HOLDS}").select(key, "path", "value")
        out = ended if out is None else out.union(ended)
        now = now.where(_HOLDS)
        if now.isEmpty():
            return out


def _changed(left: DataFrame, right: DataFrame, key: str, json: str) -> DataFrame:
    """(key): keys, a null one included, but for those that both sides have with one text alone: there no leaf differs."""
    both = left.select(key, F.col(json).alias("text"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(right.select(key, json, F.lit(0), F.lit(1)))
    digest = both.select(key, F.sha2("text", 256).alias("text"), "a", "b")
    per = digest.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"), F.min("text").alias("low"), F.max("text").alias("high"), F.count_if(F.col("text").isNull()).alias("null"), F.count("*").alias("n"))
    same = (F.col("low") == F.col("high")) & (F.col("null") == 0) | (F.col("null") == F.col("n"))
    return per.where(F.col(key).isNull() | (F.col("a") + F.col("b") < 2) | ~F.coalesce(same, F.lit(False))).select(F.col(key).alias("changed"))


def manifest_diff(left: DataFrame, right: DataFrame, key: str, json: str, allowed: list[str]) -> DataFrame:
    """(key, path, status): leaves that only one side has or whose values differ, at any depth; paths that match an
    allow-list expression may be missing on the left. Only manifests whose texts differ are opened."""
    changed = materialized(_changed(left, right, key, json), "changed-manifests")
    left, right = (x.join(changed, F.col(key).eqNullSafe(F.col("changed")), "left_semi") for x in (left, right))
    a = leaves(left, key, json).withColumnRenamed("value", "a").withColumn("in_a", F.lit(True))
    b = leaves(right, key, json).withColumnRenamed("value", "b").withColumn("in_b", F.lit(True))
    both = a.join(b, [key, "path"], "full_outer")
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "missing").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    extra = F.lit(False)
    for p in allowed:
        extra = extra | F.col("path").rlike(p)
    return both.select(key, "path", status.alias("status")).where(F.col("status").isNotNull() & ~((F.col("status") == "added") & extra))


def close(a: Column, b: Column, relative: float = 1e-10, absolute: float = 1e-12) -> Column:
    """Whether two numbers agree within the tolerances (nulls agree with nulls only)."""
    near = F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.coalesce(near, a.isNull() & b.isNull())


def saved_metrics(recomputed: DataFrame, saved: DataFrame, metrics: list[str], key: str = "run_id") -> DataFrame:
    """(key, metric, status): equal, different, or missing on either side."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name), F.lit(True).alias(f"has_{name}")) for m in metrics])))

    both = long(recomputed, "now").join(long(saved, "then"), [key, "metric"], "full_outer")
    status = F.when(F.col("has_then").isNull(), "not_saved").when(F.col("has_now").isNull(), "not_recomputed").when(close(F.col("now"), F.col("then")), "equal").otherwise("different")
    return both.select(key, "metric", status.alias("status"))


def imported_match(local: DataFrame, imported: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows on both sides, on one only, equal decisions, and whether the run is a replication."""
    a = local.select(*keys, "row_id", F.col("pred").alias("a"), F.lit(1).alias("la"))
    b = imported.select(*keys, "row_id", F.col("pred").alias("b"), F.lit(1).alias("lb"))
    both = a.join(b, [*keys, "row_id"], "full_outer")
    found = F.col("la").isNotNull() & F.col("lb").isNotNull()
    out = both.groupBy(*keys).agg(F.count_if(found).alias("matched"), F.count_if(F.col("lb").isNull()).alias("local_only"), F.count_if(F.col("la").isNull()).alias("imported_only"), F.count_if(found & (F.col("a") == F.col("b"))).alias("same"))
    return out.withColumn("replicated", (F.col("same") == F.col("matched")) & (F.col("local_only") == 0) & (F.col("imported_only") == 0))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Counts of kept, missing, changed and added keys between two snapshots."""
    a, b = old.select(key, F.col(content).alias("a"), F.lit(1).alias("in_a")), new.select(key, F.col(content).alias("b"), F.lit(1).alias("in_b"))
    both = a.join(b, key, "full_outer")
    x, y = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.agg(F.count_if(x & y & same).alias("kept"), F.count_if(x & ~y).alias("missing"), F.count_if(x & y & ~same).alias("changed"), F.count_if(~x & y).alias("added"))


def check_features(features: list[tuple[str, str]], target: str, excluded: tuple[str, ...] = ()) -> None:
    """Planning-time guards: unique names, known kinds, no target or excluded column among the features."""
    names = [n for n, _ in features]
    if len(set(names)) < len(names):
        raise ValueError("a feature is declared twice")
    if bad := [n for n in names if n == target or n in excluded]:
        raise ValueError(f"not allowed as features: {bad}")
    if bad := [k for _, k in features if k not in ("numeric", "categorical")]:
        raise ValueError(f"unknown kinds: {bad}")


def schema_violations(rows: DataFrame, features: list[tuple[str, str]], allowed: dict[str, DataFrame], expected: list[str]) -> DataFrame:
    """(rule, field, n): non-finite numbers, unknown categories by (level) tables, and undeclared columns."""
    out = []
    for name, kind in features:
        if kind == "numeric":
            bad = F.isnan(name) | (F.abs(name) == float("inf"))
            out.append(rows.agg(F.count_if(bad).alias("n")).select(F.lit("non_finite").alias("rule"), F.lit(name).alias("field"), "n"))
        else:
            lost = rows.where(F.col(name).isNotNull()).join(allowed[name].select(F.col("level").alias(name)), name, "left_anti")
            out.append(lost.agg(F.count("*").alias("n")).select(F.lit("unknown_category").alias("rule"), F.lit(name).alias("field"), "n"))
    for name in rows.columns:
        if name not in expected:
            out.append(rows.agg(F.count(name).alias("n")).select(F.lit("extra_field").alias("rule"), F.lit(name).alias("field"), "n"))
    first, *rest = out
    for x in rest:
        first = first.union(x)
    return first


def equivalence(runs: DataFrame, reference: str, checks: list[str]) -> DataFrame:
    """Per run, whether each column of ``checks`` equals the reference run's."""
    one = runs.where(F.col("run_id") == reference).select(*[F.col(c).alias(f"__{c}") for c in checks])
    return runs.crossJoin(F.broadcast(one)).select("run_id", *[F.col(c).eqNullSafe(F.col(f"__{c}")).alias(f"same_{c}") for c in checks])


def run_checks(preds: DataFrame, training: DataFrame, runs: DataFrame, n_classes: int) -> DataFrame:
    """Per run: unique test rows, truths in range, test rows it trained on, its training rows, and whether
    these keep to its budget: that many of every class, none at 0, any number where it has none."""
    both = preds.join(training.select("run_id", "row_id", F.lit(1).alias("t")).distinct(), ["run_id", "row_id"], "left")
    seen = both.groupBy("run_id").agg((F.count("*") == F.count_distinct("row_id")).alias("unique_rows"), F.bool_and(F.col("y").between(0, n_classes - 1)).alias("truth_in_range"), F.count("t").alias("in_train"))
    per = training.groupBy("run_id", "label").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.sum("n").alias("n_train"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("classes"))
    rows = seen.join(F.broadcast(runs.select("run_id", "train_per_class")), "run_id").join(per, "run_id", "left").fillna(0, ["n_train"])
    k = F.col("train_per_class")
    even = (F.col("least") == k) & (F.col("most") == k) & (F.col("classes") == n_classes)
    kept = F.when(k.isNull(), F.col("n_train") > 0).when(k == 0, F.col("n_train") == 0).otherwise(F.coalesce(even, F.lit(False)))
    return rows.select("run_id", "unique_rows", "truth_in_range", "in_train", "n_train", kept.alias("within_budget"))


def projection_violations(rows: DataFrame, n_classes: int, unsafe: str) -> DataFrame:
    """Per run, counts of rows that must not be published, by reason."""
    label, error = F.col("label"), F.col("error")
    reasons = {
        "bad_latency": ~F.col("latency_s").between(0, 1e6),
        "bad_label": ~label.between(0, n_classes - 1),
        "bad_tokens": F.col("input_tokens") < 0,
        "unsafe": error.rlike(unsafe),
        "label_and_error": label.isNotNull() & error.isNotNull(),
        "neither": label.isNull() & error.isNull(),
        "bad_probabilities": F.col("probabilities").isNotNull() & ~valid_probabilities(F.col("probabilities"), n_classes),
    }
    out = rows.groupBy("run_id").agg(*[F.count_if(c).alias(k) for k, c in reasons.items()])
    return out.withColumn("bad_id", ~F.col("run_id").rlike(r"^[A-Za-z0-9_.-]+$"))
