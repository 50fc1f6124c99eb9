"""Control arms: contrasts between arms on the same cases, repeated requests, recovery overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contrast import transition_counts
from .score import confusion, missing_classes, scores

METRICS = ("accuracy", "macro_f1", "balanced_accuracy")


def arm_contrasts(results: DataFrame, expected: DataFrame, pairs: list[tuple[str, str]], n_classes: int) -> DataFrame:
    """Per (a, b) of ``pairs``: deltas a - b of the scores and transitions b -> a, from ``results(case_id, arm, y,
    pred)``. ``expected(arm, n_expected)`` decides completeness; a pair with an incomplete arm is pending, without figures."""
    s = results.sparkSession
    listed = s.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])))
    have = expected.join(results.groupBy("arm").agg(F.count("*").alias("n")), "arm", "left")
    done = have.select("arm", (F.coalesce("n", F.lit(0)) == F.col("n_expected")).alias("complete"))
    m = scores(confusion(results, n_classes, ("arm",)), ("arm",)).select("arm", *METRICS)
    # no balanced accuracy where a class has no rows
    whole = missing_classes(results.withColumnRenamed("arm", "run_id"), n_classes).select(F.col("run_id").alias("arm"), "available")
    m = m.join(whole, "arm").withColumn("balanced_accuracy", F.when(F.col("available"), F.col("balanced_accuracy"))).drop("available")
    out = listed
    for k in "ab":
        side = done.join(m, "arm", "left").select(F.col("arm").alias(k), F.col("complete").alias(f"{k}_complete"), *[F.col(c).alias(f"{k}_{c}") for c in METRICS])
        out = out.join(side, k, "left")
    x = results.select("case_id", F.col("arm").alias("a"), "y", F.col("pred").alias("now")).join(F.broadcast(listed), "a")
    z = results.select("case_id", F.col("arm").alias("b"), F.col("pred").alias("before"))
    moves = x.join(z, ["case_id", "b"]).groupBy("a", "b").agg(*transition_counts(F.col("y"), F.col("before"), F.col("now")))
    ready = F.coalesce(F.col("a_complete") & F.col("b_complete"), F.lit(False))
    counts = ("wrong_to_correct", "correct_to_wrong", "changed", "net")
    out = out.join(moves, ["a", "b"], "left").withColumn("status", F.when(ready, "complete").otherwise("pending"))
    return out.select("a", "b", "status", *[F.when(ready, F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"delta_{c}") for c in METRICS], *[F.when(ready, F.col(c)).alias(c) for c in counts])


def repeat_diagnostic(first: DataFrame, repeats: DataFrame, expected: DataFrame, by: str = "dataset") -> DataFrame:
    """Per ``by`` of ``expected(by, expected)``: repeated requests against their references, by ``(by, case_id, pred,
    model)``: agreement, and failures of the reference only, of the repeat only and of both; all figures are
    withheld until every pair exists."""
    r = repeats.select(by, "case_id", F.col("pred").alias("again"), F.col("model").alias("model_again"))
    both = r.join(first.select(by, "case_id", "pred", "model"), [by, "case_id"])
    a, b = F.col("pred"), F.col("again")
    counts = {
        "agree": (a >= 0) & (a == b), "disagree": (a >= 0) & (b >= 0) & (a != b), "both_failed": (a < 0) & (b < 0), "reference_failed": (a < 0) & (b >= 0), "repeat_failed": (a >= 0) & (b < 0),
        "model_mismatch": F.col("model") != F.col("model_again"),
    }
    s = expected.join(both.groupBy(by).agg(F.count("*").alias("pairs"), *[F.count_if(c).alias(k) for k, c in counts.items()]), by, "left").fillna(0, ["pairs"])
    ready = F.col("pairs") == F.col("expected")
    return s.select(by, "expected", "pairs", F.when(ready, "complete").otherwise("pending").alias("status"), *[F.when(ready, F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counts])


def overlay(results: DataFrame, attempts: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """``results`` with failed predictions replaced by their earliest valid attempt among the first ``most``,
    else left failed; answered rows never change."""
    last = attempts.where(F.col("attempt_index") <= most).groupBy(*keys).agg(F.min_by("pred", F.when(F.col("pred") >= 0, F.col("attempt_index"))).alias("retry"))
    out = results.join(last, keys, "left")
    return out.withColumn("pred", F.when(F.col("pred") < 0, F.coalesce("retry", "pred")).otherwise(F.col("pred"))).drop("retry")


def condition_summary(views: DataFrame, dependents: DataFrame, n_classes: int) -> DataFrame:
    """Per (run_id, view): rows, failures, scores, and rows whose own source failed in that view, from
    ``views(run_id, view, row_id, y, pred)`` and ``dependents(run_id, source_run_id)``; no scores where a row is
    still unattempted (pred null)."""
    per = views.groupBy("run_id", "view").agg(F.count("*").alias("n_rows"), F.count_if(F.col("pred").isNull()).alias("unattempted"), F.count_if(F.col("pred") < 0).alias("failures"))
    s = scores(confusion(views.where("pred is not null"), n_classes, ("run_id", "view")), ("run_id", "view")).select("run_id", "view", "accuracy", "macro_f1")
    lost = views.where("pred < 0").select(F.col("run_id").alias("source_run_id"), "view", "row_id")
    skipped = lost.join(F.broadcast(dependents), "source_run_id").groupBy("run_id", "view").agg(F.count("*").alias("upstream_failed"))
    out = per.join(s, ["run_id", "view"], "left").join(skipped, ["run_id", "view"], "left")
    ready = F.col("unattempted") == 0
    return out.select("run_id", "view", "n_rows", "failures", F.coalesce("upstream_failed", F.lit(0)).alias("upstream_failed"), *[F.when(ready, F.col(c)).alias(c) for c in ("accuracy", "macro_f1")])
