"""Failure-aware scores. Inputs are prediction tables (run_id, row_id, y, pred, ...) with pred = -1 for
failures, which stay in every denominator. Everything is a grouped aggregation; scores come from the
confusion cells, a table of runs x classes, not from rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FAILED, ratio, total
from ..sources.shared import materialized
from .rank import balanced, quantiles, running_total


def alignment(test: DataFrame, preds: DataFrame) -> DataFrame:
    """Per run: missing, extra and duplicate ids against ``test(row_id)``. What a run misses follows from the ids that
    it has, so no table of runs x test rows is formed."""
    ids = test.select("row_id").distinct()
    per = preds.groupBy("run_id", "row_id").agg(F.count("*").alias("n")).join(ids.withColumn("expected", F.lit(True)), "row_id", "left")
    have = per.groupBy("run_id").agg(F.count("expected").alias("found"), F.count_if(F.col("expected").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("duplicate"))
    total = ids.agg(F.count("*").alias("total"))  # one row
    return have.crossJoin(F.broadcast(total)).select("run_id", (F.col("total") - F.col("found")).alias("missing"), "extra", "duplicate")


def confusion(preds: DataFrame, n_classes: int, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(by, y, pred, n) over all classes and the failure column, zero-filled."""
    cells = preds.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))
    span = lambda a, name: F.explode(F.sequence(F.lit(a), F.lit(n_classes - 1))).alias(name)
    grid = cells.select(*by).distinct().select(*by, span(0, "y")).select("*", span(FAILED, "pred"))
    return grid.join(cells, [*by, "y", "pred"], "left").fillna(0, ["n"])


def per_class(cells: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """precision, recall, f1 (0 where undefined) and support per class from confusion cells."""
    true = cells.groupBy(*by, F.col("y").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    guess = cells.groupBy(*by, F.col("pred").alias("c")).agg(F.sum("n").alias("guessed"))
    out = true.join(guess, [*by, "c"], "left").fillna(0, ["guessed"])
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return out.select(*by, "c", "support", "tp", zero(F.col("tp"), F.col("guessed")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2 * F.col("tp"), F.col("support") + F.col("guessed")).alias("f1"))


def scores(cells: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """accuracy, macro_f1 (over all classes), balanced_accuracy (classes present), failures, rate."""
    classes = per_class(cells, by).groupBy(*by).agg(F.sum("support").alias("n_rows"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    failed = cells.groupBy(*by).agg(F.sum(F.when(F.col("pred") == FAILED, F.col("n")).otherwise(0)).alias("failures"))
    return classes.join(failed, list(by)).withColumn("failure_rate", F.col("failures") / F.col("n_rows"))


def usage(preds: DataFrame) -> DataFrame:
    """Token totals: null unless complete, with the known total and the coverage."""
    cols = [F.count("*").alias("n_rows")]
    for c in ("input_tokens", "output_tokens"):
        cols += [F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c), F.coalesce(F.sum(c), F.lit(0)).alias(f"known_{c}"), (F.count(c) / F.count("*")).alias(f"{c}_coverage")]
    return preds.groupBy("run_id").agg(*cols)


def latency(preds: DataFrame) -> DataFrame:
    rows = preds.where("latency_s >= 0")
    return quantiles(rows, ["run_id"], "latency_s", {"p50": 0.5, "p95": 0.95}).join(rows.groupBy("run_id").agg(F.sum("latency_s").alias("total_s")), "run_id")


def with_probabilities(preds: DataFrame) -> DataFrame:
    """Valid rows that have a distribution, renormalized (q), with its top and the truth's share."""
    q = F.transform("probabilities", lambda x: x / total(F.col("probabilities")))
    rows = preds.where("probabilities is not null and pred >= 0").withColumn("q", q)
    return rows.withColumns({"conf": F.array_max("q"), "p_true": F.get("q", F.col("y"))})


def probability_quality(preds: DataFrame) -> DataFrame:
    """coverage, log loss (clipped), multiclass Brier sum, and how many rows are odd."""
    n = preds.groupBy("run_id").agg(F.count("*").alias("n"))
    clip = F.transform("q", lambda x: F.least(F.greatest(x, F.lit(1e-15)), F.lit(1 - 1e-15)))
    rows = with_probabilities(preds).withColumn("r", clip)
    loss = -F.ln(F.get("r", F.col("y")) / total(F.col("r")))
    brier = total(F.transform("q", lambda x, k: F.pow(x - (k == F.col("y")).cast("double"), 2)))
    per = rows.groupBy("run_id").agg(F.count("*").alias("n_prob"), F.avg(loss).alias("log_loss"), F.avg(brier).alias("brier"), F.count_if(F.get("q", F.col("pred")) < F.col("conf")).alias("chosen_not_max"), F.count_if(F.col("p_true") == 0).alias("zero_true"))
    return n.join(per, "run_id", "left").select("run_id", (F.coalesce("n_prob", F.lit(0)) / F.col("n")).alias("coverage"), F.coalesce("n_prob", F.lit(0)).alias("n_prob"), "log_loss", "brier", "chosen_not_max", "zero_true")


def reliability(preds: DataFrame, bins: int = 15) -> DataFrame:
    """(run_id, bin, n, confidence, accuracy) for all bins; null means for empty ones."""
    rows = with_probabilities(preds).select("run_id", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int").alias("bin"), "conf", (F.col("pred") == F.col("y")).cast("int").alias("ok"))
    per = rows.groupBy("run_id", "bin").agg(F.count("*").alias("n"), F.avg("conf").alias("confidence"), F.avg("ok").alias("accuracy"))
    grid = rows.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(per, ["run_id", "bin"], "left").fillna(0, ["n"])


def calibration_error(preds: DataFrame, bins: int = 15) -> DataFrame:
    r = reliability(preds, bins).where("n > 0")
    return r.groupBy("run_id").agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def ranking_quality(rows: DataFrame, by: list[str], score: str = "score", hit: str = "hit") -> DataFrame:
    """ROC-AUC (ties at mid-rank) and average precision per group from counts per distinct score."""
    per = rows.groupBy(*by, score).agg(F.sum(hit).alias("pos"), F.sum(1 - F.col(hit)).alias("neg"))
    per, bucket = balanced(materialized(per, "scores"), score)
    bucket = -bucket
    per = running_total(per, by, bucket, [F.desc(score)], "pos", "tp0")
    per = running_total(per, by, bucket, [F.desc(score)], "neg", "fp0")
    tp, fp = F.col("tp0") + F.col("pos"), F.col("fp0") + F.col("neg")
    sums = per.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(F.col("neg") * (F.col("tp0") + F.col("pos") / 2)).alias("area"), F.sum(F.col("pos") * tp / (tp + fp)).alias("ap"))
    return sums.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("area") / (F.col("P") * F.col("N"))).alias("auc"), F.when(F.col("P") > 0, F.col("ap") / F.col("P")).alias("average_precision"))


def missing_classes(preds: DataFrame, n_classes: int) -> DataFrame:
    have = F.array_sort(F.collect_set("y"))
    lost = F.array_except(F.sequence(F.lit(0), F.lit(n_classes - 1)), have)
    return preds.groupBy("run_id").agg(F.array_join(lost, ",").alias("missing"), (F.size(lost) == 0).alias("available"))


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    q = quantiles(rows, by, value, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    per = rows.groupBy(*by, value).agg(F.count(value).alias("__n"))
    moments = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    unique = per.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n_unique"))
    return moments.join(q, by).join(unique, by).select(*by, "n", "min", "p25", "median", "p75", "max", "mean", "std", "n_unique")


def confidence_profile(preds: DataFrame) -> DataFrame:
    """Per run and correctness: n, mean top, mean margin, mean normalized entropy, counts of saturated, tied
    and zero entries, distinct vectors, classes chosen, and the share of the most chosen class."""
    desc = F.sort_array("q", asc=False)
    rows = with_probabilities(preds).withColumn("d", desc)
    entropy = -total(F.transform("q", lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0))) / F.ln(F.size("q"))
    vector = F.md5(F.concat_ws(",", F.transform("q", lambda x: F.round(x, 9).cast("string"))))
    rows = rows.select("run_id", (F.col("pred") == F.col("y")).alias("correct"), "pred", "conf", (F.get("d", F.lit(0)) - F.get("d", F.lit(1))).alias("margin"), entropy.alias("entropy"), F.size(F.filter("q", lambda x: x == 0)).alias("zeros"), vector.alias("vector"))
    per = rows.groupBy("run_id", "correct").agg(F.count("*").alias("n"), F.avg("conf").alias("top"), F.avg("margin").alias("margin"), F.avg("entropy").alias("entropy"), F.count_if(F.col("conf") >= 0.99).alias("saturated"), F.count_if(F.col("margin") == 0).alias("tied"), F.sum("zeros").alias("zero_entries"))
    vectors = rows.select("run_id", "correct", "vector").distinct().groupBy("run_id", "correct").agg(F.count("*").alias("unique_vectors"))
    chosen = rows.groupBy("run_id", "correct", "pred").agg(F.count("*").alias("k")).groupBy("run_id", "correct").agg(F.count("*").alias("classes_chosen"), F.max("k").alias("most"))
    out = per.join(vectors, ["run_id", "correct"]).join(chosen, ["run_id", "correct"])
    return out.withColumns({"dominant_share": F.col("most") / F.col("n"), "constant_class": F.col("classes_chosen") == 1}).drop("most")


def decision_fingerprints(preds: DataFrame) -> DataFrame:
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", "row_id", "pred")), 1, 15), 16, 10).cast("decimal(38,0)")
    return preds.groupBy("run_id").agg(F.sum(digest).alias("fp"), F.count("*").alias("n"))


def fingerprints(preds: DataFrame, named: dict[str, list[str]]) -> DataFrame:
    """Per run, an order-insensitive fingerprint of each named list of columns, and the number of rows."""

    def digest(columns: list[str]) -> Column:
        text = F.to_json(F.struct("row_id", *columns))
        return F.sum(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)"))

    return preds.groupBy("run_id").agg(F.count("*").alias("n_rows"), *[digest(c).alias(k) for k, c in named.items()])


def most_predicted(preds: DataFrame) -> DataFrame:
    per = preds.where("pred >= 0").groupBy("run_id", "pred").agg(F.count("*").alias("n"))
    return per.groupBy("run_id").agg(F.min_by("pred", F.struct(-F.col("n"), "pred")).alias("pred"), F.max("n").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def failure_kind(error: Column) -> Column:
    starts = error.startswith
    return (
        F.when(error.isNull(), "success")
        .when(starts("not_attempted"), "not_attempted")
        .when(starts("source_proposal_failed"), "upstream_not_called")
        .when(error.contains("status=402"), "billing")
        .when(starts("network_error"), "transport")
        .when(starts("http_error"), "http_service")
        .when(starts("invalid_output"), "invalid_output")
        .otherwise("other")
    )
