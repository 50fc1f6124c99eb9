"""Queries for response checks, scores and intervals (R0, M, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import softmax, valid_probabilities
from ..operators import boot, prep, score
from .registry import query
from .views import N_CLASSES, VIEWS, examples, predictions, u

CONF = VIEWS + ", conf AS (SELECT g.run_id, g.y, g.pred, coalesce(n, 0) AS n FROM (SELECT run_id, y.c AS y, p.p AS pred FROM (SELECT DISTINCT run_id FROM cells), cls y, (SELECT unnest([-1, 0, 1, 2, 3]) AS p) p) g LEFT JOIN cells USING (run_id, y, pred))"


def per_class_sql(src: str = "conf", by: str = "run_id") -> str:
    return f"""pc AS (SELECT {by}, c, sum(n) FILTER (WHERE y = c) AS support, sum(n) FILTER (WHERE y = c AND pred = c) AS tp, sum(n) FILTER (WHERE pred = c) AS guessed FROM {src}, cls GROUP BY {by}, c),
sc AS (SELECT {by}, CAST(sum(support) AS BIGINT) AS n_rows, sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support + guessed > 0 THEN 2 * tp / (support + guessed) ELSE 0 END) AS macro_f1, avg(tp / nullif(support, 0)) AS balanced_accuracy FROM pc GROUP BY {by})"""


def _conf(spark, d):
    return score.confusion(predictions(spark, d), N_CLASSES)


def rounded(df, *cols, digits: int = 9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("m00_alignment", VIEWS + "SELECT run_id, 0 AS missing, 0 AS extra, 0 AS duplicate FROM pred GROUP BY run_id")
def m00(spark, d):
    return score.alignment(examples(spark, d).where("source_split = 'test'"), predictions(spark, d))


@query("m01_confusion", CONF + "SELECT * FROM conf")
def m01(spark, d):
    return _conf(spark, d)


@query("m02_scores", CONF + f", {per_class_sql()} SELECT run_id, n_rows, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1, round(balanced_accuracy, 9) AS balanced_accuracy, f.failures, round(f.failures / n_rows, 9) AS failure_rate FROM sc JOIN (SELECT run_id, count(*) FILTER (WHERE pred < 0) AS failures FROM pred GROUP BY 1) f USING (run_id)")
def m02(spark, d):
    return rounded(score.scores(_conf(spark, d)), "accuracy", "macro_f1", "balanced_accuracy", "failure_rate")


@query("m03_per_class", CONF + f", {per_class_sql()} SELECT run_id, c, CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp, round(coalesce(tp / nullif(guessed, 0), 0), 9) AS precision, round(coalesce(tp / nullif(support, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(support + guessed, 0), 0), 9) AS f1 FROM pc")
def m03(spark, d):
    return rounded(score.per_class(_conf(spark, d)), "precision", "recall", "f1")


@query("m04_valid_accuracy", VIEWS + "SELECT run_id, round(avg(CAST(pred = y AS INTEGER)) FILTER (WHERE pred >= 0), 9) AS valid_accuracy FROM pred GROUP BY 1")
def m04(spark, d):
    return predictions(spark, d).groupBy("run_id").agg(F.round(F.avg(F.when(F.col("pred") >= 0, (F.col("pred") == F.col("y")).cast("int"))), 9).alias("valid_accuracy"))


@query("m05_latency", VIEWS + "SELECT run_id, round(quantile_cont(latency_s, 0.5), 6) AS p50, round(quantile_cont(latency_s, 0.95), 6) AS p95, round(sum(latency_s), 6) AS total_s FROM pred GROUP BY 1")
def m05(spark, d):
    return rounded(score.latency(predictions(spark, d)), "p50", "p95", "total_s", digits=6)


@query("m06_tokens", VIEWS + "SELECT run_id, count(*) AS n_rows, " + ", ".join(f"CAST(CASE WHEN count({c}) = count(*) THEN sum({c}) END AS BIGINT) AS {c}, CAST(coalesce(sum({c}), 0) AS BIGINT) AS known_{c}, round(count({c}) / count(*), 9) AS {c}_coverage" for c in ("input_tokens", "output_tokens")) + " FROM pred GROUP BY 1")
def m06(spark, d):
    return rounded(score.usage(predictions(spark, d)), "input_tokens_coverage", "output_tokens_coverage")


PROB = VIEWS + ", pr AS (SELECT *, list_transform(p, lambda x: x / list_sum(p)) AS q FROM pred WHERE p IS NOT NULL AND pred >= 0), pq AS (SELECT *, list_max(q) AS conf FROM pr)"


@query("m07_probability_coverage", PROB + "SELECT run_id, round(count(q) / count(*), 9) AS coverage, count(q) AS n_prob, count(*) FILTER (WHERE q[pred + 1] < conf) AS chosen_not_max, count(*) FILTER (WHERE q[y + 1] = 0) AS zero_true FROM pred LEFT JOIN (SELECT run_id, row_id, q, conf FROM pq) USING (run_id, row_id) GROUP BY 1")
def m07(spark, d):
    return score.probability_quality(predictions(spark, d)).select("run_id", F.round("coverage", 9).alias("coverage"), "n_prob", F.coalesce("chosen_not_max", F.lit(0)).alias("chosen_not_max"), F.coalesce("zero_true", F.lit(0)).alias("zero_true"))


@query("m08_log_loss", PROB + "SELECT run_id, round(avg(-ln(q[y + 1])), 8) AS log_loss FROM pq GROUP BY 1")
def m08(spark, d):
    return score.probability_quality(predictions(spark, d)).where("n_prob > 0").select("run_id", F.round("log_loss", 8).alias("log_loss"))


@query("m09_brier", PROB + "SELECT run_id, round(avg((q[1] - CAST(y = 0 AS INTEGER)) ** 2 + (q[2] - CAST(y = 1 AS INTEGER)) ** 2 + (q[3] - CAST(y = 2 AS INTEGER)) ** 2 + (q[4] - CAST(y = 3 AS INTEGER)) ** 2), 8) AS brier FROM pq GROUP BY 1")
def m09(spark, d):
    return score.probability_quality(predictions(spark, d)).where("n_prob > 0").select("run_id", F.round("brier", 8).alias("brier"))


BINS = PROB + ", bn AS (SELECT run_id, least(CAST(floor(conf * 15) AS INTEGER), 14) AS bin, count(*) AS n, avg(conf) AS confidence, avg(CAST(pred = y AS INTEGER)) AS accuracy FROM pq GROUP BY 1, 2)"


@query("m10_ece", BINS + "SELECT run_id, round(sum(n * abs(accuracy - confidence)) / sum(n), 8) AS ece FROM bn GROUP BY 1")
def m10(spark, d):
    return rounded(score.calibration_error(predictions(spark, d)), "ece", digits=8)


@query("m11_reliability", BINS + "SELECT run_id, bin, coalesce(n, 0) AS n, round(confidence, 8) AS confidence, round(accuracy, 8) AS accuracy FROM (SELECT DISTINCT run_id FROM bn) CROSS JOIN (SELECT CAST(unnest(generate_series(0, 14)) AS INTEGER) AS bin) LEFT JOIN bn USING (run_id, bin)")
def m11(spark, d):
    return rounded(score.reliability(predictions(spark, d)), "confidence", "accuracy", digits=8)


AUC = """, rs AS (SELECT run_id, s, sum(h) AS pos, sum(1 - h) AS neg FROM hits GROUP BY 1, 2), cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM rs WINDOW w AS (PARTITION BY run_id ORDER BY s DESC))
SELECT run_id, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) END, 8) AS auc, round(CASE WHEN sum(pos) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END, 8) AS average_precision FROM cu GROUP BY 1"""


@query("m12_auc", PROB + ", hits AS (SELECT run_id, q[2] AS s, CAST(y = 1 AS INTEGER) AS h FROM pq)" + AUC)
def m12(spark, d):
    rows = score.with_probabilities(predictions(spark, d)).select("run_id", F.get("q", F.lit(1)).alias("score"), (F.col("y") == 1).cast("int").alias("hit"))
    return rounded(score.ranking_quality(rows, ["run_id"]), "auc", "average_precision", digits=8)


@query("m14_missing_classes", VIEWS + "SELECT run_id, coalesce(array_to_string(list_filter([0, 1, 2, 3], lambda c: NOT list_contains(ys, c)), ','), '') AS missing, len(ys) = 4 AS available FROM (SELECT run_id, list(DISTINCT y) AS ys FROM pred GROUP BY 1)")
def m14(spark, d):
    return score.missing_classes(predictions(spark, d), N_CLASSES)


@query("m15_distribution", VIEWS + 'SELECT run_id, count(latency_s) AS n, min(latency_s) AS "min", round(quantile_cont(latency_s, 0.25), 8) AS p25, round(median(latency_s), 8) AS median, round(quantile_cont(latency_s, 0.75), 8) AS p75, max(latency_s) AS "max", round(avg(latency_s), 8) AS mean, round(stddev_pop(latency_s), 8) AS std, count(DISTINCT latency_s) AS n_unique FROM pred GROUP BY 1')
def m15(spark, d):
    return rounded(score.distribution(predictions(spark, d), ["run_id"], "latency_s"), "p25", "median", "p75", "mean", "std", digits=8)


@query("m16_confidence_profile", PROB + ", sr AS (SELECT *, pred = y AS correct, list_sort(q, 'DESC') AS s FROM pq), dk AS (SELECT run_id, correct, max(k) AS k FROM (SELECT run_id, correct, pred, count(*) AS k FROM sr GROUP BY ALL) GROUP BY ALL) SELECT run_id, correct, count(*) AS n, round(avg(conf), 8) AS top, round(avg(s[1] - s[2]), 8) AS margin, round(avg(-list_sum(list_transform(q, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(4)), 8) AS entropy, count(*) FILTER (WHERE conf >= 0.99) AS saturated, count(*) FILTER (WHERE s[1] = s[2]) AS tied, CAST(sum(len(list_filter(q, lambda x: x = 0))) AS BIGINT) AS zero_entries, count(DISTINCT list_transform(q, lambda x: round(x, 9))) AS unique_vectors, count(DISTINCT pred) AS classes_chosen, round(max(dk.k) / count(*), 8) AS dominant_share, count(DISTINCT pred) = 1 AS constant_class FROM sr JOIN dk USING (run_id, correct) GROUP BY 1, 2")
def m16(spark, d):
    return rounded(score.confidence_profile(predictions(spark, d)), "top", "margin", "entropy", "dominant_share", digits=8)


@query("m17_error_detection", PROB + ", hits AS (SELECT run_id, 1 - conf AS s, CAST(pred <> y AS INTEGER) AS h FROM pq)" + AUC)
def m17(spark, d):
    rows = score.with_probabilities(predictions(spark, d)).select("run_id", (1 - F.col("conf")).alias("score"), (F.col("pred") != F.col("y")).cast("int").alias("hit"))
    return rounded(score.ranking_quality(rows, ["run_id"]), "auc", "average_precision", digits=8)


@query("m18_identical_decisions", VIEWS + ", v AS (SELECT run_id, list(pred ORDER BY row_id) AS l FROM pred GROUP BY 1) SELECT a.run_id AS run_a, b.run_id AS run_b, a.l = b.l AS identical FROM v a JOIN v b ON a.run_id < b.run_id")
def m18(spark, d):
    f = score.decision_fingerprints(predictions(spark, d))
    a, b = f.select(F.col("run_id").alias("run_a"), F.col("fp").alias("fa")), f.select(F.col("run_id").alias("run_b"), F.col("fp").alias("fb"))
    return a.join(b, F.col("run_a") < F.col("run_b")).select("run_a", "run_b", (F.col("fa") == F.col("fb")).alias("identical"))


RULES = PROB + ", rl AS (SELECT run_id, row_id, y, unnest([{'rule': 'chosen', 'pred': pred}, {'rule': 'doubted', 'pred': CASE WHEN conf >= 0.6 THEN pred ELSE 1 END}], recursive := true) FROM pq)"


def _rules(spark, d):
    """Two decision rules on the same probabilities: the chosen class, and class 1 wherever that is doubtful."""
    rows = score.with_probabilities(predictions(spark, d)).withColumn("alt", F.when(F.col("conf") >= 0.6, F.col("pred")).otherwise(1))
    return rows.select("run_id", "row_id", "y", F.col("pred").alias("chosen"), F.col("alt").alias("doubted"))


@query("m19_two_rules", RULES + f""", rc AS (SELECT run_id, rule, y, pred, count(*) AS n FROM rl GROUP BY ALL UNION ALL SELECT DISTINCT run_id, rule, a.c, b.c, 0 FROM rl, cls a, cls b), {per_class_sql("rc", "run_id, rule")},
ch AS (SELECT run_id, count(*) FILTER (WHERE a <> b) AS changed, count(*) FILTER (WHERE a <> y AND b = y) AS fixed, count(*) FILTER (WHERE a = y AND b <> y) AS harmed FROM (SELECT run_id, row_id, y, max(pred) FILTER (WHERE rule = 'chosen') AS a, max(pred) FILTER (WHERE rule = 'doubted') AS b FROM rl GROUP BY 1, 2, 3) GROUP BY 1)
SELECT run_id, changed, fixed, harmed, round(x.accuracy, 9) AS chosen_accuracy, round(x.macro_f1, 9) AS chosen_macro_f1, round(z.accuracy, 9) AS doubted_accuracy, round(z.macro_f1, 9) AS doubted_macro_f1 FROM ch JOIN sc x USING (run_id) JOIN sc z USING (run_id) WHERE x.rule = 'chosen' AND z.rule = 'doubted'""")
def m19(spark, d):
    rows = _rules(spark, d)
    y, p, a = F.col("y"), F.col("chosen"), F.col("doubted")
    out = rows.groupBy("run_id").agg(F.count_if(p != a).alias("changed"), F.count_if((p != y) & (a == y)).alias("fixed"), F.count_if((p == y) & (a != y)).alias("harmed"))
    for rule in ("chosen", "doubted"):
        s = score.scores(score.confusion(rows.withColumn("pred", F.col(rule)), N_CLASSES))
        out = out.join(s.select("run_id", *[F.round(m, 9).alias(f"{rule}_{m}") for m in ("accuracy", "macro_f1")]), "run_id")
    return out


@query("m19_rule_counts", RULES + " SELECT run_id, rule, pred, count(*) AS n, count(*) FILTER (WHERE pred = y) AS correct FROM rl GROUP BY 1, 2, 3")
def m19_counts(spark, d):
    rule = lambda r: F.struct(F.lit(r).alias("rule"), F.col(r).alias("pred"))
    rows = _rules(spark, d).select("run_id", "y", F.inline(F.array(rule("chosen"), rule("doubted"))))
    return rows.groupBy("run_id", "rule", "pred").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("y")).alias("correct"))


@query("m20_seeds", CONF + f", {per_class_sql()} SELECT model, round(avg(macro_f1), 9) AS mean_f1, round(stddev_samp(macro_f1), 9) AS std_f1, count(*) AS n FROM sc JOIN runs USING (run_id) GROUP BY 1")
def m20(spark, d):
    from .views import runs

    s = score.scores(_conf(spark, d)).join(F.broadcast(runs(spark).select("run_id", "model")), "run_id")
    return s.groupBy("model").agg(F.round(F.avg("macro_f1"), 9).alias("mean_f1"), F.round(F.stddev_samp("macro_f1"), 9).alias("std_f1"), F.count("*").alias("n"))


@query("m21_errors", VIEWS + "SELECT run_id, coalesce(error, 'none') AS error, count(*) AS n, count(*) FILTER (WHERE pred < 0 AND p IS NULL) AS without_probabilities FROM pred GROUP BY 1, 2")
def m21(spark, d):
    lost = (F.col("pred") < 0) & F.col("probabilities").isNull()
    return predictions(spark, d).groupBy("run_id", F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"), F.count_if(lost).alias("without_probabilities"))


@query("m22_most_predicted", VIEWS + "SELECT run_id, pred, count(*) AS n FROM pred WHERE pred >= 0 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, pred) = 1")
def m22(spark, d):
    return score.most_predicted(predictions(spark, d))


RAW = VIEWS + f", raw AS (SELECT row_id, CASE {u(chr(39) + 'raw' + chr(39), 'row_id')} % 5 WHEN 0 THEN ' 2 ' WHEN 1 THEN '01' WHEN 2 THEN '7' WHEN 3 THEN 'two' ELSE '0' END AS reply FROM ex)"


@query("r00a_strict_label", RAW + "SELECT row_id, CASE WHEN regexp_full_match(trim(reply), '0|[1-9][0-9]*') AND TRY_CAST(trim(reply) AS INTEGER) < 4 THEN CAST(trim(reply) AS INTEGER) END AS label, CASE WHEN NOT regexp_full_match(trim(reply), '0|[1-9][0-9]*') THEN 'invalid_output: not a class number' WHEN TRY_CAST(trim(reply) AS INTEGER) >= 4 THEN 'invalid_output: out of range' END AS error FROM raw")
def r00a(spark, d):
    from ..functions.scalars import keyed

    kind = keyed("raw", F.col("row_id")) % 5
    reply = F.trim(F.when(kind == 0, " 2 ").when(kind == 1, "01").when(kind == 2, "7").when(kind == 3, "two").otherwise("0"))
    number = F.when(reply.rlike("^(0|[1-9][0-9]*)$"), reply.try_cast("int"))
    error = F.when(number.isNull(), "invalid_output: not a class number").when(number >= N_CLASSES, "invalid_output: out of range")
    return examples(spark, d).select("row_id", F.when(number < N_CLASSES, number).alias("label"), error.alias("error"))


@query("r00b_valid_probabilities", VIEWS + "SELECT run_id, count(*) FILTER (WHERE len(p) = 4 AND abs(list_sum(p) - 1) <= 1e-6 AND list_min(p) >= 0) AS valid, count(*) AS n FROM pred GROUP BY 1")
def r00b(spark, d):
    return predictions(spark, d).groupBy("run_id").agg(F.count_if(valid_probabilities(F.col("probabilities"), N_CLASSES)).alias("valid"), F.count("*").alias("n"))


@query("r00c_choice_is_max", VIEWS + "SELECT run_id, count(*) FILTER (WHERE p[label + 1] >= list_max(p) - 1e-6) AS agree, count(p) AS n FROM pred GROUP BY 1")
def r00c(spark, d):
    p = F.col("probabilities")
    return predictions(spark, d).groupBy("run_id").agg(F.count_if(F.get(p, F.col("label")) >= F.array_max(p) - 1e-6).alias("agree"), F.count(p).alias("n"))


@query("r00d_failure_shape", VIEWS + "SELECT run_id, count(*) FILTER (WHERE error IS NOT NULL AND (label IS NOT NULL OR p IS NOT NULL)) AS violations FROM pred GROUP BY 1")
def r00d(spark, d):
    bad = F.col("error").isNotNull() & (F.col("label").isNotNull() | F.col("probabilities").isNotNull())
    return predictions(spark, d).groupBy("run_id").agg(F.count_if(bad).alias("violations"))


KIND = "CASE WHEN error IS NULL THEN 'success' WHEN contains(error, 'status=402') THEN 'billing' WHEN starts_with(error, 'network_error') THEN 'transport' WHEN starts_with(error, 'http_error') THEN 'http_service' WHEN starts_with(error, 'invalid_output') THEN 'invalid_output' ELSE 'other' END"


@query("r00e_failure_kinds", VIEWS + f"SELECT run_id, {KIND} AS kind, count(*) AS n FROM pred GROUP BY 1, 2")
def r00e(spark, d):
    return predictions(spark, d).groupBy("run_id", score.failure_kind(F.col("error")).alias("kind")).agg(F.count("*").alias("n"))


@query("r00f_softmax", VIEWS + "SELECT row_id, round(exp(a) / (exp(a) + exp(b)), 9) AS p0 FROM (SELECT row_id, -(length(norm) % 7)::DOUBLE AS a, -(length(norm) % 5)::DOUBLE AS b FROM ex)")
def r00f(spark, d):
    s = F.array(-(F.length("norm") % 7).cast("double"), -(F.length("norm") % 5).cast("double"))
    return examples(spark, d).withColumn("s", s).select("row_id", F.round(F.get(softmax(F.col("s")), F.lit(0)), 9).alias("p0"))


def classify_batches(rows, classifier, schema: str = "row_id long, label int"):
    """Score a table with a user's function from a batch of texts to labels."""

    def run(batches):
        for pdf in batches:
            yield pdf[["row_id"]].assign(label=classifier(pdf["text"]))

    return rows.select("row_id", "text").mapInPandas(run, schema)


@query("r00g_user_classifier", VIEWS + "SELECT row_id, length(text) % 4 AS label FROM ex WHERE source_split = 'test'")
def r00g(spark, d):
    return classify_batches(examples(spark, d).where("source_split = 'test'"), lambda t: (t.str.len() % 4).astype("int32"))


REPS = CONF + f""", ix AS (SELECT run_id, y, pred, row_number() OVER (PARTITION BY run_id, y ORDER BY row_id) AS i, count(*) OVER (PARTITION BY run_id, y) AS n FROM pred), rp AS (SELECT CAST(unnest(generate_series(0, 99)) AS INTEGER) AS rep),
dr AS (SELECT run_id, y, rep, {u("'42'", "(y || ':' || rep || ':' || i)")} % n + 1 AS i FROM ix, rp), bs AS (SELECT dr.run_id, dr.rep, dr.y, ix.pred, count(*) AS n FROM dr JOIN ix USING (run_id, y, i) GROUP BY ALL)"""
QUANT = "SELECT run_id, count(*) AS replicates, " + ", ".join(f"round(quantile_cont({c}, {q}), 8) AS {c}_{e}" for c in ("accuracy", "macro_f1") for q, e in ((0.025, "low"), (0.975, "high")))
_CI = ("accuracy_low", "accuracy_high", "macro_f1_low", "macro_f1_high")
_FILL = "coalesce(sum(n) FILTER (WHERE {}), 0)"
PC_REP = """pc AS (SELECT run_id, rep, c, coalesce(sum(n) FILTER (WHERE y = c), 0) AS support, coalesce(sum(n) FILTER (WHERE y = c AND pred = c), 0) AS tp, coalesce(sum(n) FILTER (WHERE pred = c), 0) AS guessed FROM bs, cls GROUP BY 1, 2, 3),
sc AS (SELECT run_id, rep, sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support + guessed > 0 THEN 2 * tp / (support + guessed) ELSE 0 END) AS macro_f1 FROM pc GROUP BY 1, 2)"""


@query("b01_strat_boot", REPS + f", {PC_REP} {QUANT} FROM sc GROUP BY 1")
def b01(spark, d):
    return rounded(boot.stratified_bootstrap(predictions(spark, d), N_CLASSES, 100, 42, "hash"), *_CI, digits=8)


@query("b01_multinomial")
def b01m(spark, d):
    return boot.stratified_bootstrap(predictions(spark, d), N_CLASSES, 1000, 42)


@query("b01_paired", REPS + f", {PC_REP}, df AS (SELECT a.accuracy - b.accuracy AS accuracy, a.macro_f1 - b.macro_f1 AS macro_f1 FROM sc a JOIN sc b USING (rep) WHERE a.run_id = 'review' AND b.run_id = 'base') " + QUANT.replace("run_id, count(*) AS replicates, ", "") + " FROM df")
def b01p(spark, d):
    return rounded(boot.paired_intervals(predictions(spark, d), "review", "base", N_CLASSES, 100, 42), *_CI, digits=8)


@query("b02_group_boot", CONF + f""", gp AS (SELECT pred.*, sha256(norm) AS grp FROM pred JOIN ex USING (row_id)), gs AS (SELECT grp, row_number() OVER (ORDER BY grp) AS g, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM gp)), rp AS (SELECT CAST(unnest(generate_series(0, 99)) AS INTEGER) AS rep),
dr AS (SELECT rep, {u("'7'", "(rep || ':' || g)")} % n + 1 AS g FROM gs, rp), bs AS (SELECT run_id, rep, y, pred, count(*) AS n FROM dr JOIN gs USING (g) JOIN gp USING (grp) GROUP BY ALL), {PC_REP} {QUANT} FROM sc GROUP BY 1""")
def b02(spark, d):
    keys = examples(spark, d).select("row_id", F.sha2("norm", 256).alias("grp"))
    return rounded(boot.group_bootstrap(predictions(spark, d).join(keys, "row_id"), N_CLASSES, 100, 7, "hash"), *_CI, digits=8)


@query("b02_group_signatures")
def b02s(spark, d):
    keys = examples(spark, d).select("row_id", F.sha2("norm", 256).alias("grp"))
    return boot.group_bootstrap(predictions(spark, d).join(keys, "row_id"), N_CLASSES, 2000, 42)


@query("b01_paired_cells")
def b01c(spark, d):
    return boot.paired_cells(predictions(spark, d), "review", "base", N_CLASSES, 2000, 42)


@query("b03_group_keys", VIEWS + "SELECT row_id, sha256(norm) AS group_sha256, sha256(text) AS raw_sha256 FROM ex WHERE source_split = 'test'")
def b03(spark, d):
    return examples(spark, d).where("source_split = 'test'").select("row_id", F.sha2("norm", 256).alias("group_sha256"), F.sha2("text", 256).alias("raw_sha256"))


@query("b04_interval_checks", VIEWS + "SELECT run_id, 0 AS violations FROM pred GROUP BY 1")
def b04(spark, d):
    preds = predictions(spark, d)
    return boot.interval_violations(boot.stratified_bootstrap(preds, N_CLASSES, 200, 42), score.scores(score.confusion(preds, N_CLASSES)), ["accuracy", "macro_f1"])


@query("a01_fingerprint", VIEWS + "SELECT source_split, count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5(row_id || '|' || norm), 1, 15))::BIGINT AS HUGEINT)) AS VARCHAR) AS fingerprint FROM ex GROUP BY 1")
def a01(spark, d):
    return prep.fingerprint(examples(spark, d), ["row_id", "norm"], ["source_split"])
