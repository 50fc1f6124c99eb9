"""Queries on control arms, recovery summaries, chains of calls and exports (C7, C8, C13, C14, R7, R9, P2, P9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import keyed
from ..operators import control, prompts, resample, score
from ..sources.files import materialized
from .contrasts import BAND, BAND_SQL, SE_GROUPS, banded, text_groups
from .events import ATT, _views
from .prep import _PLAN
from .registry import query
from .scoring import CONF, per_class_sql, rounded
from .views import N_CLASSES, VIEWS, examples, predictions, runs, u

REPEATS = 16
ARM_PAIRS = [("actual", "no_proposal"), ("actual", "shuffled"), ("actual", "unsent")]
_OUTCOME = f"""ctl AS (SELECT row_id AS case_id, arm, is_repeat, y, model, CASE WHEN x >= 95 THEN -1 WHEN x < 60 + CASE arm WHEN 'actual' THEN 20 ELSE 0 END THEN y ELSE (y + 1) % 4 END AS pred,
 CASE WHEN x >= 95 AND r1 < 70 THEN y WHEN x >= 95 AND r2 < 70 THEN (y + 1) % 4 WHEN x >= 95 THEN -1 END AS fixed FROM (SELECT al.row_id, al.arm, al.is_repeat, ex.label AS y, {u("'ctl:' || arm || ':' || is_repeat", "al.row_id")} % 100 AS x,
 {u("'ra:' || arm", "al.row_id")} % 100 AS r1, {u("'rb:' || arm", "al.row_id")} % 100 AS r2, CASE WHEN {u("'ver:' || is_repeat", "al.row_id")} % 9 = 0 THEN 'm1-b' ELSE 'm1' END AS model FROM al JOIN ex USING (row_id)))"""


def _contrast_sql(pred: str) -> str:
    return f"""res AS (SELECT case_id, arm, y, {pred} AS pred FROM ctl WHERE is_repeat = 0), rc AS (SELECT arm, y, pred, count(*) AS n FROM res GROUP BY ALL),
apc AS (SELECT arm, c, coalesce(sum(n) FILTER (WHERE y = c), 0) AS support, coalesce(sum(n) FILTER (WHERE y = c AND pred = c), 0) AS tp, coalesce(sum(n) FILTER (WHERE pred = c), 0) AS guessed FROM rc, cls GROUP BY 1, 2),
asc_ AS (SELECT arm, sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support + guessed > 0 THEN 2 * tp / (support + guessed) ELSE 0 END) AS macro_f1, CASE WHEN min(support) > 0 THEN avg(tp / support) END AS balanced_accuracy FROM apc GROUP BY 1),
mv AS (SELECT p.arm AS a, q.arm AS b, count(*) FILTER (WHERE q.pred <> p.y AND p.pred = p.y) AS wrong_to_correct, count(*) FILTER (WHERE q.pred = p.y AND p.pred <> p.y) AS correct_to_wrong, count(*) FILTER (WHERE p.pred <> q.pred) AS changed FROM res p JOIN res q USING (case_id) GROUP BY 1, 2),
cl AS (SELECT 'actual' AS a, unnest(['no_proposal', 'shuffled', 'unsent']) AS b)
SELECT cl.a, cl.b, CASE WHEN z.arm IS NULL THEN 'pending' ELSE 'complete' END AS status, round(x.accuracy - z.accuracy, 9) AS delta_accuracy, round(x.macro_f1 - z.macro_f1, 9) AS delta_macro_f1, round(x.balanced_accuracy - z.balanced_accuracy, 9) AS delta_balanced_accuracy,
 wrong_to_correct, correct_to_wrong, changed, wrong_to_correct - correct_to_wrong AS net FROM cl JOIN asc_ x ON x.arm = cl.a LEFT JOIN asc_ z ON z.arm = cl.b LEFT JOIN mv ON mv.a = cl.a AND mv.b = cl.b"""


def _requests(spark, d):
    """Outcomes of the control plan's requests, and up to two more attempts of failed ones."""
    plan = prompts.control_plan(predictions(spark, d).where("run_id = 'base' and pred >= 0"), REPEATS)
    rows = plan.join(examples(spark, d).select("row_id", F.col("label").alias("y")), "row_id")
    row, arm, again = F.col("row_id"), F.col("arm"), F.col("is_repeat").cast("string")
    x = keyed(F.concat(F.lit("ctl:"), arm, F.lit(":"), again), row) % 100
    wrong = (F.col("y") + 1) % 4
    pred = F.when(x >= 95, -1).when(x < F.when(arm == "actual", 80).otherwise(60), F.col("y")).otherwise(wrong)
    model = F.when(keyed(F.concat(F.lit("ver:"), again), row) % 9 == 0, "m1-b").otherwise("m1")
    rows = materialized(rows.select(row.alias("case_id"), "arm", "is_repeat", "y", pred.cast("int").alias("pred"), model.alias("model")), "requests")
    lost = rows.where("pred < 0 and is_repeat = 0")
    ok = lambda t: keyed(F.concat(F.lit(f"{t}:"), F.col("arm")), F.col("case_id")) % 100 < 70
    one = lost.select("case_id", "arm", F.lit(1).alias("attempt_index"), F.when(ok("ra"), F.col("y")).otherwise(-1).alias("pred"))
    two = lost.where(~ok("ra")).select("case_id", "arm", F.lit(2).alias("attempt_index"), F.when(ok("rb"), wrong).otherwise(-1).alias("pred"))
    return rows, one.union(two)


def _expected(spark, rows):
    """All arms of the plan expect every case; one of the arms was never sent."""
    arms = spark.range(1).select(F.explode(F.array(*map(F.lit, ("actual", "no_proposal", "shuffled", "unsent")))).alias("arm"))
    return arms.crossJoin(rows.agg(F.count_distinct("case_id").alias("n_expected")))


DELTAS = [f"delta_{m}" for m in control.METRICS]


@query("c07_control_contrasts", VIEWS + f", {_PLAN}, {_OUTCOME}, {_contrast_sql('pred')}")
def c07(spark, d):
    rows = _requests(spark, d)[0].where("is_repeat = 0")
    return rounded(control.arm_contrasts(rows, _expected(spark, rows), ARM_PAIRS, N_CLASSES), *DELTAS)


@query("r09_control_overlay", VIEWS + f", {_PLAN}, {_OUTCOME}, {_contrast_sql('coalesce(fixed, pred)')}")
def r09(spark, d):
    rows, attempts = _requests(spark, d)
    rows = materialized(control.overlay(rows.where("is_repeat = 0"), attempts, ["case_id", "arm"]), "overlay")
    return rounded(control.arm_contrasts(rows, _expected(spark, rows), ARM_PAIRS, N_CLASSES), *DELTAS)


@query("c08_repeats", VIEWS + f""", {_PLAN}, {_OUTCOME}, ds AS (SELECT DISTINCT case_id, ['even', 'odd'][case_id % 2 + 1] AS dataset FROM ctl), ee AS (SELECT dataset, count(DISTINCT case_id) + CASE dataset WHEN 'odd' THEN 1 ELSE 0 END AS expected FROM ctl JOIN ds USING (case_id) WHERE is_repeat = 1 GROUP BY 1),
qq AS (SELECT ds.dataset, p.pred, q.pred AS again, p.model, q.model AS model_again FROM ctl p JOIN ctl q USING (case_id) JOIN ds USING (case_id) WHERE p.arm = 'actual' AND p.is_repeat = 0 AND q.is_repeat = 1),
cc AS (SELECT dataset, count(*) AS pairs, count(*) FILTER (pred >= 0 AND pred = again) AS agree, count(*) FILTER (pred >= 0 AND again >= 0 AND pred <> again) AS disagree, count(*) FILTER (pred < 0 AND again < 0) AS both_failed, count(*) FILTER (pred < 0 AND again >= 0) AS reference_failed,
 count(*) FILTER (pred >= 0 AND again < 0) AS repeat_failed, count(*) FILTER (model <> model_again) AS model_mismatch FROM qq GROUP BY 1)
SELECT dataset, expected, coalesce(pairs, 0) AS pairs, CASE WHEN pairs = expected THEN 'complete' ELSE 'pending' END AS status, """ + ", ".join(f"CASE WHEN pairs = expected THEN {c} END AS {c}" for c in ("agree", "disagree", "both_failed", "reference_failed", "repeat_failed", "model_mismatch")) + " FROM ee LEFT JOIN cc USING (dataset)")
def c08(spark, d):
    """Two halves of the cases stand for datasets; the second one waits for one more repeat."""
    rows = _requests(spark, d)[0].where("arm = 'actual'").withColumn("dataset", F.when(F.col("case_id") % 2 == 0, "even").otherwise("odd"))
    repeats = rows.where("is_repeat = 1")
    expected = repeats.groupBy("dataset").agg((F.count_distinct("case_id") + F.max((F.col("dataset") == "odd").cast("int"))).alias("expected"))
    return control.repeat_diagnostic(rows.where("is_repeat = 0"), repeats, expected)


@query("c07_intervals", VIEWS + f""", {_PLAN}, {_OUTCOME}, jr AS (SELECT q.arm AS contrast, sha256(norm) AS grp, p.y, p.pred AS pa, q.pred AS pb FROM ctl p JOIN ctl q USING (case_id) JOIN ex ON ex.row_id = case_id WHERE p.arm = 'actual' AND q.arm IN ('no_proposal', 'shuffled') AND p.is_repeat = 0 AND q.is_repeat = 0), {SE_GROUPS}
SELECT 'actual' AS a, b, CASE WHEN se IS NULL THEN 'pending' ELSE 'complete' END AS status, {BAND_SQL} FROM (SELECT unnest(['no_proposal', 'shuffled', 'unsent']) AS b) LEFT JOIN se ON contrast = b""")
def c07_intervals(spark, d):
    """Paired intervals of the control contrasts over groups of equal texts."""
    rows = _requests(spark, d)[0].where("is_repeat = 0")
    listed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(b).alias("contrast"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ARM_PAIRS])))
    preds = rows.select(F.col("arm").alias("run_id"), F.col("case_id").alias("row_id"), "y", "pred")
    out = listed.join(banded(resample.joint_rows(preds, listed, text_groups(spark, d)), True), "contrast", "left")
    return out.select("a", "b", F.when(F.col("se").isNull(), "pending").otherwise("complete").alias("status"), *BAND)


@query("r07_condition_summary", ATT + f""", lv AS (SELECT run_id, row_id, y, unnest(['original', 'recovered']) AS "view", unnest([original, recovered]) AS label FROM vw), lp AS (SELECT *, coalesce(label, -1) AS pred FROM lv),
lc AS (SELECT run_id, "view", y, pred, count(*) AS n FROM lp GROUP BY ALL), lk AS (SELECT run_id, "view", c, coalesce(sum(n) FILTER (WHERE y = c), 0) AS support, coalesce(sum(n) FILTER (WHERE y = c AND pred = c), 0) AS tp, coalesce(sum(n) FILTER (WHERE pred = c), 0) AS guessed FROM lc, cls GROUP BY 1, 2, 3),
ls AS (SELECT run_id, "view", sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support + guessed > 0 THEN 2 * tp / (support + guessed) ELSE 0 END) AS macro_f1 FROM lk GROUP BY 1, 2),
lf AS (SELECT run_id, "view", count(*) AS n_rows, count(*) FILTER (WHERE pred < 0) AS failures FROM lp GROUP BY 1, 2), up AS (SELECT r.run_id, lf."view", lf.failures AS upstream_failed FROM runs r JOIN lf ON lf.run_id = r.source_run_id)
SELECT lf.run_id, lf."view", n_rows, failures, coalesce(upstream_failed, 0) AS upstream_failed, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1 FROM lf JOIN ls USING (run_id, "view") LEFT JOIN up USING (run_id, "view")""")
def r07(spark, d):
    v = _views(spark, d)
    long = v.select("run_id", "row_id", "y", F.inline(F.array(*[F.struct(F.lit(c).alias("view"), F.coalesce(c, F.lit(-1)).alias("pred")) for c in ("original", "recovered")])))
    links = runs(spark).where("source_run_id is not null").select("run_id", "source_run_id")
    return rounded(control.condition_summary(long, links, N_CLASSES), "accuracy", "macro_f1")


PRICE = "coalesce(input_tokens, 0) * 300 + output_tokens * 1200"


def _cost():
    return F.coalesce("input_tokens", F.lit(0)) * 300 + F.col("output_tokens") * 1200


@query("c13_chain_costs", VIEWS + f""", c AS (SELECT run_id, sum({PRICE}) AS nano, count(*) FILTER (WHERE pred = y) AS correct, count(*) AS n FROM pred WHERE run_id IN ('base', 'direct', 'review') GROUP BY 1)
SELECT chain, CAST(sum(nano) AS BIGINT) AS cost_nano, max(n) AS n_rows, round(max(correct) FILTER (WHERE run_id = last) / max(n), 9) AS accuracy FROM (SELECT unnest(['source', 'direct', 'source+review', 'source+review']) AS chain, unnest(['base', 'direct', 'base', 'review']) AS run_id, unnest(['base', 'direct', 'review', 'review']) AS last) JOIN c USING (run_id) GROUP BY 1""")
def c13(spark, d):
    """Cost of a chain of calls (all its runs) against the accuracy of its last run, on the same rows."""
    per = predictions(spark, d).groupBy("run_id").agg(F.sum(_cost()).alias("nano"), F.count_if(F.col("pred") == F.col("y")).alias("correct"), F.count("*").alias("n"))
    chains = [("source", "base", "base"), ("direct", "direct", "direct"), ("source+review", "base", "review"), ("source+review", "review", "review")]
    listed = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("chain", "run_id", "last"), c, strict=True)]) for c in chains])))
    right = F.max(F.when(F.col("run_id") == F.col("last"), F.col("correct")))
    return listed.join(per, "run_id").groupBy("chain").agg(F.sum("nano").alias("cost_nano"), F.max("n").alias("n_rows"), F.round(right / F.max("n"), 9).alias("accuracy"))


@query("c14_before_after", VIEWS + """, c AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE pred = y) AS correct FROM pred GROUP BY 1), t AS (SELECT p.run_id AS b, q.run_id AS r, count(*) FILTER (WHERE p.pred <> p.y AND q.pred = q.y) AS fixed, count(*) FILTER (WHERE p.pred = p.y AND q.pred <> q.y) AS harmed FROM pred p JOIN pred q USING (row_id) GROUP BY 1, 2)
SELECT s.model, s.train_per_class, s.run_id AS base, r.run_id AS review, cs.correct AS base_correct, cr.correct AS review_correct, cd.correct AS direct_correct, fixed, harmed, cs.correct + fixed - harmed = cr.correct AS consistent
FROM runs s JOIN runs r ON r.source_run_id = s.run_id AND r.arm = 'review' LEFT JOIN runs x ON x.arm = 'direct' AND x.model = s.model AND x.train_per_class IS NOT DISTINCT FROM s.train_per_class
LEFT JOIN c cs ON cs.run_id = s.run_id LEFT JOIN c cr ON cr.run_id = r.run_id LEFT JOIN c cd ON cd.run_id = x.run_id LEFT JOIN t ON t.b = s.run_id AND t.r = r.run_id""")
def c14(spark, d):
    p, r = predictions(spark, d), runs(spark)
    per = p.groupBy("run_id").agg(F.count_if(F.col("pred") == F.col("y")).alias("correct"))
    side = lambda n: per.select(F.col("run_id").alias(n), F.col("correct").alias(f"{n}_correct"))
    base = r.where("arm = 'source'").select("model", "train_per_class", F.col("run_id").alias("base"))
    review = r.where("arm = 'review'").select(F.col("source_run_id").alias("base"), F.col("run_id").alias("review"))
    direct = r.where("arm = 'direct'").select(F.col("model").alias("m"), F.col("train_per_class").alias("k"), F.col("run_id").alias("direct"))
    rows = base.join(review, "base").join(direct, (F.col("m") == F.col("model")) & F.col("k").eqNullSafe(F.col("train_per_class")), "left")
    for n in ("base", "review", "direct"):
        rows = rows.join(side(n), n, "left")
    # each side has one run: the pairs come from the small table of conditions
    moves = p.select(F.col("run_id").alias("base"), "row_id", "y", F.col("pred").alias("x")).join(F.broadcast(review), "base")
    moves = moves.join(p.select(F.col("run_id").alias("review"), "row_id", F.col("pred").alias("z")), ["review", "row_id"])
    moves = moves.groupBy("base", "review").agg(F.count_if((F.col("x") != F.col("y")) & (F.col("z") == F.col("y"))).alias("fixed"), F.count_if((F.col("x") == F.col("y")) & (F.col("z") != F.col("y"))).alias("harmed"))
    same = F.col("base_correct") + F.col("fixed") - F.col("harmed") == F.col("review_correct")
    return rows.join(moves, ["base", "review"], "left").select("model", "train_per_class", "base", "review", "base_correct", "review_correct", "direct_correct", "fixed", "harmed", same.alias("consistent"))


@query("p02_dashboard_runs", CONF + f""", {per_class_sql()}, lt AS (SELECT run_id, count(*) AS n, round(avg(latency_s), 9) AS latency_s FROM pred GROUP BY 1) SELECT run_id, CASE WHEN model = 'm3' THEN 'hosted' ELSE 'local' END AS family, CASE arm WHEN 'review' THEN 'reviewed' WHEN 'direct' THEN 'direct' ELSE 'classifier' END AS method,
CASE WHEN train_per_class IS NULL THEN 'full training' WHEN train_per_class = 0 THEN 'zero-shot' ELSE train_per_class || ' per class' END AS budget, CASE WHEN model = 'm3' THEN 'sequential request' ELSE 'amortized batch' END AS latency_basis, lt.latency_s, round(accuracy, 9) AS accuracy FROM runs LEFT JOIN sc USING (run_id) LEFT JOIN lt USING (run_id)""")
def p02(spark, d):
    p = predictions(spark, d)
    s = score.scores(score.confusion(p, N_CLASSES)).select("run_id", F.round("accuracy", 9).alias("accuracy"))
    time = p.groupBy("run_id").agg(F.round(F.avg("latency_s"), 9).alias("latency_s"))
    k, hosted = F.col("train_per_class"), F.col("model") == "m3"
    budget = F.when(k.isNull(), "full training").when(k == 0, "zero-shot").otherwise(F.concat(k.cast("string"), F.lit(" per class")))
    method = F.when(F.col("arm") == "review", "reviewed").when(F.col("arm") == "direct", "direct").otherwise("classifier")
    out = runs(spark).join(s, "run_id", "left").join(time, "run_id", "left")
    return out.select("run_id", F.when(hosted, "hosted").otherwise("local").alias("family"), method.alias("method"), budget.alias("budget"), F.when(hosted, "sequential request").otherwise("amortized batch").alias("latency_basis"), "latency_s", "accuracy")


@query("p09_review_export", CONF + f""", {per_class_sql()}, sp AS (SELECT r.run_id, count(*) FILTER (WHERE a.pred = b.pred AND a.pred >= 0) AS same_proposal FROM runs r JOIN pred a ON a.run_id = r.run_id JOIN pred b ON b.run_id = r.source_run_id AND b.row_id = a.row_id GROUP BY 1)
SELECT r.run_id, r.status, round(x.accuracy, 9) AS accuracy, round(s.accuracy, 9) AS source_accuracy, sp.same_proposal, CAST(sum(sp.same_proposal) OVER () AS BIGINT) AS pooled_same FROM runs r LEFT JOIN sc x ON x.run_id = r.run_id LEFT JOIN sc s ON s.run_id = r.source_run_id AND x.run_id IS NOT NULL LEFT JOIN sp ON sp.run_id = r.run_id WHERE r.arm = 'review'""")
def p09(spark, d):
    """Review conditions for export: incomplete ones stay, without any figure."""
    p = predictions(spark, d)
    s = score.scores(score.confusion(p, N_CLASSES)).select("run_id", F.round("accuracy", 9).alias("accuracy"))
    r = runs(spark).where("arm = 'review'").select("run_id", "source_run_id", "status")
    a = p.select("run_id", "source_run_id", "row_id", "pred")
    b = p.select(F.col("run_id").alias("source_run_id"), "row_id", F.col("pred").alias("proposed"))
    same = a.join(b, ["source_run_id", "row_id"]).groupBy("run_id").agg(F.count_if((F.col("pred") == F.col("proposed")) & (F.col("pred") >= 0)).alias("same_proposal"))
    out = r.join(s, "run_id", "left").join(s.select(F.col("run_id").alias("source_run_id"), F.col("accuracy").alias("x")), "source_run_id", "left").join(same, "run_id", "left")
    done = F.col("accuracy").isNotNull()
    out = out.select("run_id", "status", "accuracy", F.when(done, F.col("x")).alias("source_accuracy"), F.when(done, F.col("same_proposal")).alias("same_proposal"))
    return out.crossJoin(out.agg(F.sum("same_proposal").alias("pooled_same")))
