"""Queries for contrasts and review value (C, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import keyed
from ..operators import contrast, resample, score
from ..sources.files import materialized
from .registry import query
from .scoring import CONF, per_class_sql, rounded
from .views import N_CLASSES, VIEWS, examples, predictions, runs, table, u

PAIRS = [("base", "review"), ("base", "direct"), ("direct", "review")]
PAIR = VIEWS + ", pr AS (SELECT b.run_id AS before, a.run_id AS after, b.row_id, b.y, b.pred AS a, a.pred AS b FROM pred b JOIN pred a USING (row_id) WHERE (b.run_id, a.run_id) IN (('base', 'review'), ('base', 'direct'), ('direct', 'review')))"
TRANS = "before, after, count(*) AS n_rows, " + ", ".join(
    f"count(*) FILTER (WHERE {c}) AS {n}"
    for n, c in {"wrong_to_correct": "a <> y AND b = y", "correct_to_wrong": "a = y AND b <> y", "harmed_by_label": "a = y AND b <> y AND b >= 0", "harmed_by_failure": "a = y AND b < 0", "both_correct": "a = y AND b = y", "both_wrong": "a <> y AND b <> y", "changed": "a <> b", "source_failures": "a < 0", "review_failures": "a >= 0 AND b < 0"}.items()
) + ", count(*) FILTER (WHERE a <> y AND b = y) - count(*) FILTER (WHERE a = y AND b <> y) AS net"


@query("c01_coded", VIEWS + "SELECT run_id, row_id, pred FROM pred")
def c01(spark, d):
    return predictions(spark, d).select("run_id", "row_id", "pred")


@query("c02_transitions", PAIR + f"SELECT {TRANS} FROM pr GROUP BY 1, 2")
def c02(spark, d):
    return contrast.transitions(predictions(spark, d), PAIRS)


@query("c03_transition_identities", PAIR + "SELECT before, after, 0 AS violations FROM pr GROUP BY 1, 2")
def c03(spark, d):
    return contrast.transition_violations(contrast.transitions(predictions(spark, d), PAIRS))


@query("c04_compare_runs", CONF + f""", {per_class_sql()}, w AS (SELECT run_id, list((row_id, y) ORDER BY row_id) AS held FROM pred GROUP BY 1), k AS (SELECT runs.run_id, train_per_class, held, n_rows, accuracy, macro_f1 FROM runs JOIN w USING (run_id) JOIN sc USING (run_id) WHERE status = 'complete')
SELECT a.run_id AS run_a, b.run_id AS run_b, a.n_rows AS n_a, b.n_rows AS n_b, CASE WHEN a.held <> b.held THEN 'misaligned' WHEN a.train_per_class IS DISTINCT FROM b.train_per_class THEN 'unequal_training' ELSE 'eligible' END AS status,
round(CASE WHEN a.held = b.held THEN a.accuracy - b.accuracy END, 9) AS delta_accuracy, round(CASE WHEN a.held = b.held THEN a.macro_f1 - b.macro_f1 END, 9) AS delta_macro_f1 FROM k a JOIN k b ON a.run_id < b.run_id""")
def c04(spark, d):
    """Deltas of every pair of runs on the same rows and truths; the status says whether training was equal."""
    p = predictions(spark, d)
    r = runs(spark).where("status = 'complete'").join(score.fingerprints(p, {"fp": ["y"]}), "run_id").join(score.scores(score.confusion(p, N_CLASSES)).drop("n_rows"), "run_id").select("run_id", "train_per_class", "fp", "n_rows", "accuracy", "macro_f1")
    a, b = r.select(*[F.col(c).alias(c + "_a") for c in r.columns]), r.select(*[F.col(c).alias(c + "_b") for c in r.columns])
    same = (F.col("fp_a") == F.col("fp_b")) & (F.col("n_rows_a") == F.col("n_rows_b"))
    state = F.when(~same, "misaligned").when(~F.col("train_per_class_a").eqNullSafe(F.col("train_per_class_b")), "unequal_training").otherwise("eligible")
    delta = lambda c: F.round(F.when(same, F.col(f"{c}_a") - F.col(f"{c}_b")), 9).alias(f"delta_{c}")
    return a.join(b, F.col("run_id_a") < F.col("run_id_b")).select(F.col("run_id_a").alias("run_a"), F.col("run_id_b").alias("run_b"), F.col("n_rows_a").alias("n_a"), F.col("n_rows_b").alias("n_b"), state.alias("status"), delta("accuracy"), delta("macro_f1"))


_D = "CAST(pa = y AS INTEGER) - coalesce(CAST(pb = y AS INTEGER), 0)"
#: Closed-form standard errors of the two bootstraps from joint rows jr(contrast, y, pa, pb[, grp]).
SE_ROWS = f"st AS (SELECT contrast, y, count(*) AS n, sum({_D}) AS d, sum(({_D}) * ({_D})) AS dd FROM jr GROUP BY 1, 2), se AS (SELECT contrast, sqrt(sum(dd - d * d / n)) / sum(n) AS se FROM st GROUP BY 1)"
SE_GROUPS = f"gt AS (SELECT contrast, grp, sum({_D}) AS d, count(*) AS n FROM jr GROUP BY 1, 2), gs AS (SELECT contrast, sum(d) / sum(n) AS r FROM gt GROUP BY 1), se AS (SELECT contrast, sqrt(sum((d - r * n) * (d - r * n))) / sum(n) AS se FROM gt JOIN gs USING (contrast) GROUP BY 1)"
BAND = ("se", "low_in_band", "high_in_band", "f1_in_order")
BAND_SQL = "round(se, 8) AS se, CASE WHEN se IS NOT NULL THEN true END AS low_in_band, CASE WHEN se IS NOT NULL THEN true END AS high_in_band, CASE WHEN se IS NOT NULL THEN true END AS f1_in_order"


def banded(rows, grouped):
    """Intervals of all contrasts in ``rows``, held against the closed form."""
    rows = materialized(rows, "joint")
    found = resample.in_band(resample.contrast_intervals(rows, N_CLASSES, grouped=grouped), resample.standard_error(rows, grouped))
    return found.select("contrast", F.round("se", 8).alias("se"), *BAND[1:])


def text_groups(spark, d):
    return examples(spark, d).select("row_id", F.sha2("norm", 256).alias("grp"))


@query("c04_intervals", CONF + f""", w AS (SELECT run_id, list((row_id, y) ORDER BY row_id) AS held FROM pred GROUP BY 1), k AS (SELECT run_id, train_per_class, held FROM runs JOIN w USING (run_id) WHERE status = 'complete'),
pq AS (SELECT a.run_id AS run_a, b.run_id AS run_b, CASE WHEN a.held <> b.held THEN 'misaligned' WHEN a.train_per_class IS DISTINCT FROM b.train_per_class THEN 'unequal_training' ELSE 'eligible' END AS status FROM k a JOIN k b ON a.run_id < b.run_id),
jr AS (SELECT run_a || ':' || run_b AS contrast, x.y, x.pred AS pa, z.pred AS pb FROM pq JOIN pred x ON x.run_id = run_a JOIN pred z ON z.run_id = run_b AND z.row_id = x.row_id WHERE status = 'eligible'), {SE_ROWS}
SELECT run_a, run_b, status, {BAND_SQL} FROM pq LEFT JOIN se ON se.contrast = run_a || ':' || run_b""")
def c04_intervals(spark, d):
    """All eligible pairs of runs at once: paired, within classes; other pairs have no interval."""
    pairs = materialized(c04(spark, d).select("run_a", "run_b", "status", F.concat_ws(":", "run_a", "run_b").alias("contrast")), "pairs")
    listed = pairs.where("status = 'eligible'").select("contrast", F.col("run_a").alias("a"), F.col("run_b").alias("b"))
    found = banded(resample.joint_rows(predictions(spark, d), listed), False)
    return pairs.join(found, "contrast", "left").drop("contrast")


CONTRASTS = """, cl AS (SELECT 'review_minus_source' AS kind, r.run_id AS a, r.source_run_id AS b FROM runs r WHERE r.arm = 'review' UNION ALL SELECT 'review_minus_direct', r.run_id, x.run_id FROM runs r JOIN runs x ON x.arm = 'direct' AND x.model = r.model WHERE r.arm = 'review'
UNION ALL SELECT 'few_minus_zero', f.run_id, z.run_id FROM runs f JOIN runs z ON z.train_per_class = 0 AND z.model = f.model AND z.arm = f.arm WHERE f.train_per_class > 0)"""


def contrast_list(r):
    x = r.select(F.col("run_id").alias("b"), F.col("arm").alias("arm_b"), F.col("model").alias("model_b"), F.col("train_per_class").alias("k_b"))
    rev = r.where("arm = 'review'")
    a = rev.select(F.lit("review_minus_source").alias("kind"), F.col("run_id").alias("a"), F.col("source_run_id").alias("b"))
    b = rev.join(x, (F.col("arm_b") == "direct") & (F.col("model_b") == F.col("model"))).select(F.lit("review_minus_direct").alias("kind"), F.col("run_id").alias("a"), "b")
    c = r.where("train_per_class > 0").join(x, (F.col("k_b") == 0) & (F.col("model_b") == F.col("model")) & (F.col("arm_b") == F.col("arm"))).select(F.lit("few_minus_zero").alias("kind"), F.col("run_id").alias("a"), "b")
    return a.union(b).union(c)


@query("c05_contrast_list", VIEWS + CONTRASTS + " SELECT kind, a, b, (SELECT count(DISTINCT row_id) FROM pred WHERE run_id = a) AS n_rows FROM cl")
def c05(spark, d):
    n = predictions(spark, d).groupBy(F.col("run_id").alias("a")).agg(F.count_distinct("row_id").alias("n_rows"))
    return contrast_list(runs(spark)).join(n, "a", "left").select("kind", "a", "b", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("c06_contrasts", CONF + f""", {per_class_sql()} {CONTRASTS}, tc AS (SELECT kind, cl.a, cl.b, count(*) FILTER (WHERE x.pred <> x.y AND z.pred = z.y) AS wrong_to_correct, count(*) FILTER (WHERE x.pred = x.y AND z.pred <> z.y) AS correct_to_wrong FROM cl JOIN pred x ON x.run_id = cl.b JOIN pred z ON z.run_id = cl.a AND z.row_id = x.row_id GROUP BY 1, 2, 3)
SELECT cl.kind, cl.a, cl.b, CASE WHEN x.accuracy IS NULL OR z.accuracy IS NULL THEN 'pending' ELSE 'complete' END AS status, round(x.accuracy - z.accuracy, 9) AS delta_accuracy, round(x.macro_f1 - z.macro_f1, 9) AS delta_macro_f1, round(x.balanced_accuracy - z.balanced_accuracy, 9) AS delta_balanced, wrong_to_correct, correct_to_wrong, wrong_to_correct - correct_to_wrong AS net
FROM cl LEFT JOIN sc x ON x.run_id = cl.a LEFT JOIN sc z ON z.run_id = cl.b LEFT JOIN tc ON tc.kind = cl.kind AND tc.a = cl.a AND tc.b = cl.b""")
def c06(spark, d):
    p = predictions(spark, d)
    s = score.scores(score.confusion(p, N_CLASSES)).select("run_id", "accuracy", "macro_f1", "balanced_accuracy")
    x, z = s.select(*[F.col(c).alias("x_" + c) for c in s.columns]), s.select(*[F.col(c).alias("z_" + c) for c in s.columns])
    listed = contrast_list(runs(spark))
    moved = contrast.transitions(p, listed.select(F.col("b").alias("before"), F.col("a").alias("after"))).select(F.col("before").alias("b"), F.col("after").alias("a"), "wrong_to_correct", "correct_to_wrong", "net")
    out = listed.join(x, F.col("a") == F.col("x_run_id"), "left").join(z, F.col("b") == F.col("z_run_id"), "left").join(moved, ["a", "b"], "left")
    state = F.when(F.col("x_accuracy").isNull() | F.col("z_accuracy").isNull(), "pending").otherwise("complete")
    deltas = [F.round(F.col(f"x_{c}") - F.col(f"z_{c}"), 9).alias(n) for c, n in (("accuracy", "delta_accuracy"), ("macro_f1", "delta_macro_f1"), ("balanced_accuracy", "delta_balanced"))]
    return out.select("kind", "a", "b", state.alias("status"), *deltas, "wrong_to_correct", "correct_to_wrong", "net")


@query("c06_intervals", CONF + f"""{CONTRASTS}, jr AS (SELECT concat_ws(':', kind, cl.a, cl.b) AS contrast, sha256(norm) AS grp, x.y, x.pred AS pa, z.pred AS pb FROM cl JOIN pred x ON x.run_id = cl.a JOIN pred z ON z.run_id = cl.b AND z.row_id = x.row_id JOIN ex ON ex.row_id = x.row_id), {SE_GROUPS}
SELECT kind, a, b, CASE WHEN se IS NULL THEN 'pending' ELSE 'complete' END AS status, {BAND_SQL} FROM cl LEFT JOIN se ON contrast = concat_ws(':', kind, a, b)""")
def c06_intervals(spark, d):
    """Every contrast's paired interval over whole groups of equal texts; pending ones have none."""
    listed = contrast_list(runs(spark)).withColumn("contrast", F.concat_ws(":", "kind", "a", "b"))
    found = banded(resample.joint_rows(predictions(spark, d), listed.where("b is not null"), text_groups(spark, d)), True)
    out = listed.join(found, "contrast", "left")
    return out.select("kind", "a", "b", F.when(F.col("se").isNull(), "pending").otherwise("complete").alias("status"), *BAND)


@query("p01_intervals", VIEWS + f""", jr AS (SELECT run_id AS contrast, y, pred AS pa, CAST(NULL AS INTEGER) AS pb FROM pred), {SE_ROWS} SELECT run_id, status, {BAND_SQL} FROM runs LEFT JOIN se ON contrast = run_id""")
def p01_intervals(spark, d):
    """The run table's intervals: every run's own scores, within classes; runs without predictions have none."""
    listed = runs(spark).select(F.col("run_id").alias("contrast"), F.col("run_id").alias("a"), F.lit(None).cast("string").alias("b"))
    found = banded(resample.joint_rows(predictions(spark, d), listed), False)
    return runs(spark).select("run_id", "status").join(found, F.col("run_id") == F.col("contrast"), "left").drop("contrast")


@query("b02_paired", VIEWS + f""", jr AS (SELECT 'review-base' AS contrast, sha256(norm) AS grp, x.y, x.pred AS pa, z.pred AS pb FROM pred x JOIN pred z USING (row_id) JOIN ex USING (row_id) WHERE x.run_id = 'review' AND z.run_id = 'base'
 UNION ALL SELECT 'base', sha256(norm), pred.y, pred, NULL FROM pred JOIN ex USING (row_id) WHERE run_id = 'base'), {SE_GROUPS}, pt AS (SELECT contrast, count(*) AS n_rows, count(DISTINCT grp) AS n_groups, sum({_D}) / count(*) AS accuracy FROM jr GROUP BY 1)
SELECT contrast, n_rows, n_groups, round(accuracy, 9) AS accuracy, 2000::BIGINT AS replicates, {BAND_SQL} FROM pt JOIN se USING (contrast)""")
def b02_paired(spark, d):
    """Whole groups drawn for a pair of runs (shared draws) and for one run alone."""
    listed = spark.createDataFrame([("review-base", "review", "base"), ("base", "base", None)], "contrast string, a string, b string")
    rows = materialized(resample.joint_rows(predictions(spark, d), listed, text_groups(spark, d)), "joint")
    n = rows.groupBy("contrast").agg(F.count("*").alias("n_rows"))
    g = rows.select("contrast", "grp").distinct().groupBy("contrast").agg(F.count("*").alias("n_groups"))
    found = resample.in_band(resample.contrast_intervals(rows, N_CLASSES, grouped=True), resample.standard_error(rows, True))
    return n.join(g, "contrast").join(found, "contrast").select("contrast", "n_rows", "n_groups", F.round("accuracy", 9).alias("accuracy"), "replicates", F.round("se", 8).alias("se"), *BAND[1:])


INVENTORY = VIEWS + ", g AS (SELECT m AS model, a AS arm, k AS train_per_class FROM (SELECT unnest(['m1', 'm2']) AS m), (SELECT unnest(['source', 'review', 'direct']) AS a), (SELECT unnest([0, 4]) AS k)), n AS (SELECT run_id, count(*) AS c FROM pred GROUP BY 1) SELECT coalesce(g.model, r.model) AS model, coalesce(g.arm, r.arm) AS arm, coalesce(g.train_per_class, r.train_per_class) AS train_per_class, CASE WHEN r.model IS NULL THEN 'missing' WHEN g.model IS NULL THEN 'unexpected' ELSE r.status END AS status FROM g FULL JOIN (SELECT runs.* FROM runs LEFT JOIN n USING (run_id) WHERE status <> 'complete' OR c > 0) r ON g.model = r.model AND g.arm = r.arm AND g.train_per_class IS NOT DISTINCT FROM r.train_per_class"


@query("c09_inventory", INVENTORY)
def c09(spark, d):
    done = predictions(spark, d).select("run_id").distinct().withColumn("has", F.lit(True))
    r = runs(spark).join(done, "run_id", "left").where("status <> 'complete' or has")
    dims = [spark.range(1).select(F.explode(F.array(*map(F.lit, v))).alias(n)) for n, v in (("model", ["m1", "m2"]), ("arm", ["source", "review", "direct"]), ("train_per_class", [0, 4]))]
    return contrast.inventory(dims[0].crossJoin(dims[1]).crossJoin(dims[2]), r, ["model", "arm", "train_per_class"])


@query("c09_arm_counts", f"SELECT arm, count(*) AS conditions, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'unexpected') AS unexpected, count(*) FILTER (WHERE status NOT IN ('complete', 'missing', 'unexpected')) AS other FROM ({INVENTORY}) GROUP BY 1")
def c09_arms(spark, d):
    n = lambda k: F.count_if(F.col("status") == k).alias(k)
    other = F.count_if(~F.col("status").isin("complete", "missing", "unexpected")).alias("other")
    return c09(spark, d).groupBy("arm").agg(F.count("*").alias("conditions"), n("complete"), n("missing"), n("unexpected"), other)


@query("c10_review_linkage", VIEWS + 'SELECT r.run_id, s.run_id IS NOT NULL AS "exists", coalesce(s.status = \'complete\', false) AS complete, coalesce(s.model = r.model AND s.train_per_class IS NOT DISTINCT FROM r.train_per_class, false) AS matches, (SELECT count(*) FROM pred WHERE run_id = r.run_id) AS saved FROM runs r LEFT JOIN runs s ON r.source_run_id = s.run_id WHERE r.arm = \'review\'')
def c10(spark, d):
    saved = predictions(spark, d).groupBy("run_id").agg(F.count("*").alias("saved"))
    return contrast.review_linkage(runs(spark)).join(saved, "run_id", "left").fillna(0, ["saved"])


@query("c11_best_model", VIEWS + f""", vs AS (SELECT dataset, run_id, avg(CAST(pred = y AS INTEGER)) FILTER (WHERE v) AS va, avg(CAST(pred = y AS INTEGER)) FILTER (WHERE NOT v) AS ta FROM (SELECT pred.*, {u("'validation'", "row_id")} % 4 = 0 AS v FROM pred) JOIN runs USING (run_id) GROUP BY 1, 2),
t AS (SELECT * FROM vs ORDER BY ta DESC, run_id LIMIT 1), v AS (SELECT * FROM vs ORDER BY va DESC, run_id LIMIT 1)
SELECT t.dataset, t.run_id AS test_best, round(t.ta, 9) AS test_score, v.run_id AS validation_best, round(v.va, 9) AS validation_score, round(v.ta, 9) AS validation_best_on_test FROM t, v""")
def c11(spark, d):
    """A quarter of the scored rows, by hash of the id, serves for validation."""
    p = predictions(spark, d).withColumns({"v": keyed("validation", F.col("row_id")) % 4 == 0, "right": (F.col("pred") == F.col("y")).cast("int")})
    s = p.groupBy("run_id").agg(F.avg(F.when(F.col("v"), F.col("right"))).alias("validation"), F.avg(F.when(~F.col("v"), F.col("right"))).alias("test"))
    return rounded(contrast.best_runs(s.join(runs(spark).select("run_id", "dataset"), "run_id")), "test_score", "validation_score", "validation_best_on_test")


@query("c12_panel", VIEWS + ", pn AS (SELECT row_id FROM (SELECT DISTINCT row_id FROM pred) ORDER BY sha256('panel:' || row_id), row_id LIMIT 36) SELECT run_id, count(*) AS n_rows, count(*) FILTER (WHERE pred = y) AS correct FROM pred WHERE row_id IN (SELECT row_id FROM pn) GROUP BY 1")
def c12(spark, d):
    return contrast.fixed_panel(predictions(spark, d), 36)


@query("c15_directions", PAIR + ", t AS (SELECT count(*) FILTER (WHERE b = y) - count(*) FILTER (WHERE a = y) AS d FROM pr GROUP BY before, after) SELECT count(*) FILTER (WHERE d > 0) AS improved, count(*) FILTER (WHERE d = 0) AS tied, count(*) FILTER (WHERE d < 0) AS declined FROM t")
def c15(spark, d):
    t = contrast.transitions(predictions(spark, d), PAIRS)
    return t.agg(F.count_if(F.col("net") > 0).alias("improved"), F.count_if(F.col("net") == 0).alias("tied"), F.count_if(F.col("net") < 0).alias("declined"))


@query("v01_joint", VIEWS + ", b AS (SELECT row_id, string_agg(CAST(pred = y AS INTEGER)::VARCHAR, '' ORDER BY list_position(['base', 'direct', 'review'], run_id)) AS pattern FROM pred WHERE run_id IN ('base', 'direct', 'review') GROUP BY 1) SELECT g.pattern, count(b.row_id) AS n FROM (SELECT unnest(['000', '001', '010', '011', '100', '101', '110', '111']) AS pattern) g LEFT JOIN b USING (pattern) GROUP BY 1")
def v01(spark, d):
    return contrast.joint_correctness(predictions(spark, d), ["base", "direct", "review"])


GATE = VIEWS + ", gt AS (SELECT run_id, list_filter([CASE WHEN any_value(status) <> 'complete' THEN 'incomplete' END, CASE WHEN any_value(model) = 'm3' THEN 'not_local' END, CASE WHEN min(pred) = max(pred) THEN 'constant_labels' END, CASE WHEN min(pred) < 0 THEN 'failures' END, CASE WHEN count(p) = 0 THEN 'no_probabilities' END], lambda x: x IS NOT NULL) AS reasons FROM runs LEFT JOIN pred USING (run_id) GROUP BY 1)"


def _reasons(spark, d):
    p = predictions(spark, d).groupBy("run_id").agg(F.min("pred").alias("least"), F.max("pred").alias("most"), F.count("probabilities").alias("held"))
    rows = runs(spark).select("run_id", "status", "model").join(p, "run_id", "left")
    r = [F.when(F.col("status") != "complete", "incomplete"), F.when(F.col("model") == "m3", "not_local"), F.when(F.col("least") == F.col("most"), "constant_labels"), F.when(F.col("least") < 0, "failures"), F.when(F.coalesce("held", F.lit(0)) == 0, "no_probabilities")]
    return rows.select("run_id", F.filter(F.array(*r), lambda x: x.isNotNull()).alias("reasons"))


@query("v02_eligibility", GATE + " SELECT run_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS eligible FROM gt")
def v02(spark, d):
    return _reasons(spark, d).select("run_id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("eligible"))


@query("v03_sensitivity_gate", GATE + " SELECT run_id, len(list_filter(reasons, lambda x: x <> 'constant_labels')) = 0 AS eligible FROM gt")
def v03(spark, d):
    return _reasons(spark, d).select("run_id", (F.size(F.array_remove("reasons", "constant_labels")) == 0).alias("eligible"))


RANKED = VIEWS + ", rk AS (SELECT row_id, y, pred AS a, row_number() OVER (ORDER BY coalesce(list_max(p), 0), sha256(CAST(row_id AS VARCHAR))) AS rank, count(*) OVER () AS n FROM pred WHERE run_id = 'base'), rt AS (SELECT unnest([0, 10, 25, 50, 75, 100]) AS rate)"


@query("v04_rank", RANKED + " SELECT row_id, rank FROM rk")
def v04(spark, d):
    return contrast.confidence_ranked(predictions(spark, d), "base").select("row_id", "rank")


@query("v05_coverage", RANKED + " SELECT DISTINCT rate, (n * rate + 50) // 100 AS covered FROM rk, rt")
def v05(spark, d):
    n = predictions(spark, d).where("run_id = 'base'").agg(F.count("*").alias("n"))
    return n.crossJoin(contrast._rates(spark)).select("rate", contrast.covered(F.col("n"), F.col("rate")).alias("covered"))


MIXED = RANKED + ", mx AS (SELECT rate, rk.y, a, p2.pred AS b, rank <= (n * rate + 50) // 100 AS picked FROM rk JOIN (SELECT row_id, pred FROM pred WHERE run_id = 'review') p2 USING (row_id), rt), cf AS (SELECT rate, y, CASE WHEN picked THEN b ELSE a END AS pred, count(*) AS n FROM mx GROUP BY ALL)"


@query("v06_curve", MIXED + f", {per_class_sql('cf', 'rate')} SELECT sc.rate, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1, round(balanced_accuracy, 9) AS balanced_accuracy, count(*) FILTER (WHERE CASE WHEN picked THEN b ELSE a END < 0) AS failures, count(*) FILTER (WHERE picked) AS reviewed, count(*) FILTER (WHERE picked AND a <> mx.y AND b = mx.y) AS fixed, count(*) FILTER (WHERE picked AND a = mx.y AND b <> mx.y) AS harmed FROM sc JOIN mx USING (rate) GROUP BY ALL".replace("sum(n) FILTER (WHERE pred = c) AS guessed", "coalesce(sum(n) FILTER (WHERE pred = c), 0) AS guessed").replace("sum(n) FILTER (WHERE y = c AND pred = c) AS tp", "coalesce(sum(n) FILTER (WHERE y = c AND pred = c), 0) AS tp"))
def v06(spark, d):
    return rounded(contrast.selective_curve(predictions(spark, d), "base", "review", N_CLASSES), "accuracy", "macro_f1", "balanced_accuracy")


@query("v07_random_reference", MIXED + ", k AS (SELECT rate, y, count(*) AS n, count(*) FILTER (WHERE a = y) AS sa, count(*) FILTER (WHERE b = y) AS sb FROM mx GROUP BY 1, 2), s AS (SELECT rate, count(*) AS n, count(*) FILTER (WHERE picked) / count(*) AS share, count(*) FILTER (WHERE a = y) AS sa, count(*) FILTER (WHERE b = y) AS sb, count(*) FILTER (WHERE a <> y AND b = y) AS fx, count(*) FILTER (WHERE a = y AND b <> y) AS hm, count(*) FILTER (WHERE a < 0) AS fa, count(*) FILTER (WHERE b < 0) AS fb FROM mx GROUP BY 1) SELECT s.rate, round((s.sa + share * (s.sb - s.sa)) / s.n, 9) AS accuracy, round(share * fx, 9) AS fixed, round(share * hm, 9) AS harmed, round(fa + share * (fb - fa), 9) AS failures, round((SELECT avg((k.sa + s.share * (k.sb - k.sa)) / k.n) FROM k WHERE k.rate = s.rate), 9) AS balanced_accuracy FROM s")
def v07(spark, d):
    return rounded(contrast.random_reference(predictions(spark, d), "base", "review"), "accuracy", "balanced_accuracy", "fixed", "harmed", "failures")


@query("v08_checked", MIXED + """, ce AS (SELECT DISTINCT rate, y, a, b, count(*) OVER (PARTITION BY rate, y, a, b) AS n, count(*) FILTER (WHERE picked) OVER (PARTITION BY rate) / count(*) OVER (PARTITION BY rate) AS share FROM mx),
pf AS (SELECT rate, any_value(share) AS share, c, 2 * sum(n * ((y = c AND b = c)::INT * share + (y = c AND a = c)::INT * (1 - share))) / nullif(sum(n * ((y = c)::INT + (b = c)::INT * share + (a = c)::INT * (1 - share))), 0) AS f FROM ce, cls GROUP BY rate, c)
SELECT rate, CASE WHEN any_value(share) IN (0, 1) THEN 0 ELSE 10000 END::INTEGER AS samples, round(avg(coalesce(f, 0)), 9) AS plug_in, true AS near FROM pf GROUP BY rate""")
def v08_checked(spark, d):
    """The draws' means against macro-F1 of the expected counts, which they approach as rows grow."""
    p = predictions(spark, d)
    n = p.where("run_id = 'base'").count()
    out = contrast.random_macro_f1(p, "base", "review", N_CLASSES)
    near = F.abs(F.col("macro_f1") - F.col("plug_in")) <= F.when(F.col("samples") == 0, 1e-12).otherwise(5 * F.col("se") + F.lit(2.0) / n)
    return out.select("rate", "samples", F.round("plug_in", 9).alias("plug_in"), near.alias("near"))


@query("v08_random_macro_f1")
def v08(spark, d):
    return contrast.random_macro_f1(predictions(spark, d), "base", "review", N_CLASSES)


@query("v09_prompt_pairs", VIEWS + "SELECT a.run_id AS run_a, b.run_id AS run_b, count(*) AS equal_proposals, count(*) FILTER (WHERE a.pred < 0) AS both_failed, count(*) FILTER (WHERE a.pred >= 0 AND (a.pred = a.y) <> (b.pred = b.y)) AS disagreements, count(*) FILTER (WHERE ra.model <> rb.model) AS model_mismatch FROM pred a JOIN pred b ON a.row_id = b.row_id AND a.run_id < b.run_id AND sha256(a.row_id || ':' || a.pred) = sha256(b.row_id || ':' || b.pred) JOIN runs ra ON ra.run_id = a.run_id JOIN runs rb ON rb.run_id = b.run_id GROUP BY 1, 2")
def v09(spark, d):
    """Pairs of runs by rows whose review prompts (row and proposal) have the same digest."""
    p = predictions(spark, d).join(F.broadcast(runs(spark).select("run_id", "model")), "run_id")
    return contrast.prompt_pairs(p.withColumn("prompt", F.sha2(F.concat_ws(":", "row_id", "pred"), 256)))


def _versus(spark, d):
    p = predictions(spark, d)
    c = contrast.selective_curve(p, "base", "review", N_CLASSES).select("rate", F.col("accuracy").alias("x"))
    return c.join(contrast.random_reference(p, "base", "review").select("rate", F.col("accuracy").alias("r")), "rate")


@query("v10_pattern", MIXED + ", s AS (SELECT rate, avg(CAST(CASE WHEN picked THEN b ELSE a END = y AS INTEGER)) AS x, (count(*) FILTER (WHERE a = y) + count(*) FILTER (WHERE picked) / count(*) * (count(*) FILTER (WHERE b = y) - count(*) FILTER (WHERE a = y))) / count(*) AS r FROM mx WHERE rate NOT IN (0, 100) GROUP BY 1), pt AS (SELECT rate, CASE WHEN abs(x - r) < 1e-12 THEN 'tie' WHEN x > r THEN 'above' ELSE 'below' END AS pattern FROM s) SELECT *, (SELECT CASE WHEN count(DISTINCT pattern) > 1 THEN 'mixed' ELSE min(pattern) END FROM pt) AS pooled FROM pt")
def v10(spark, d):
    rows = _versus(spark, d).where("rate not in (0, 100)").select("rate", F.when(F.abs(F.col("x") - F.col("r")) < 1e-12, "tie").when(F.col("x") > F.col("r"), "above").otherwise("below").alias("pattern"))
    # one row per rate
    return rows.crossJoin(rows.agg(F.when(F.count_distinct("pattern") > 1, "mixed").otherwise(F.min("pattern")).alias("pooled")))


@query("v11_endpoints", VIEWS + "SELECT unnest([0, 100]) AS rate, 0 AS violations")
def v11(spark, d):
    """A curve's ends have the metrics of its source and of its review."""
    p, metrics = predictions(spark, d), ["accuracy", "macro_f1", "balanced_accuracy"]
    s = score.scores(score.confusion(p, N_CLASSES))
    ends = [s.where(F.col("run_id") == run).select(*[F.col(m).alias(f"{run}_{m}") for m in metrics]) for run in ("base", "review")]
    curve = contrast.selective_curve(p, "base", "review", N_CLASSES)
    return contrast.endpoint_violations(curve.crossJoin(F.broadcast(ends[0])).crossJoin(F.broadcast(ends[1])), "base", "review", metrics)


@query("v12_inferences", MIXED + " SELECT 'selective' AS policy, rate, count(*) + count(*) FILTER (WHERE picked AND a >= 0) AS calls FROM mx GROUP BY 2 UNION ALL SELECT unnest(['never', 'always', 'direct']), NULL, unnest([count(*), count(*) + count(*) FILTER (WHERE a >= 0), count(*)]) FROM rk")
def v12(spark, d):
    """Calls per policy: a review needs a valid proposal; direct classification replaces the source call."""
    c = contrast.selective_cells(predictions(spark, d), "base", "review")
    asked = F.sum(F.when(F.col("picked") & (F.col("a") >= 0), F.col("n")).otherwise(0))
    per = c.groupBy("rate").agg((F.sum("n") + asked).alias("calls"), F.sum("n").alias("n"))
    rows = per.select(F.lit("selective").alias("policy"), "rate", "calls")
    for policy, rate, calls in (("never", 0, "calls"), ("always", 100, "calls"), ("direct", 0, "n")):
        rows = rows.union(per.where(F.col("rate") == rate).select(F.lit(policy), F.lit(None).cast("int"), calls))
    return rows
