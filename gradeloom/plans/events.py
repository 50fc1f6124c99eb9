"""Queries for recovery, ledgers, audits and streams (R, L, A, P, T)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import keyed
from ..operators import audit, events, prep, score
from ..sources.files import shared_folder
from ..streaming import streams
from .prep import LABELED
from .registry import query
from .scoring import CONF, KIND, per_class_sql, rounded
from .views import N_CLASSES, VIEWS, examples, ledger, predictions, runs, table, u

ATT = VIEWS + f""", fl AS (SELECT run_id, row_id, y, error FROM pred WHERE pred < 0), ok AS (SELECT *, {u("'retry1'", "row_id")} % 100 < 80 AS ok1, {u("'retry2'", "row_id")} % 100 < 80 AS ok2 FROM fl),
att AS (SELECT run_id, row_id, 1 AS attempt_index, CASE WHEN ok1 THEN y END AS label FROM ok UNION ALL SELECT run_id, row_id, 2, CASE WHEN ok2 THEN y END FROM ok WHERE NOT ok1),
vw AS (SELECT pred.run_id, pred.row_id, pred.y, pred.label AS original, a1.label AS first_retry, coalesce(pred.label, a1.label, a2.label) AS recovered, (a1.row_id IS NOT NULL)::INT + (a2.row_id IS NOT NULL)::INT AS extra FROM pred LEFT JOIN att a1 ON a1.run_id = pred.run_id AND a1.row_id = pred.row_id AND a1.attempt_index = 1 LEFT JOIN att a2 ON a2.run_id = pred.run_id AND a2.row_id = pred.row_id AND a2.attempt_index = 2)"""


def attempts(spark, d):
    lost = predictions(spark, d).where("pred < 0").select("run_id", "row_id", "y", "error")
    ok = lambda k: keyed(f"retry{k}", F.col("row_id")) % 100 < 80
    one = lost.select("run_id", "row_id", F.lit(1).alias("attempt_index"), F.when(ok(1), F.col("y")).alias("label"))
    return one.unionByName(lost.where(~ok(1)).select("run_id", "row_id", F.lit(2).alias("attempt_index"), F.when(ok(2), F.col("y")).alias("label")))


def _views(spark, d):
    p = predictions(spark, d)
    return events.attempt_views(p, attempts(spark, d)).join(p.select("run_id", "row_id", "y"), ["run_id", "row_id"])


@query("r01_failures", VIEWS + f", kd AS (SELECT *, {KIND} AS kind FROM pred) SELECT p.run_id, p.row_id, p.kind, sha256(p.run_id || ':' || p.row_id) AS failure_id, CASE WHEN s.pred < 0 THEN 'upstream_skip' ELSE 'paid_failure' END AS origin, CASE WHEN s.pred < 0 THEN sha256(s.run_id || ':' || s.row_id) END AS depends_on FROM kd p LEFT JOIN pred s ON s.run_id = p.source_run_id AND s.row_id = p.row_id WHERE p.pred < 0")
def r01(spark, d):
    """Failed predictions; a review of a row whose source failed depends on that failure."""
    p = predictions(spark, d).where("pred < 0")
    failure = F.sha2(F.concat_ws(":", "run_id", "row_id"), 256)
    up = p.select(F.col("run_id").alias("source_run_id"), "row_id", failure.alias("depends_on"))
    rows = p.join(up, ["source_run_id", "row_id"], "left")
    origin = F.when(F.col("depends_on").isNotNull(), "upstream_skip").otherwise("paid_failure")
    return rows.select("run_id", "row_id", score.failure_kind(F.col("error")).alias("kind"), failure.alias("failure_id"), origin.alias("origin"), "depends_on")


@query("r02_pending", VIEWS + "SELECT r.run_id, count(p.row_id) AS saved, (SELECT count(*) FROM ex WHERE source_split = 'test') AS expected, (SELECT count(*) FROM pred s WHERE s.run_id = r.source_run_id AND s.pred < 0) AS failed_sources, (SELECT count(*) FROM pred s WHERE s.run_id = r.source_run_id AND s.error LIKE 'invalid_output%') AS invalid_sources FROM runs r LEFT JOIN pred p USING (run_id) GROUP BY r.run_id, r.source_run_id")
def r02(spark, d):
    per = predictions(spark, d).groupBy("run_id").agg(F.count("*").alias("saved"), F.count_if(F.col("pred") < 0).alias("failed"), F.count_if(F.coalesce(F.col("error").startswith("invalid_output"), F.lit(False))).alias("invalid"))
    want = examples(spark, d).where("source_split = 'test'").agg(F.count("*").alias("expected"))
    source = per.select(F.col("run_id").alias("source_run_id"), F.col("failed").alias("failed_sources"), F.col("invalid").alias("invalid_sources"))
    out = runs(spark).select("run_id", "source_run_id").join(per.select("run_id", "saved"), "run_id", "left").join(source, "source_run_id", "left")
    return out.drop("source_run_id").fillna(0, ["saved", "failed_sources", "invalid_sources"]).crossJoin(want)


@query("r03_attempt_order", ATT + " SELECT unnest(['order', 'after_success', 'too_many']) AS rule, 0 AS n")
def r03(spark, d):
    return events.attempt_violations(attempts(spark, d))


@query("r03_first_breaks", ATT + f""", ij AS (SELECT *, {u("'inj'", "row_id")} % 8 AS h, {u("'stg'", "row_id")} % 3 AS g FROM ok), mx AS (SELECT *, CASE WHEN ok1 OR h = 4 THEN 1 ELSE 2 END AS n FROM ij)
SELECT run_id, row_id, CASE h WHEN 0 THEN 'order' WHEN 1 THEN 'stage' WHEN 2 THEN 'identity' WHEN 3 THEN CASE WHEN ok1 OR ok2 THEN 'after_success' ELSE 'too_many' END WHEN 4 THEN 'unfinished' ELSE 'unknown_row' END AS rule,
CASE h WHEN 3 THEN n + 1 WHEN 4 THEN 2 ELSE 1 END::INTEGER AS "at" FROM mx WHERE h < 3 OR h = 3 OR (h = 4 AND NOT ok1) OR h = 5""")
def r03_first(spark, d):
    """The attempts with faults put in: shifted indices, wrong stages, other prompts, one attempt more, one less,
    and rows whose original is not there."""
    h, g = keyed("inj", F.col("row_id")) % 8, keyed("stg", F.col("row_id")) % 3
    origin = F.when(g == 0, "attempted").when(g == 1, "upstream_not_called").otherwise("not_attempted")
    prompt = F.sha2(F.concat_ws(":", "run_id", "row_id"), 256)
    lost = predictions(spark, d).where("pred < 0").select("run_id", "row_id", origin.alias("stage"), F.col("label"), prompt.alias("prompt"))
    tries = attempts(spark, d).withColumn("h", h)
    due = F.when((F.col("attempt_index") > 1) | (g == 0), "retry").when(g == 1, "dependent_first_call").otherwise("first_attempt")
    tries = tries.withColumns({"stage": F.when((F.col("h") == 1) & (F.col("attempt_index") == 1), "another").otherwise(due), "prompt": F.when(F.col("h") == 2, "x").otherwise(prompt)})
    more = tries.where("h = 3").groupBy("run_id", "row_id").agg((F.max("attempt_index") + 1).alias("attempt_index"), F.first("prompt").alias("prompt"))
    more = more.select("run_id", "row_id", "attempt_index", F.lit(None).cast("int").alias("label"), F.lit("retry").alias("stage"), "prompt")
    tries = tries.where("not (h = 4 and attempt_index = 2)").withColumn("attempt_index", F.col("attempt_index") + F.when(F.col("h") == 0, 1).otherwise(0))
    return events.first_breaks(lost.where(h != 5), tries.select(more.columns).unionByName(more))


@query("r04_views", ATT + " SELECT run_id, row_id, original, first_retry, recovered, extra AS extra_attempts FROM vw")
def r04(spark, d):
    return _views(spark, d).select("run_id", "row_id", "original", "first_retry", "recovered", "extra_attempts")


@query("r05_view_summary", ATT + f", kd AS (SELECT vw.*, {KIND} AS kind FROM vw JOIN pred USING (run_id, row_id)) SELECT run_id, count(*) AS n_rows, count(original) AS answered, count(recovered) AS recovered, count(*) FILTER (WHERE kind = 'billing') AS billing, count(*) FILTER (WHERE kind = 'transport') AS transport, count(*) FILTER (WHERE kind = 'http_service') AS http_service, count(*) FILTER (WHERE kind = 'invalid_output') AS invalid_output, round(CASE WHEN count(*) = (SELECT count(*) FROM ex WHERE source_split = 'test') THEN count(*) FILTER (WHERE original = y) / count(*) END, 9) AS accuracy, round(CASE WHEN count(*) = (SELECT count(*) FROM ex WHERE source_split = 'test') THEN count(*) FILTER (WHERE recovered = y) / count(*) END, 9) AS recovered_accuracy FROM kd GROUP BY 1")
def r05(spark, d):
    """Counts by kind of failure; accuracies only where every row was attempted."""
    kinds = predictions(spark, d).select("run_id", "row_id", score.failure_kind(F.col("error")).alias("kind"))
    want = examples(spark, d).where("source_split = 'test'").agg(F.count("*").alias("want"))
    right = lambda c: F.count_if(F.col(c) == F.col("y")).alias(f"{c}_right")
    of = [F.count_if(F.col("kind") == k).alias(k) for k in ("billing", "transport", "http_service", "invalid_output")]
    per = _views(spark, d).join(kinds, ["run_id", "row_id"]).groupBy("run_id").agg(F.count("*").alias("n_rows"), F.count("original").alias("answered"), F.count("recovered").alias("recovered"), *of, right("original"), right("recovered"))
    share = lambda c: F.round(F.when(F.col("n_rows") == F.col("want"), F.col(f"{c}_right") / F.col("n_rows")), 9)
    out = per.crossJoin(F.broadcast(want)).withColumns({"accuracy": share("original"), "recovered_accuracy": share("recovered")})
    return out.drop("want", "original_right", "recovered_right")


@query("r06_recovery_pairs", ATT + " SELECT run_id, count(*) FILTER (WHERE original IS DISTINCT FROM y AND recovered = y) AS corrected, count(*) FILTER (WHERE original = y AND recovered IS DISTINCT FROM y) AS harmed FROM vw GROUP BY 1")
def r06(spark, d):
    a, b = F.col("original").eqNullSafe(F.col("y")), F.col("recovered").eqNullSafe(F.col("y"))
    return _views(spark, d).groupBy("run_id").agg(F.count_if(~a & b).alias("corrected"), F.count_if(a & ~b).alias("harmed"))


@query("r08_rollup", ATT + f""", k AS (SELECT run_id, row_id, source_run_id, {KIND} AS kind FROM pred WHERE pred < 0)
SELECT k.kind, count(*) AS failures, count(v.recovered) AS resolved, count(v.first_retry) AS at_first_retry, CAST(sum(v.extra) AS BIGINT) AS attempts, count(s.row_id) AS upstream, count(*) FILTER (WHERE s.row_id IS NOT NULL AND s.recovered IS NULL) AS unresolved_upstream
FROM k JOIN vw v ON v.run_id = k.run_id AND v.row_id = k.row_id LEFT JOIN vw s ON s.run_id = k.source_run_id AND s.row_id = k.row_id AND s.original IS NULL GROUP BY 1""")
def r08(spark, d):
    """Outcomes by kind of failure and stage; upstream are failures whose source run failed on the same row."""
    kinds = predictions(spark, d).where("pred < 0").select("run_id", "row_id", "source_run_id", score.failure_kind(F.col("error")).alias("kind"))
    v = _views(spark, d)
    source = v.where("original is null").select(F.col("run_id").alias("source_run_id"), "row_id", F.lit(True).alias("up"), F.col("recovered").isNull().alias("open"))
    rows = kinds.join(v, ["run_id", "row_id"]).join(source, ["source_run_id", "row_id"], "left")
    return rows.groupBy("kind").agg(F.count("*").alias("failures"), F.count("recovered").alias("resolved"), F.count("first_retry").alias("at_first_retry"), F.sum("extra_attempts").alias("attempts"), F.count("up").alias("upstream"), F.count_if("open").alias("unresolved_upstream"))


@query("r10_next_action", ATT + """, nx AS (SELECT v.run_id, v.row_id, v.extra + 1 AS next_attempt, s.row_id IS NOT NULL AND s.original IS NULL AS dependent, s.recovered IS NOT NULL AS ready FROM vw v LEFT JOIN pred p ON p.run_id = v.run_id AND p.row_id = v.row_id LEFT JOIN vw s ON s.run_id = p.source_run_id AND s.row_id = v.row_id
WHERE v.original IS NULL AND v.recovered IS NULL AND v.extra < 3) SELECT run_id, row_id, next_attempt, CASE WHEN dependent THEN 2 ELSE 1 END AS phase FROM nx WHERE NOT dependent OR ready""")
def r10(spark, d):
    """Failures that may be tried again: first those on their own, then those whose source has come good since."""
    v = _views(spark, d)
    todo = v.where("original is null and recovered is null and extra_attempts < 3").select("run_id", "row_id", (F.col("extra_attempts") + 1).alias("next_attempt"))
    links = predictions(spark, d).select("run_id", "row_id", "source_run_id")
    source = v.where("original is null").select(F.col("run_id").alias("source_run_id"), "row_id", F.lit(True).alias("dependent"), F.col("recovered").isNotNull().alias("ready"))
    rows = todo.join(links, ["run_id", "row_id"], "left").join(source, ["source_run_id", "row_id"], "left")
    return rows.where("dependent is null or ready").select("run_id", "row_id", "next_attempt", F.when(F.col("dependent"), 2).otherwise(1).alias("phase"))


@query("r11_halts", VIEWS + ", l AS (SELECT run_id, row_id, error, lag(error, 1) OVER w AS e1, lag(error, 2) OVER w AS e2 FROM pred WINDOW w AS (PARTITION BY run_id ORDER BY row_id)) SELECT run_id, min(row_id) AS halted_at FROM l WHERE contains(error, 'status=402') OR (error IS NOT NULL AND e1 IS NOT NULL AND e2 IS NOT NULL) GROUP BY 1")
def r11(spark, d):
    return events.halts(predictions(spark, d), "run_id", "row_id", "error")


@query("l01_nano", "SELECT event_id, CAST(ceil(CAST(value AS DECIMAL(18,6)) * 1000000000) AS BIGINT) AS nano FROM events")
def l01(spark, d):
    return table(spark, d, "events").select("event_id", F.ceil(F.col("value").cast("decimal(18,6)") * events.NANO).cast("long").alias("nano"))


@query("l02_chain", VIEWS + "SELECT ledger_id, 0 AS broken_links, 0 AS wrong_hashes, count(*) AS n FROM ledger GROUP BY 1")
def l02(spark, d):
    return events.chain_violations(chained(ledger(spark, d)))


def chained(rows):
    """``rows`` as a hash chain: a payload holds the digest of the event before it in its own core, an
    event's digest covers its payload, and ``previous_sha256`` names the digest before it."""
    core = F.concat_ws(":", "seq", "type", "reservation_id")
    before = rows.select("ledger_id", (F.col("seq") + 1).alias("seq"), F.sha2(core, 256).alias("__c"))
    rows = rows.join(before, ["ledger_id", "seq"], "left").withColumn("payload", F.concat_ws(":", core, F.coalesce("__c", F.lit("")))).drop("__c")
    rows = rows.withColumn("event_sha256", F.sha2("payload", 256))
    last = rows.select("ledger_id", (F.col("seq") + 1).alias("seq"), F.col("event_sha256").alias("__p"))
    return rows.join(last, ["ledger_id", "seq"], "left").withColumn("previous_sha256", F.coalesce("__p", F.lit(""))).drop("__p")


@query("l03_event_checks", VIEWS + ", r AS (SELECT ledger_id, reservation_id, count(*) FILTER (WHERE type = 'reserve') AS a, count(*) FILTER (WHERE type = 'settle') AS c, max(charged_nano) > max(reserved_nano) AS o FROM ledger GROUP BY 1, 2) SELECT ledger_id, count(*) FILTER (WHERE a <> 1) AS reserve_count, count(*) FILTER (WHERE c > 1) AS settle_count, count(*) FILTER (WHERE o) AS overcharged FROM r GROUP BY 1")
def l03(spark, d):
    r = events.reservations(ledger(spark, d))
    return r.groupBy("ledger_id").agg(F.count_if(F.col("n_reserve") != 1).alias("reserve_count"), F.count_if(F.col("n_settle") > 1).alias("settle_count"), F.count_if(F.col("charged_nano") > F.col("reserved_nano")).alias("overcharged"))


RES = VIEWS + ", r AS (SELECT ledger_id, reservation_id, max(reserved_nano) AS reserved, max(charged_nano) AS charged, max(outcome) AS outcome, count(*) FILTER (WHERE type = 'result') AS nr FROM ledger GROUP BY 1, 2)"


@query("l04_balance", RES + " SELECT ledger_id, count(*) AS reservations, CAST(sum(reserved) AS BIGINT) AS reserved_nano, CAST(sum(coalesce(charged, reserved)) AS BIGINT) AS conservative_nano, CAST(coalesce(sum(charged), 0) AS BIGINT) AS known_nano, count(charged) AS settled FROM r GROUP BY 1")
def l04(spark, d):
    return events.balances(ledger(spark, d))


@query("l05_first_breach", VIEWS + ", h AS (SELECT ledger_id, reservation_id, reserved_nano AS held FROM ledger WHERE type = 'reserve'), x AS (SELECT l.*, CASE l.type WHEN 'reserve' THEN l.reserved_nano WHEN 'settle' THEN l.charged_nano - held ELSE 0 END AS delta FROM ledger l JOIN h USING (ledger_id, reservation_id)), c AS (SELECT *, coalesce(sum(delta) OVER (PARTITION BY ledger_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x) SELECT ledger_id, min(seq) AS seq FROM c WHERE type = 'reserve' AND before + reserved_nano > 1000000000000 GROUP BY 1")
def l05(spark, d):
    return events.first_breach(ledger(spark, d), 1_000_000_000_000)


@query("l06_reservation_bound", VIEWS + "SELECT row_id, CAST((strlen(text) + 2048) * 300 + 64 * 1200 AS BIGINT) AS bound_nano FROM ex WHERE source_split = 'test'")
def l06(spark, d):
    return examples(spark, d).where("source_split = 'test'").select("row_id", ((F.octet_length("text") + 2048).cast("long") * 300 + 64 * 1200).alias("bound_nano"))


@query("l07_plan_cost", VIEWS + "SELECT model, count(*) AS requests, CAST(sum((strlen(text) + 2048) * 300 + 64 * 1200) AS BIGINT) AS bound_nano FROM ex, runs WHERE source_split = 'test' GROUP BY 1")
def l07(spark, d):
    return l06(spark, d).crossJoin(F.broadcast(runs(spark).select("model"))).groupBy("model").agg(F.count("*").alias("requests"), F.sum("bound_nano").alias("bound_nano"))


@query("l08_settlement", VIEWS + ", c AS (SELECT run_id, input_tokens * 300 + output_tokens * 1200 AS token, (input_tokens * 300 + output_tokens * 1200) * (row_id % 3) // 2 AS reported FROM pred) SELECT run_id, CAST(sum(token) AS BIGINT) AS estimate_nano, CAST(sum(CASE WHEN token IS NOT NULL THEN least(greatest(token, reported) * 5 // 4, 2000000) END) AS BIGINT) AS settled_nano FROM c GROUP BY 1")
def l08(spark, d):
    """Token estimate, and a conservative settlement: the larger of reported and token cost times 1.25, up to a cap."""
    token = F.col("input_tokens") * 300 + F.col("output_tokens") * 1200
    reported = F.floor(token * (F.col("row_id") % 3) / 2)
    settled = F.when(token.isNotNull(), F.least(F.floor(F.greatest(token, reported) * 5 / 4), F.lit(2_000_000)))
    return predictions(spark, d).groupBy("run_id").agg(F.sum(token).alias("estimate_nano"), F.sum(settled).cast("long").alias("settled_nano"))


@query("l09_reconcile", RES + f""", q AS (SELECT ledger_id, event_id, CASE WHEN event_type = 'purchase' THEN (nano * 8 + 9) // 10 END AS charged, {u("'answer'", "event_id")} AS h FROM ev WHERE event_type <> 'signup'),
an AS (SELECT ledger_id, event_id, charged + CASE WHEN h % 71 = 0 THEN 1 ELSE 0 END AS told FROM q WHERE h % 67 <> 0 UNION ALL SELECT ledger_id, event_id, charged + CASE WHEN h % 71 = 0 THEN 1 ELSE 0 END FROM q WHERE h % 73 = 0 UNION ALL SELECT ledger_id, -event_id - 1, NULL FROM q WHERE h % 79 = 0),
ag AS (SELECT ledger_id, event_id AS reservation_id, count(*) AS na, max(told) AS told FROM an GROUP BY 1, 2)
SELECT ledger_id, CASE WHEN r.reserved IS NULL THEN 'no_reserve' WHEN nr = 0 THEN 'no_result' WHEN na IS NULL THEN 'no_prediction' WHEN na > 1 THEN 'duplicate_prediction' WHEN charged > reserved THEN 'overcharged' WHEN charged IS DISTINCT FROM told THEN 'amount_mismatch' WHEN charged IS NULL THEN 'retained' ELSE 'settled' END AS status, count(*) AS n
FROM r FULL JOIN ag USING (ledger_id, reservation_id) GROUP BY 1, 2""")
def l09(spark, d):
    """Saved predictions with some lost, told a wrong amount, doubled, or naming no reservation."""
    e = table(spark, d, "events").where("event_type <> 'signup'")
    e = e.select((F.col("user_id") % 10).alias("ledger_id"), "event_id", F.when(F.col("event_type") == "purchase", F.ceil(F.col("value").cast("decimal(18,6)") * 1_000_000_000).cast("long")).alias("nano"), keyed("answer", F.col("event_id")).alias("h"))
    told = F.expr("(nano * 8 + 9) div 10") + (F.col("h") % 71 == 0).cast("int")
    answer = lambda c, id, told: F.when(c, F.struct(id.alias("reservation_id"), told.cast("long").alias("told_nano")))
    id, h = F.col("event_id"), F.col("h")
    answers = F.filter(F.array(answer(h % 67 != 0, id, told), answer(h % 73 == 0, id, told), answer(h % 79 == 0, -id - 1, F.lit(None))), lambda x: x.isNotNull())
    return events.reconcile(ledger(spark, d), e.select("ledger_id", F.inline(answers))).groupBy("ledger_id", "status").agg(F.count("*").alias("n"))


@query("l10_totals", RES + " SELECT coalesce(outcome, 'open') AS outcome, count(*) AS n, CAST(CASE WHEN count(charged) = count(*) THEN sum(charged) END AS BIGINT) AS total_nano, CAST(coalesce(sum(charged), 0) AS BIGINT) AS known_nano, round(count(charged) / count(*), 9) AS coverage FROM r GROUP BY 1")
def l10(spark, d):
    c = F.col("charged_nano")
    return events.reservations(ledger(spark, d)).groupBy(F.coalesce("outcome", F.lit("open")).alias("outcome")).agg(F.count("*").alias("n"), F.when(F.count(c) == F.count("*"), F.sum(c)).alias("total_nano"), F.coalesce(F.sum(c), F.lit(0)).alias("known_nano"), F.round(F.count(c) / F.count("*"), 9).alias("coverage"))


@query("l11_upper", RES + " SELECT CAST(sum(coalesce(charged, reserved)) AS BIGINT) AS upper_nano FROM r")
def l11(spark, d):
    return events.balances(ledger(spark, d)).agg(F.sum("conservative_nano").alias("upper_nano"))


@query("l12_authorization", RES + """, s AS (SELECT ledger_id % 3 AS stage, CAST(sum(coalesce(charged, reserved)) AS BIGINT) AS counted_nano, count(DISTINCT ledger_id) AS ledgers FROM r GROUP BY 1)
SELECT stage, counted_nano, ledgers, CAST(sum(counted_nano) OVER (ORDER BY stage) AS BIGINT) AS cumulative_nano, CAST(1000000000000000 - sum(counted_nano) OVER (ORDER BY stage) AS BIGINT) AS remaining_nano FROM s""")
def l12(spark, d):
    return events.authorization(events.balances(ledger(spark, d)), F.col("ledger_id") % 3, 10**15)


@query("l12_several_ledgers", RES + """, s AS (SELECT CASE WHEN ledger_id < 3 THEN 'a' WHEN ledger_id < 4 THEN 'b' ELSE 'c' END AS stage, CAST(sum(coalesce(charged, reserved)) AS BIGINT) AS counted_nano, count(DISTINCT ledger_id) AS ledgers FROM r GROUP BY 1)
SELECT stage, counted_nano, ledgers, CAST(sum(counted_nano) OVER (ORDER BY stage) AS BIGINT) AS cumulative_nano, CAST(1000000000000000 - sum(counted_nano) OVER (ORDER BY stage) AS BIGINT) AS remaining_nano FROM s""")
def l12_several(spark, d):
    """Three ledger tables under one authorization."""
    rows = ledger(spark, d)
    return events.authorization_of({"c": rows.where("ledger_id > 3"), "a": rows.where("ledger_id < 3"), "b": rows.where("ledger_id = 3")}, 10**15)


@query("l13_duplicate_requests", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 20")
def l13(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n > 20")


@query("l14_condition_costs", RES + " SELECT g.ledger_id, count(r.reservation_id) AS requests, count(charged) AS known, CAST(coalesce(sum(coalesce(charged, reserved)), 0) AS BIGINT) AS conservative_nano FROM (SELECT unnest(generate_series(0, 11)) AS ledger_id) g LEFT JOIN r USING (ledger_id) GROUP BY 1")
def l14(spark, d):
    b = events.balances(ledger(spark, d)).select("ledger_id", F.col("reservations").alias("requests"), F.col("settled").alias("known"), "conservative_nano")
    return spark.range(12).select(F.col("id").alias("ledger_id")).join(b, "ledger_id", "left").fillna(0)


@query("a02_equivalence", VIEWS + """, v AS (SELECT run_id, list(row_id ORDER BY row_id) AS ids, list(y ORDER BY row_id) AS ys, list(pred ORDER BY row_id) AS preds, list(coalesce(error, '') ORDER BY row_id) AS errors, list(coalesce(p, []) ORDER BY row_id) AS ps, count(*) AS n FROM pred GROUP BY 1), w AS (SELECT v.*, dataset, train_per_class, seed FROM v JOIN runs USING (run_id))
SELECT b.run_id, a.dataset IS NOT DISTINCT FROM b.dataset AS same_dataset, a.train_per_class IS NOT DISTINCT FROM b.train_per_class AS same_budget, a.seed IS NOT DISTINCT FROM b.seed AS same_seed, a.n = b.n AS same_count, a.ids = b.ids AS same_rows, a.ids = b.ids AND a.ys = b.ys AS same_truths, a.ids = b.ids AND a.preds = b.preds AS same_decisions, a.ids = b.ids AND a.errors = b.errors AS same_errors, a.ids = b.ids AND a.ps = b.ps AS same_probabilities FROM w a, w b WHERE a.run_id = 'base'""")
def a02(spark, d):
    f = score.fingerprints(predictions(spark, d), {"rows": [], "truths": ["y"], "decisions": ["pred"], "errors": ["error"], "probabilities": ["probabilities"]})
    f = f.join(F.broadcast(runs(spark).select("run_id", "dataset", F.col("train_per_class").alias("budget"), "seed")), "run_id").withColumnRenamed("n_rows", "count")
    return audit.equivalence(f, "base", ["dataset", "budget", "seed", "count", "rows", "truths", "decisions", "errors", "probabilities"])


@query("a04_run_checks", LABELED + """, tn AS (SELECT run_id, row_id, label FROM rk, runs WHERE status = 'complete' AND (train_per_class IS NULL OR rank <= train_per_class)), tc AS (SELECT run_id, label, count(*) AS n FROM tn GROUP BY 1, 2), tk AS (SELECT run_id, CAST(sum(n) AS BIGINT) AS n_train, min(n) AS lo, max(n) AS hi, count(*) AS k FROM tc GROUP BY 1),
s AS (SELECT run_id, count(*) = count(DISTINCT row_id) AS unique_rows, bool_and(y BETWEEN 0 AND 3) AS truth_in_range, count(*) FILTER (WHERE row_id IN (SELECT row_id FROM ex WHERE source_split = 'train')) AS in_train FROM pred GROUP BY 1)
SELECT s.*, coalesce(n_train, 0) AS n_train, CASE WHEN train_per_class IS NULL THEN coalesce(n_train, 0) > 0 WHEN train_per_class = 0 THEN n_train IS NULL ELSE coalesce(lo = train_per_class AND hi = train_per_class AND k = 4, false) END AS within_budget FROM s JOIN runs USING (run_id) LEFT JOIN tk USING (run_id)""")
def a04(spark, d):
    train = prep.hash_ranked(examples(spark, d).where("source_split = 'train'"), 42, ["label"])
    r = runs(spark).where("status = 'complete'").select("run_id", "train_per_class")
    # the list of runs is a literal of a few rows
    training = train.select("row_id", "label", "rank").crossJoin(F.broadcast(r)).where("train_per_class is null or rank <= train_per_class")
    return audit.run_checks(predictions(spark, d), training, r, N_CLASSES)


@query("p01_run_table", CONF + f""", {per_class_sql()}, x AS (SELECT run_id, count(*) FILTER (WHERE pred < 0) AS failures, count(p) / count(*) AS covered, count(DISTINCT y) AS labels FROM pred GROUP BY 1)
SELECT run_id, model, arm, seed, CASE WHEN train_per_class IS NULL THEN 'full' WHEN train_per_class = 0 THEN 'zero' ELSE train_per_class || ' per class' END AS budget, status, labels, n_rows, failures, round(covered, 9) AS probability_coverage, CASE WHEN covered IS NULL THEN NULL WHEN covered = 0 THEN 'labels only' ELSE 'probabilities' END AS output, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1, round(balanced_accuracy, 9) AS balanced_accuracy FROM runs LEFT JOIN sc USING (run_id) LEFT JOIN x USING (run_id)""")
def p01(spark, d):
    p = predictions(spark, d)
    s = score.scores(score.confusion(p, N_CLASSES)).select("run_id", "n_rows", "failures", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy")])
    # classes are few, so the distinct count is over a handful of values
    x = p.groupBy("run_id").agg((F.count("probabilities") / F.count("*")).alias("covered"), F.count_distinct("y").alias("labels"))
    budget = F.when(F.col("train_per_class").isNull(), "full").when(F.col("train_per_class") == 0, "zero").otherwise(F.concat(F.col("train_per_class").cast("string"), F.lit(" per class")))
    output = F.when(F.col("covered") == 0, "labels only").when(F.col("covered") > 0, "probabilities")
    return runs(spark).join(s, "run_id", "left").join(x, "run_id", "left").select("run_id", "model", "arm", "seed", budget.alias("budget"), "status", "labels", "n_rows", "failures", F.round("covered", 9).alias("probability_coverage"), output.alias("output"), "accuracy", "macro_f1", "balanced_accuracy")


@query("p03_canonical", VIEWS + ", g AS (SELECT norm, count(*) AS n, min(row_id) AS c FROM ex GROUP BY 1) SELECT row_id, c AS canonical, n AS repetition_count, CASE WHEN row_id <> c THEN c END AS duplicate_of FROM ex JOIN g USING (norm)")
def p03(spark, d):
    ex = prep.without_texts(examples(spark, d), "row_id")
    g = ex.groupBy("norm_sha256").agg(F.count("*").alias("repetition_count"), F.min("row_id").alias("canonical"))
    return ex.join(g, "norm_sha256").select("row_id", "canonical", "repetition_count", F.when(F.col("row_id") != F.col("canonical"), F.col("canonical")).alias("duplicate_of"))


@query("p04_counters", VIEWS + "SELECT arm, count(*) AS runs, CAST(sum(n) AS BIGINT) AS predictions FROM runs LEFT JOIN (SELECT run_id, count(*) AS n FROM pred GROUP BY 1) USING (run_id) GROUP BY 1")
def p04(spark, d):
    n = predictions(spark, d).groupBy("run_id").agg(F.count("*").alias("n"))
    return runs(spark).join(n, "run_id", "left").groupBy("arm").agg(F.count("*").alias("runs"), F.sum("n").alias("predictions"))


SAFE_ERROR = "(/home/|sk-[A-Za-z0-9]{20}|Bearer )"


@query("p05_projection_checks", VIEWS + f""", g AS (SELECT *, {u("'spoil'", "row_id")} AS h FROM pred), b AS (SELECT run_id, CASE WHEN h % 61 = 0 THEN -latency_s - 1 ELSE latency_s END AS latency_s, CASE WHEN h % 67 = 0 THEN 9 ELSE label END AS label, CASE WHEN h % 71 = 0 THEN -1 ELSE input_tokens END AS input_tokens, CASE WHEN h % 73 = 0 THEN 'at /home/x' ELSE error END AS error, p, h FROM g)
SELECT run_id, count(*) FILTER (WHERE NOT (latency_s BETWEEN 0 AND 1e6)) AS bad_latency, count(*) FILTER (WHERE label NOT BETWEEN 0 AND 3) AS bad_label, count(*) FILTER (WHERE input_tokens < 0) AS bad_tokens, count(*) FILTER (WHERE regexp_matches(error, '(/home/|sk-[A-Za-z0-9]{{20}}|Bearer )')) AS unsafe,
count(*) FILTER (WHERE label IS NOT NULL AND error IS NOT NULL) AS label_and_error, count(*) FILTER (WHERE label IS NULL AND error IS NULL) AS neither, count(*) FILTER (WHERE p IS NOT NULL AND h % 79 = 0) AS bad_probabilities, NOT regexp_matches(run_id, '^[A-Za-z0-9_.-]+$') AS bad_id FROM b GROUP BY 1""")
def p05(spark, d):
    """Checks before rows are published, on predictions some of which were spoiled."""
    h = keyed("spoil", F.col("row_id"))
    rows = predictions(spark, d).withColumns({
        "latency_s": F.when(h % 61 == 0, -F.col("latency_s") - 1).otherwise(F.col("latency_s")),
        "label": F.when(h % 67 == 0, 9).otherwise(F.col("label")),
        "input_tokens": F.when(h % 71 == 0, -1).otherwise(F.col("input_tokens")),
        "error": F.when(h % 73 == 0, "at /home/x").otherwise(F.col("error")),
        "probabilities": F.when(h % 79 == 0, F.transform("probabilities", lambda x: x / 2)).otherwise(F.col("probabilities")),
    })
    return audit.projection_violations(rows, N_CLASSES, SAFE_ERROR)


def dashboard(scores, r, metric="accuracy", **filters):
    """Review runs with the metric of their source, their own, and the direct run's of the same model and
    budget; ``filters`` are values of columns of the runs."""
    for name, value in filters.items():
        r = r.where(F.col(name).eqNullSafe(F.lit(value)))
    of = lambda arm: scores.select(F.col("run_id").alias(f"{arm}_run_id"), F.round(metric, 9).alias(f"{arm}_{metric}"))
    direct = r.where("arm = 'direct'").select(F.col("run_id").alias("direct_run_id"), "model", F.col("train_per_class").alias("k"))
    rows = r.where("arm = 'review'").select("model", "train_per_class", F.col("run_id").alias("review_run_id"), "source_run_id").join(direct, "model", "left").where(F.col("k").eqNullSafe(F.col("train_per_class")) | F.col("direct_run_id").isNull())
    for arm in ("source", "direct", "review"):
        rows = rows.join(of(arm), f"{arm}_run_id", "left")
    return rows.select("model", "train_per_class", *[f"{arm}_{metric}" for arm in ("source", "direct", "review")])


@query("p06_dashboard", CONF + f", {per_class_sql()} SELECT r.model, r.train_per_class, round(b.macro_f1, 9) AS source_macro_f1, round(t.macro_f1, 9) AS direct_macro_f1, round(v.macro_f1, 9) AS review_macro_f1 FROM runs r LEFT JOIN runs x ON x.arm = 'direct' AND x.model = r.model AND x.train_per_class IS NOT DISTINCT FROM r.train_per_class LEFT JOIN sc b ON b.run_id = r.source_run_id LEFT JOIN sc v ON v.run_id = r.run_id LEFT JOIN sc t ON t.run_id = x.run_id WHERE r.arm = 'review' AND r.train_per_class = 4")
def p06(spark, d):
    return dashboard(score.scores(score.confusion(predictions(spark, d), N_CLASSES)), runs(spark), "macro_f1", train_per_class=4)


@query("p07_manifest_groups", VIEWS + f""", m AS (SELECT run_id, list((row_id, y) ORDER BY row_id) AS held, count(*) AS n_test FROM (SELECT * FROM pred WHERE NOT (run_id IN ('weak', 'zero') AND {u("'manifest'", "row_id")} % 5 = 0)) GROUP BY 1), g AS (SELECT dataset, held, n_test, min(run_id) AS first, count(*) AS runs, count(DISTINCT coalesce(train_per_class, -1)) = 1 AS equal_training FROM m JOIN runs USING (run_id) GROUP BY 1, 2, 3)
SELECT dataset, dense_rank() OVER (PARTITION BY dataset ORDER BY first) AS group_id, first, runs, n_test, equal_training FROM g""")
def p07(spark, d):
    """Runs grouped by the rows and truths they were tested on; two of them were tested on fewer rows."""
    fewer = F.col("run_id").isin("weak", "zero") & (keyed("manifest", F.col("row_id")) % 5 == 0)
    m = score.fingerprints(predictions(spark, d).where(~fewer), {"manifest": ["y"]}).join(F.broadcast(runs(spark)), "run_id")
    g = m.groupBy("dataset", "manifest", F.col("n_rows").alias("n_test")).agg(F.min("run_id").alias("first"), F.count("*").alias("runs"), (F.count_distinct(F.coalesce("train_per_class", F.lit(-1))) == 1).alias("equal_training"))
    # ranks groups of runs within a dataset
    return g.withColumn("group_id", F.dense_rank().over(Window.partitionBy("dataset").orderBy("first"))).drop("manifest")


@query("p08_datasets", VIEWS + """, t AS (SELECT dataset, run_id, count(DISTINCT y) AS labels, count(*) AS n_test FROM pred JOIN runs USING (run_id) GROUP BY 1, 2)
SELECT dataset, count(*) AS runs, max(labels) AS labels, max(n_test) AS n_test, min(labels) = max(labels) AND min(n_test) = max(n_test) AS consistent FROM t GROUP BY 1""")
def p08(spark, d):
    t = predictions(spark, d).join(F.broadcast(runs(spark).select("run_id", "dataset")), "run_id").groupBy("dataset", "run_id").agg(F.count_distinct("y").alias("labels"), F.count("*").alias("n_test"))
    same = (F.min("labels") == F.max("labels")) & (F.min("n_test") == F.max("n_test"))
    return t.groupBy("dataset").agg(F.count("*").alias("runs"), F.max("labels").alias("labels"), F.max("n_test").alias("n_test"), same.alias("consistent"))


@query("t01_resume", "SELECT event_id, user_id FROM events WHERE event_id % 4 <> 0")
def t01(spark, d):
    done = table(spark, d, "events").where("event_id % 4 = 0").select("event_id")
    return streams.resume(streams.source(spark, d, "events"), done, "event_id", time="ts", within="3650 days").select("event_id", "user_id")


@query("t03_halts", "WITH l AS (SELECT user_id, event_id, event_type, lag(event_type, 1) OVER w AS e1, lag(event_type, 2) OVER w AS e2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, min(event_id) AS halted_at FROM l WHERE event_type = 'error' AND e1 = 'error' AND e2 = 'error' GROUP BY 1")
def t03(spark, d):
    return streams.halts(streams.source(spark, d, "events"), "user_id", "event_id", "event_type", "error")


@query("t05_progress", "SELECT user_id % 8 AS cohort, count(*) FILTER (WHERE event_type <> 'error') AS saved, count(*) AS expected, count(*) FILTER (WHERE event_type = 'error') = 0 AS complete FROM events GROUP BY 1")
def t05(spark, d):
    cohort = (F.col("user_id") % 8).alias("cohort")
    expected = table(spark, d, "events").groupBy(cohort).agg(F.count("*").alias("expected"))
    saved = streams.source(spark, d, "events").where("event_type <> 'error'").select(cohort)
    return streams.progress(saved, "cohort", expected)


@query("t02_ledger_machine", RES + " SELECT ledger_id, count(*) AS admitted, 0::BIGINT AS refused, count(charged) AS settled, 0::BIGINT AS violations, CAST(sum(coalesce(charged, 0)) + sum(CASE WHEN charged IS NULL THEN reserved ELSE 0 END) AS BIGINT) AS balance_nano FROM r GROUP BY 1")
def t02(spark, d):
    """A cap that refuses nothing: the replayed balance equals the batch balance."""
    path = shared_folder(spark, "ledger-events")
    ledger(spark, d).write.parquet(path)
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = streams.ledger_machine(rows, 10**18)
    return _machine_counts(out)


def _machine_counts(out):
    n = lambda k: F.count_if(F.col("status") == k)
    return out.groupBy("ledger_id").agg(n("admitted").alias("admitted"), n("refused").alias("refused"), n("settled").alias("settled"), n("violation").alias("violations"), F.max_by("balance_nano", "seq").alias("balance_nano"))


CAPPED = RES + """, cap AS (SELECT CAST(floor(sum(coalesce(charged, reserved)) * 6 / (10 * count(DISTINCT ledger_id))) AS BIGINT) AS cap FROM r),
run AS (SELECT l.*, sum(CASE l.type WHEN 'reserve' THEN l.reserved_nano WHEN 'settle' THEN l.charged_nano - r.reserved ELSE 0 END) OVER (PARTITION BY l.ledger_id ORDER BY l.seq) AS balance FROM ledger l JOIN r ON l.ledger_id = r.ledger_id AND l.reservation_id = r.reservation_id),
stop AS (SELECT ledger_id, min(seq) AS breach FROM run, cap WHERE type = 'reserve' AND balance > cap GROUP BY 1),
own AS (SELECT l.ledger_id, l.reservation_id, min(CASE WHEN type = 'reserve' THEN seq END) < coalesce(any_value(breach), 9223372036854775807) AS ok FROM ledger l LEFT JOIN stop USING (ledger_id) GROUP BY 1, 2)"""


@query("t02_ledger_capped", CAPPED + """ SELECT l.ledger_id, count(*) FILTER (type = 'reserve' AND ok) AS admitted, count(*) FILTER (type = 'reserve' AND NOT ok) AS refused, count(*) FILTER (type = 'settle' AND ok) AS settled,
count(*) FILTER (type <> 'reserve' AND NOT ok) AS violations, CAST(sum(CASE WHEN NOT ok THEN 0 WHEN type = 'reserve' THEN reserved_nano WHEN type = 'settle' THEN charged_nano - reserved ELSE 0 END) AS BIGINT) AS balance_nano
FROM ledger l JOIN own USING (ledger_id, reservation_id) JOIN r USING (ledger_id, reservation_id) GROUP BY 1""")
def t02_capped(spark, d):
    """A cap of 0.6 times the ledgers' mean final balance: the first reserve over it stops its ledger."""
    path = shared_folder(spark, "ledger-events")
    ledger(spark, d).write.parquet(path)
    saved = spark.read.parquet(path)
    per = events.balances(saved).agg(F.sum("conservative_nano").alias("s"), F.count("*").alias("n")).first()
    out = streams.ledger_machine(spark.readStream.schema(saved.schema).parquet(path), int(per.s) * 6 // (10 * per.n), stop_at_cap=True)
    return _machine_counts(out)


@query("t03_billing_stop", """WITH e AS (SELECT user_id, event_id, event_type, value >= 50 AND event_type = 'error' AS billing FROM events),
l AS (SELECT *, lag(event_type, 1) OVER w AS e1, lag(event_type, 2) OVER w AS e2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, min(event_id) AS halted_at FROM l WHERE billing OR (event_type = 'error' AND e1 = 'error' AND e2 = 'error') GROUP BY 1""")
def t03_billing(spark, d):
    """Errors of a value from 50 on stand for a billing error: one stops at once, others stop as three in a row."""
    e = streams.source(spark, d, "events")
    kind = F.when((F.col("event_type") == "error") & (F.col("value") >= 50), "billing").otherwise(F.col("event_type"))
    return streams.halts(e.withColumn("kind", kind), "user_id", "event_id", "kind", "error", stop="billing")


@query("t04_unreconciled", "SELECT event_id, CASE WHEN event_type = 'signup' THEN 'no_result' WHEN event_id % 9 = 0 THEN 'no_prediction' ELSE 'answered' END AS status FROM events")
def t04_unreconciled(spark, d):
    """Each event is a reserve; all but signups have a result, all results but each ninth event's a saved
    prediction. Two last events far ahead let the watermarks pass all others."""
    path = shared_folder(spark, "reconciled")
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "signup").alias("answered"), (F.col("event_id") % 9 != 0).alias("saved"))
    e.write.parquet(f"{path}/a")
    for k, days in (("b", 30), ("c", 60)):
        last = e.agg((F.max("ts") + F.expr(f"interval {days} days")).alias("ts"))
        last.select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(True).alias("answered"), F.lit(True).alias("saved")).write.parquet(f"{path}/{k}")
    rows = lambda: spark.readStream.schema(e.schema).parquet(f"{path}/*")
    out = streams.unreconciled(rows(), rows().where("answered"), rows().where("answered and saved"), "event_id", "ts")
    return out.where("event_id >= 0").select("event_id", "status")


@query("t04_open_reservations", "SELECT event_id FROM events WHERE event_type = 'signup'")
def t04(spark, d):
    """Reserves whose event brings no result; a last event far ahead lets the watermarks pass all others."""
    path = shared_folder(spark, "reservations")
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "signup").alias("answered"))
    e.write.parquet(f"{path}/a")
    last = F.max("ts") + F.expr("interval 30 days")
    e.agg(last.alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(True).alias("answered")).write.parquet(f"{path}/b")
    rows = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}/*")
    out = streams.open_reservations(rows(), rows().where("answered"), "event_id", "ts")
    return out.where("event_id >= 0").select("event_id")
