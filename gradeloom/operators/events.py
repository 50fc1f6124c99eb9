"""Attempt recovery and spend ledgers over append-only event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import running_total

NANO = 1_000_000_000


def attempt_views(original: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per (run_id, row_id): original, first actual and recovered label. The original is attempt 0; the
    recovered one is the earliest success, else the last failure."""
    both = original.withColumn("attempt_index", F.lit(0)).select("run_id", "row_id", "attempt_index", "label").unionByName(attempts.select("run_id", "row_id", "attempt_index", "label"))
    i, ok = F.col("attempt_index"), F.col("label").isNotNull()
    return both.groupBy("run_id", "row_id").agg(F.min_by("label", i).alias("original"), F.min_by("label", F.when(i > 0, i)).alias("first_retry"), F.min_by("label", F.when(ok, i)).alias("recovered"), (F.count("*") - 1).alias("extra_attempts"))


def attempt_violations(attempts: DataFrame, most: int = 2) -> DataFrame:
    """(rule, n): gaps in the order, attempts after a success, too many attempts."""
    w = Window.partitionBy("run_id", "row_id").orderBy("attempt_index")
    rows = attempts.withColumns({"place": F.row_number().over(w), "before": F.lag("label").over(w)})
    s = rows.agg(F.count_if(F.col("place") != F.col("attempt_index")).alias("order"), F.count_if(F.col("before").isNotNull()).alias("after_success"), F.count_if(F.col("attempt_index") > most).alias("too_many"))
    return s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in s.columns])))


def first_breaks(original: DataFrame, attempts: DataFrame, most: int = 2) -> DataFrame:
    """(run_id, row_id, rule, at): for every row whose attempts break a rule, the first rule broken and the place in
    its history (1 is the first attempt). ``original(run_id, row_id, stage, label, prompt)`` says how the row came to
    be open: attempted, upstream_not_called or not_attempted; ``attempts`` have attempt_index, stage, label and
    prompt. A row's attempts in order run through a small automaton: identity, unknown_row, on_success, order (consecutive
    from 1), stage (a retry after a call, else a first call), after_success, too_many, and at the end unfinished
    (failed with attempts left). Only the first ``most`` + 1 attempts of a row are gathered, as one more than
    ``most`` always breaks a rule."""
    w = Window.partitionBy("run_id", "row_id").orderBy("attempt_index", "stage")
    some = attempts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most + 1)
    listed = some.groupBy("run_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("place", "attempt_index", "stage", F.col("label").isNotNull().alias("ok"), "prompt"))).alias("tries"))
    first = original.select("run_id", "row_id", F.col("stage").alias("origin"), F.col("label").isNotNull().alias("answered"), F.col("prompt").alias("asked"))
    rows = first.join(listed, ["run_id", "row_id"], "full_outer").withColumn("tries", F.coalesce("tries", F.array().cast("array<struct<place:int,attempt_index:int,stage:string,ok:boolean,prompt:string>>")))
    start = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("at"))

    def step(state, t):
        due = F.when((t["place"] > 1) | (F.col("origin") == "attempted"), "retry").when(F.col("origin") == "upstream_not_called", "dependent_first_call").otherwise("first_attempt")
        rule = (
            F.when(F.col("origin").isNull(), "unknown_row")
            .when(F.col("answered"), "on_success")
            .when(~t["prompt"].eqNullSafe(F.col("asked")), "identity")
            .when(~t["attempt_index"].eqNullSafe(t["place"]), "order")
            .when(state["ok"], "after_success")
            .when(t["place"] > most, "too_many")
            .when(~t["stage"].eqNullSafe(due), "stage")
        )
        broken = state["rule"].isNotNull()
        return F.struct((state["ok"] | t["ok"]).alias("ok"), F.coalesce(state["rule"], rule).alias("rule"), F.when(broken, state["at"]).otherwise(t["place"]).alias("at"))

    end = rows.select("run_id", "row_id", F.coalesce("answered", F.lit(True)).alias("answered"), F.size("tries").alias("n"), F.aggregate("tries", start, step).alias("end"))
    open_ = ~F.col("answered") & ~F.col("end.ok") & (F.col("n") < most)
    rule = F.coalesce(F.col("end.rule"), F.when(open_, "unfinished"))
    return end.select("run_id", "row_id", rule.alias("rule"), F.when(F.col("end.rule").isNotNull(), F.col("end.at")).otherwise(F.col("n") + 1).alias("at")).where("rule is not null")


def halts(rows: DataFrame, by: str, order: str, error: str, streak: int = 3) -> DataFrame:
    """Per group, the first place where a billing error or ``streak`` errors in a row stop it."""
    w = Window.partitionBy(by).orderBy(order)
    stop = F.col(error).contains("status=402")
    run = F.col(error).isNotNull()
    for k in range(1, streak):
        run = run & F.lag(F.col(error), k).over(w).isNotNull()
    return rows.withColumn("stop", F.coalesce(stop, F.lit(False)) | run).where("stop").groupBy(by).agg(F.min(order).alias("halted_at"))


def chain_violations(chain: DataFrame) -> DataFrame:
    """Per ledger: events whose link to the event before them, or whose own hash, does not hold. A self
    join on seq - 1, so no ledger needs one task."""
    before = chain.select("ledger_id", (F.col("seq") + 1).alias("seq"), F.col("event_sha256").alias("expected"))
    rows = chain.join(before, ["ledger_id", "seq"], "left")
    link = F.coalesce(F.col("expected"), F.lit("")) != F.col("previous_sha256")
    own = F.sha2("payload", 256) != F.col("event_sha256")
    return rows.groupBy("ledger_id").agg(F.count_if(link).alias("broken_links"), F.count_if(own).alias("wrong_hashes"), F.count("*").alias("n"))


def reservations(ledger: DataFrame) -> DataFrame:
    """One row per reservation: what it reserved, its outcome, what it was charged."""
    t = F.col("type")
    n = lambda k: F.count_if(t == k).alias(f"n_{k}")
    return ledger.groupBy("ledger_id", "reservation_id").agg(F.max("reserved_nano").alias("reserved_nano"), F.max("charged_nano").alias("charged_nano"), F.max("outcome").alias("outcome"), n("reserve"), n("result"), n("settle"))


def reconcile_status() -> Column:
    return (
        F.when(F.col("n_reserve") > 1, "duplicate")
        .when(F.col("n_reserve") == 0, "no_reserve")
        .when(F.col("n_result") == 0, "no_result")
        .when(F.col("charged_nano") > F.col("reserved_nano"), "overcharged")
        .when(F.col("n_settle") == 0, "retained")
        .otherwise("settled")
    )


def reconcile(ledger: DataFrame, answers: DataFrame) -> DataFrame:
    """(ledger_id, reservation_id, status): reservations against the saved predictions that name them, rows of
    ``answers`` (ledger_id, reservation_id, told_nano), one for each."""
    told = answers.groupBy("ledger_id", "reservation_id").agg(F.count("*").alias("n_told"), F.max("told_nano").alias("told_nano"))
    both = reservations(ledger).join(told, ["ledger_id", "reservation_id"], "full_outer")
    status = (
        F.when(F.coalesce("n_reserve", F.lit(0)) == 0, "no_reserve")
        .when(F.col("n_result") == 0, "no_result")
        .when(F.col("n_told").isNull(), "no_prediction")
        .when(F.col("n_told") > 1, "duplicate_prediction")
        .when(F.col("charged_nano") > F.col("reserved_nano"), "overcharged")
        .when(~F.col("charged_nano").eqNullSafe(F.col("told_nano")), "amount_mismatch")
        .otherwise(reconcile_status())
    )
    return both.select("ledger_id", "reservation_id", status.alias("status"))


def authorization(balances: DataFrame, stage: Column, cap_nano: int) -> DataFrame:
    """Per stage: counted spend of its ledgers, the sum up to it, and what is left of the authorization."""
    per = balances.groupBy(stage.alias("stage")).agg(F.sum("conservative_nano").alias("counted_nano"), F.count("*").alias("ledgers"))
    # a row per stage
    upto = F.sum("counted_nano").over(Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("cumulative_nano", upto).withColumn("remaining_nano", F.lit(cap_nano) - F.col("cumulative_nano"))


def authorization_of(ledgers: dict[str, DataFrame], cap_nano: int) -> DataFrame:
    """``authorization`` over several ledger tables, a stage each, in order of their names. A ledger that two of the
    tables hold would be counted twice: that is an error."""
    parts = [balances(ledger).withColumn("stage", F.lit(name)) for name, ledger in sorted(ledgers.items())]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    twice = rows.groupBy("ledger_id").agg(F.count("*").alias("n")).where("n > 1").orderBy("ledger_id").head(1)
    if twice:
        raise ValueError(f"ledger {twice[0]['ledger_id']} is in more than one table")
    return authorization(rows, F.col("stage"), cap_nano)


def balances(ledger: DataFrame) -> DataFrame:
    """Per ledger: reserved, charged (retained reservations in full) and counts."""
    r = reservations(ledger)
    return r.groupBy("ledger_id").agg(F.count("*").alias("reservations"), F.sum("reserved_nano").alias("reserved_nano"), F.sum(F.coalesce("charged_nano", "reserved_nano")).alias("conservative_nano"), F.sum(F.coalesce("charged_nano", F.lit(0))).alias("known_nano"), F.count("charged_nano").alias("settled"))


def first_breach(ledger: DataFrame, cap_nano: int) -> DataFrame:
    """Per ledger, the first reserve that would lift the running balance over the cap."""
    delta = F.when(F.col("type") == "reserve", F.col("reserved_nano")).when(F.col("type") == "settle", F.col("charged_nano") - F.col("held")).otherwise(0)
    held = ledger.where("type = 'reserve'").select("ledger_id", "reservation_id", F.col("reserved_nano").alias("held"))
    rows = ledger.join(held, ["ledger_id", "reservation_id"], "left").withColumn("delta", F.coalesce(delta, F.lit(0)))
    rows = running_total(rows, ["ledger_id"], F.floor(F.col("seq") / 4096), ["seq"], "delta", "before")
    return rows.where((F.col("type") == "reserve") & (F.col("before") + F.col("reserved_nano") > cap_nano)).groupBy("ledger_id").agg(F.min("seq").alias("seq"))
