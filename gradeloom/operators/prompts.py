"""Serialization, prompts and control plans."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prep import seeded
from .rank import hash_bucket, ranked


@F.pandas_udf(T.StringType())
def _twelve_digits(values):
    return values.map(lambda v: None if v != v else format(v, ".12g"))


def number_text(v: Column) -> Column:
    """The number with up to 12 digits; plain numbers stay in the JVM, others take an Arrow function. Zero has no sign."""
    v = F.when(v == 0, F.lit(0.0)).otherwise(v)
    plain = (v == 0) | F.abs(v).between(1e-3, 9_999_999.0)
    short = F.length(F.regexp_replace(v.cast("string"), "[^0-9]", "")) <= 12
    return F.when(plain & short, F.regexp_replace(v.cast("string"), r"\.0$", "")).otherwise(_twelve_digits(v))


def lossless(rows: DataFrame, text: str, value: str) -> DataFrame:
    """(mismatches, n_rows): rows whose number does not come back from its text; "NA" stands for a missing one."""
    return rows.agg(F.count_if(~F.expr(f"try_cast({text} as double) <=> {value}")).cast("int").alias("mismatches"), F.count("*").alias("n_rows"))


def parity(native: DataFrame, written: DataFrame) -> DataFrame:
    """Per split, rows that are the same in a native table (split, row_id, label, acctbal) and a serialized one (split,
    row_id, label, text of the number), and rows that differ or are on one side only."""
    b = written.select("split", "row_id", F.col("label").alias("l2"), F.col("text").alias("t2"), F.lit(True).alias("found"))
    both = native.withColumn("there", F.lit(True)).join(b, ["split", "row_id"], "full_outer")
    same = F.coalesce(F.col("found") & F.col("there"), F.lit(False)) & F.col("label").eqNullSafe(F.col("l2")) & F.expr("try_cast(t2 as double) <=> acctbal")
    return both.groupBy("split").agg(F.count_if(same).alias("same"), F.count_if(~same).cast("int").alias("different"))


def serialize(features: list[tuple[str, str]], task: str) -> Column:
    """'task', a line break, then name=value pairs in declared order; NA for missing values."""
    parts = []
    for name, kind in features:
        value = number_text(F.col(name)) if kind == "numeric" else F.concat(F.lit('"'), F.regexp_replace(F.col(name), r'(["\\])', r"\\$1"), F.lit('"'))
        parts.append(F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit("NA"))))
    return F.concat(F.lit(task + "\n"), F.concat_ws("; ", *parts))


def _quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"^\{\"v\":(.*)\}$", 1)


def _demo_head(demos: DataFrame) -> DataFrame:
    """The demonstrations (k per class) as one text, a line each."""
    line = F.concat(F.lit('{"text":'), _quoted(F.col("norm")), F.lit(',"label":'), F.col("label").cast("string"), F.lit("}"))
    head = demos.select(F.struct("label", "rank", line.alias("line")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return head.select(F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("head"))


def build_prompts(rows: DataFrame, demos: DataFrame, labels: list[str], instruction: str) -> DataFrame:
    """``rows`` with ``prompt``: the instruction, the class map, a line per demonstration, then the row's own text.
    Texts are whole; a row never comes with its own demonstration, and its label is not used."""
    classes = json.dumps({str(k): v for k, v in enumerate(labels)}, separators=(",", ":"), ensure_ascii=False)
    own = F.concat(F.lit('{"text":'), _quoted(F.col("norm")), F.lit("}"))
    rows = rows.join(F.broadcast(demos.select("row_id")), "row_id", "left_anti")
    return rows.crossJoin(F.broadcast(_demo_head(demos))).withColumn("prompt", F.concat_ws("\n", F.lit(instruction), F.lit(classes), "head", own)).drop("head")


def proposal_slot(proposal: Column) -> Column:
    """The sentence that names the proposed class; without one the slot says so."""
    return F.concat(F.lit("Proposed class: "), F.coalesce(proposal.cast("string"), F.lit("none")))


def review_prompts(source: DataFrame, prompts: DataFrame) -> DataFrame:
    """The classification prompt with the proposed class; rows whose source failed keep an error instead."""
    ok = F.col("pred") >= 0
    both = source.select("row_id", "pred").join(prompts.select("row_id", "prompt"), "row_id")
    return both.select("row_id", F.when(ok, F.concat_ws("\n", "prompt", proposal_slot(F.col("pred")))).alias("prompt"), F.when(~ok, "source_proposal_failed").alias("error"))


def control_prompts(plan: DataFrame, prompts: DataFrame, closing: str = "Answer with the class number.") -> DataFrame:
    """``plan`` with ``prompt``, and its parts before and behind the slot as cut from the prompt itself."""
    rows = plan.join(prompts.select("row_id", F.col("prompt").alias("base")), "row_id").withColumn("prompt", F.concat_ws("\n", "base", proposal_slot(F.col("proposal")), F.lit(closing)))
    at = F.length("prompt") - F.length(F.substring_index("prompt", "\nProposed class: ", -1))
    return rows.withColumns({"before": F.substr(F.col("prompt"), F.lit(1), at), "behind": F.substring_index("prompt", "\n", -1)}).drop("base")


def donors(cases: DataFrame) -> DataFrame:
    """A single-cycle derangement: every case gets the prediction of the next one in hash order."""
    h = seeded("donor", F.col("row_id"))
    order = ranked(cases.select("row_id", "pred", h.alias("h")), [], hash_bucket(F.col("h")), ["h", "row_id"], "r").drop("h")
    n = cases.agg(F.count("*").alias("n"))
    nxt = order.select((F.col("r")).alias("at"), F.col("row_id").alias("donor_row_id"), F.col("pred").alias("donor_pred"))
    return order.crossJoin(F.broadcast(n)).withColumn("at", F.col("r") % F.col("n") + 1).join(nxt, "at").drop("at", "r", "n")


def control_plan(cases: DataFrame, repeats: int) -> DataFrame:
    """Requests per case and arm, ``repeats`` repeated cases, and a hash order of execution."""
    given = donors(cases)
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), p.cast("int").alias("proposal")) for a, p in (("actual", F.col("pred")), ("no_proposal", F.lit(None)), ("shuffled", F.col("donor_pred")))])).alias("x")
    plan = given.select("row_id", arms).select("row_id", "x.*", F.lit(0).alias("is_repeat"))
    if repeats:
        again = given.orderBy(seeded("repeat", F.col("row_id")), "row_id").limit(repeats)
        plan = plan.union(again.select("row_id", F.lit("actual"), F.col("pred"), F.lit(1)))
    h = seeded("run", F.concat_ws(":", "row_id", "arm", "is_repeat"))
    plan = ranked(plan.withColumn("h", h), [], hash_bucket(F.col("h")), ["h"], "r")
    return plan.select("row_id", "arm", "proposal", "is_repeat", (F.col("r") - 1).alias("execution_index"))


def matrix(spark: SparkSession, models: list[str], shots: list[int], seeds: list[int]) -> DataFrame:
    """Models x shots x seeds; zero shots only at seed 42."""
    dims = [spark.range(1).select(F.explode(F.array(*map(F.lit, v))).alias(n)) for n, v in (("model", models), ("shots", shots), ("seed", seeds))]
    return reduce(DataFrame.crossJoin, dims).where("shots > 0 or seed = 42")
