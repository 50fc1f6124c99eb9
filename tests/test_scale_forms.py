"""Forms meant for large tables: balanced buckets, draws of large counts, deep manifests, attempt histories."""

import json
import math
import random
from itertools import combinations
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import draws
from gradeloom.operators import audit, contrast, control, events, rank, score


def crowded(spark, kind):
    rng = random.Random(2)
    value = {"near one": lambda: 1 - rng.random() * 0.01 if rng.random() < 0.9 else rng.random(), "at one": lambda: 1.0 if rng.random() < 0.9 else rng.random(), "few": lambda: rng.choice([0.25, 0.5, 0.5, 0.5])}[kind]
    rows = spark.createDataFrame([(k, value()) for k in range(20_000)], "k long, v double")
    return rows.withColumn("h", F.sha2(F.col("k").cast("string"), 256))


@pytest.mark.parametrize("kind", ["near one", "at one", "few"])
def test_buckets_are_even_and_in_order(spark, kind):
    rows, bucket = rank.balanced(crowded(spark, kind), "v", "h", 800)
    got = rows.select("v", "h", bucket.alias("b")).collect()
    sizes = {}
    for r in got:
        sizes[r.b] = sizes.get(r.b, 0) + 1
    assert len(sizes) >= 20 and max(sizes.values()) <= 2 * median(sizes.values())
    order = [r.b for r in sorted(got, key=lambda r: (r.v, r.h))]
    assert order == sorted(order)


def test_ranks_over_balanced_buckets(spark):
    data = crowded(spark, "at one")
    rows, bucket = rank.balanced(data, "v", "h", 700)
    got = {r.k: r.rank for r in rank.ranked(rows, [], bucket, ["v", "h"]).select("k", "rank").collect()}
    assert got == {r.k: n for n, r in enumerate(sorted(data.collect(), key=lambda r: (r.v, r.h)), 1)}


def test_quantiles_and_auc_over_many_buckets(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.random(300), np.full(200, 0.5), 1 - rng.random(1500) * 0.01])
    hit = (rng.random(len(v)) < v).astype(int)
    rows = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(v, hit, strict=True)] + [("o", 0.3, 1), ("o", 0.3, 0)], "g string, score double, hit int")
    plain, bucket_rows = rank.balanced, 64
    for module in (rank, score):
        monkeypatch.setattr(module, "balanced", lambda df, value, digest=None: plain(df, value, digest, bucket_rows))
    got = {r.g: r for r in rank.quantiles(rows, ["g"], "score", {"a": 0.025, "b": 0.5, "c": 0.9}).collect()}
    assert np.allclose([got["g"].a, got["g"].b, got["g"].c], np.quantile(v, [0.025, 0.5, 0.9])) and got["o"].b == 0.3
    pairs = (v[hit == 1][:, None] > v[hit == 0]).mean() + 0.5 * (v[hit == 1][:, None] == v[hit == 0]).mean()
    auc = {r.g: r.auc for r in score.ranking_quality(rows, ["g"]).collect()}
    assert abs(auc["g"] - pairs) < 1e-9 and auc["o"] == 0.5


def test_hypergeometric_against_enumeration():
    rng = np.random.default_rng(4)
    for good, bad, m in ((3, 4, 5), (1, 9, 4), (20, 5, 12), (7, 7, 0), (7, 0, 3), (40, 60, 50)):
        got = np.bincount(draws.hypergeometric(rng, np.full(40_000, good), bad, m), minlength=good + 1) / 40_000
        want = np.array([math.comb(good, x) * math.comb(bad, m - x) / math.comb(good + bad, m) if m >= x else 0 for x in range(good + 1)])
        assert np.abs(got - want).max() < 0.012
    # all subsets of a small table, cell by cell
    colours, m = [2, 1, 3], 3
    items = [c for c, n in enumerate(colours) for _ in range(n)]
    want = {}
    for s in combinations(range(6), m):
        cell = tuple(sum(items[k] == c for k in s) for c in range(3))
        want[cell] = want.get(cell, 0) + 1 / math.comb(6, m)
    got, counts = np.unique(draws.multivariate_hypergeometric(rng, np.array(colours), m, 40_000), axis=0, return_counts=True)
    assert {tuple(c) for c in got.tolist()} == set(want) and all(abs(n / 40_000 - want[tuple(c)]) < 0.01 for c, n in zip(got.tolist(), counts, strict=True))


def test_hypergeometric_of_large_counts():
    rng = np.random.default_rng(5)
    for good, bad, m in ((3 * 10**12, 7 * 10**12, 10**12), (10**10, 10**15, 10**13), (5, 10**12, 4 * 10**11), (10**9, 10**9, 10**9)):
        x, total = draws.hypergeometric(rng, np.full(20_000, good), bad, m), good + bad
        mean = m * good / total
        sd = math.sqrt(m * (good / total) * (bad / total) * (total - m) / (total - 1))
        assert abs(x.mean() - mean) < 5 * sd / 20_000**0.5 and abs(x.std() / sd - 1) < 0.04 and x.min() >= 0 and x.max() <= good
    take = draws.multivariate_hypergeometric(rng, np.array([10**12, 0, 5 * 10**11, 3]), 10**11, 500)
    assert (take.sum(axis=1) == 10**11).all() and (take[:, 1] == 0).all()


def test_random_macro_f1_of_many_rows(spark, monkeypatch):
    cells = [(0, 0, 1, 4 * 10**9), (0, 1, 0, 10**9), (1, 1, 1, 3 * 10**9), (1, 0, -1, 10**9)]
    rows = spark.createDataFrame(cells, "y int, a int, b int, n long")

    class Cells:
        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return rows

    monkeypatch.setattr(contrast, "paired", lambda *_: Cells())
    got = {r.rate: r for r in contrast.random_macro_f1(rows, "a", "b", 2, draws=300).collect()}
    assert got[0].samples == got[100].samples == 0 and got[50].samples == 300
    assert all(abs(r.macro_f1 - r.plug_in) < 1e-5 and r.se < 1e-5 for r in got.values())


def test_leaves_of_any_manifest(spark):
    deep = {"x": 1}
    for k in range(20):
        deep = {f"k{k % 3}": [None, deep]} if k % 2 else {"o": deep}
    texts = [json.dumps(deep), '{"a":{},"b":[],"c":null,"d e":"1","f":1,"g":[[1,[2]],"x"],"t":true}', '"just text"', "7", "not json", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, m string")
    got = {}
    for r in audit.leaves(rows, "id", "m").collect():
        got.setdefault(r.id, {})[r.path] = r.value

    def walk(path, v):
        if isinstance(v, dict) and v:
            for k, x in v.items():
                yield from walk(path + (f".{k}" if " " not in k else f'[{{"k":"{k}"}}]'), x)
        elif isinstance(v, list) and v:
            for k, x in enumerate(v):
                yield from walk(f"{path}[{k}]", x)
        else:
            yield path, json.dumps(v, separators=(",", ":"))

    for k in (0, 1, 2, 3):
        assert got[k] == dict(walk("$", json.loads(texts[k])))
    assert list(got[4]) == ["$"] and "not json" in got[4]["$"] and got[5] == {"$": None}
    one = spark.createDataFrame([(1, '{"n":1}'), (2, json.dumps(deep))], "id int, m string")
    other = spark.createDataFrame([(1, '{"n":"1"}'), (2, json.dumps(deep).replace('{"x": 1}', '{"x": 2}'))], "id int, m string")
    found = {(r.id, r.status) for r in audit.manifest_diff(one, other, "id", "m", []).collect()}
    assert found == {(1, "changed"), (2, "changed")}


def test_only_manifests_that_differ_are_opened(spark, monkeypatch):
    left = [(1, '{"a":[1,2]}'), (1, '{"a":[1,2]}'), (2, '{"a":1}'), (3, None), (4, None), (5, '{"a":1}'), (6, '{"a":1}'), (None, "1")]
    right = [(1, '{"a":[1,2]}'), (2, '{"a":2}'), (3, None), (4, "2"), (6, '{"a":1}'), (6, '{"b":1}'), (None, "1"), (7, "7")]
    one, other = (spark.createDataFrame(x, "id int, m string") for x in (left, right))
    opened, real = [], audit.leaves
    monkeypatch.setattr(audit, "leaves", lambda rows, *a: opened.append({r.id for r in rows.collect()}) or real(rows, *a))
    found = sorted(((r.id, r.path, r.status) for r in audit.manifest_diff(one, other, "id", "m", []).collect()), key=str)
    assert opened == [{2, 4, 5, 6, None}, {2, 4, 6, 7, None}]
    assert found == [(2, "$.a", "changed"), (4, "$", "changed"), (5, "$.a", "missing"), (6, "$.b", "added"), (7, "$", "added"), (None, "$", "added"), (None, "$", "missing")]


def test_first_break_of_each_rule(spark):
    origin = {"plain": "attempted", "skipped": "upstream_not_called", "new": "not_attempted", "answered": "attempted", **{r: "attempted" for r in ("identity", "order", "twice", "stage", "after_success", "too_many", "unfinished", "none")}}
    original = [("r", k, s, 1 if k == "answered" else None, "p") for k, s in origin.items()]
    t = lambda row, index, stage="retry", label=None, prompt="p": ("r", row, index, stage, label, prompt)
    attempts = [
        t("plain", 1), t("plain", 2), t("skipped", 1, "dependent_first_call", 0), t("new", 1, "first_attempt"), t("new", 2, "retry", 3), t("answered", 1), t("identity", 1), t("identity", 2, prompt="q"),
        t("order", 2), t("twice", 1), t("twice", 1), t("stage", 1), t("stage", 2, "first_attempt"), t("after_success", 1, label=0), t("after_success", 2), t("unfinished", 1), t("unknown_row", 1),
    ] + [t("too_many", k) for k in range(1, 9)]
    schema = "run_id string, row_id string, {} string, label int, prompt string"
    got = {r.row_id: (r.rule, r["at"]) for r in events.first_breaks(spark.createDataFrame(original, schema.format("stage")), spark.createDataFrame(attempts, "run_id string, row_id string, attempt_index int, stage string, label int, prompt string")).collect()}
    assert got == {"answered": ("on_success", 1), "identity": ("identity", 2), "order": ("order", 1), "twice": ("order", 2), "stage": ("stage", 2), "after_success": ("after_success", 2), "too_many": ("too_many", 3), "unfinished": ("unfinished", 2), "none": ("unfinished", 1), "unknown_row": ("unknown_row", 1)}


def test_arms_without_a_class_have_no_balanced_accuracy(spark):
    rows = spark.createDataFrame([(k, arm, k % 2, k % 2) for k in range(4) for arm in ("x", "z")], "case_id long, arm string, y int, pred int")
    expected = spark.createDataFrame([("x", 4), ("z", 4)], "arm string, n_expected long")
    two, three = (control.arm_contrasts(rows, expected, [("x", "z")], n).first() for n in (2, 3))
    assert two.delta_balanced_accuracy == 0 and three.delta_balanced_accuracy is None and three.delta_accuracy == 0


def test_repeats_by_side_and_dataset(spark):
    schema = "dataset string, case_id long, pred int, model string"
    first = [("d", 1, 0, "m"), ("d", 2, -1, "m"), ("d", 3, 1, "m"), ("d", 4, -1, "m"), ("e", 1, 0, "m")]
    again = [("d", 1, 0, "m"), ("d", 2, 1, "m"), ("d", 3, -1, "n"), ("d", 4, -1, "m"), ("e", 1, 1, "m")]
    expected = spark.createDataFrame([("d", 4), ("e", 2), ("f", 1)], "dataset string, expected long")
    got = {r.dataset: r for r in control.repeat_diagnostic(spark.createDataFrame(first, schema), spark.createDataFrame(again, schema), expected).collect()}
    d = got["d"]
    assert (d.status, d.agree, d.disagree, d.both_failed, d.reference_failed, d.repeat_failed, d.model_mismatch) == ("complete", 1, 0, 1, 1, 1, 1)
    assert (got["e"].status, got["e"].pairs, got["e"].disagree) == ("pending", 1, None) and (got["f"].status, got["f"].pairs) == ("pending", 0)


def test_a_ledger_counts_in_one_table_only(spark):
    from gradeloom.operators import events

    row = lambda ledger, key, kind, reserved, charged: (ledger, key, kind, reserved, charged, None)
    schema = "ledger_id long, reservation_id long, type string, reserved_nano long, charged_nano long, outcome string"
    a = spark.createDataFrame([row(1, 1, "reserve", 10, None), row(1, 1, "settle", None, 7), row(2, 2, "reserve", 5, None)], schema)
    b = spark.createDataFrame([row(3, 3, "reserve", 4, None)], schema)
    got = [tuple(r) for r in events.authorization_of({"b": b, "a": a}, 20).orderBy("stage").collect()]
    assert got == [("a", 12, 2, 12, 8), ("b", 4, 1, 16, 4)]
    with pytest.raises(ValueError):
        events.authorization_of({"a": a, "b": a}, 20)


def test_zero_has_no_sign(spark):
    from gradeloom.operators import prompts

    rows = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, -0.5), (4, None)], "k int, acctbal double").withColumn("t", prompts.number_text(F.col("acctbal")))
    assert [r.t for r in rows.orderBy("k").collect()] == ["0", "0", "-0.5", None]
    assert prompts.lossless(rows.where("k < 4"), "t", "acctbal").first().mismatches == 0
