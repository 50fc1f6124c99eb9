"""Hand cases, metamorphic checks and injected violations."""

from pyspark.sql import functions as F

from gradeloom.functions.scalars import coded, folded_text, softmax, valid_probabilities
from gradeloom.operators import boot, contrast, events, prep, score


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def preds(spark, y, **runs):
    rows = [(run, k, t, p) for run, ps in runs.items() for k, (t, p) in enumerate(zip(y, ps, strict=True))]
    return frame(spark, rows, "run_id string, row_id long, y int, pred int")


def test_scores_count_failures_as_wrong(spark):
    """Six rows of three classes; two failures. Expected by hand from the confusion matrix."""
    s = score.scores(score.confusion(preds(spark, [0, 0, 0, 1, 1, 2], a=[0, 0, -1, 1, 2, -1]), 3)).first()
    assert abs(s.accuracy - 3 / 6) < 1e-12 and s.failures == 2
    assert abs(s.balanced_accuracy - (2 / 3 + 1 / 2 + 0) / 3) < 1e-12
    # f1: class 0 2*2/(3+2), class 1 2*1/(2+1), class 2 0
    assert abs(s.macro_f1 - (4 / 5 + 2 / 3 + 0) / 3) < 1e-12


def test_confusion_is_filled_with_zeros(spark):
    cells = {(r.y, r.pred): r.n for r in score.confusion(preds(spark, [2, 2, 1], a=[2, -1, 0]), 3).collect()}
    assert len(cells) == 12 and sum(cells.values()) == 3
    assert cells[2, -1] == cells[2, 2] == cells[1, 0] == 1 and cells[0, 0] == 0


def test_transitions_against_plain_counting(spark):
    import random

    rng = random.Random(11)
    y = [rng.randrange(3) for _ in range(60)]
    a, b = ([rng.choice([-1, 0, 1, 2, t]) for t in y] for _ in range(2))
    t = contrast.transitions(preds(spark, y, first=a, second=b), [("first", "second")]).first()
    rows = list(zip(y, a, b, strict=True))
    assert t.wrong_to_correct == sum(p != t_ == q for t_, p, q in rows)
    assert t.correct_to_wrong == sum(p == t_ != q for t_, p, q in rows) == t.harmed_by_label + t.harmed_by_failure
    assert t.harmed_by_failure == sum(p == t_ and q < 0 for t_, p, q in rows)
    assert t.changed == sum(p != q for _, p, q in rows) and t.net == t.wrong_to_correct - t.correct_to_wrong
    assert t.source_failures == sum(p < 0 for _, p, _ in rows)


def test_joint_patterns_against_plain_counting(spark):
    from collections import Counter

    y = [0, 1, 2, 0, 1, 2, 0]
    runs = {"u": [0, 1, 0, -1, 1, 2, 2], "v": [0, 0, 2, 0, -1, 2, 1], "w": [1, 1, 2, 0, 1, -1, 2]}
    want = Counter("".join(str(int(runs[r][k] == t)) for r in "uvw") for k, t in enumerate(y))
    got = {r.pattern: r.n for r in contrast.joint_correctness(preds(spark, y, **runs), ["u", "v", "w"]).collect()}
    assert len(got) == 8 and {k: n for k, n in got.items() if n} == dict(want)


def test_coverage_rounds_half_up(spark):
    for n in (7, 20, 55, 1001):
        got = {r.r: r.m for r in spark.createDataFrame([(n, r) for r in contrast.RATES], "n long, r long").select("r", contrast.covered(F.col("n"), F.col("r")).alias("m")).collect()}
        assert got == {r: int(n * r / 100 + 0.5) for r in contrast.RATES}


def test_folded_texts_leak(spark):
    rows = frame(spark, [(1, "Straße ﬁn", 0, "train"), (2, "STRASSE\tFIN ", 1, "test"), (3, "x²", 0, "train"), (4, "X2", 0, "test"), (5, "Ｋ9", 1, "train"), (6, "plain", 0, "train"), (7, "strasse fin", 1, "test")], "row_id long, text string, label int, source_split string")
    rows = rows.withColumn("norm", folded_text(F.col("text")))
    test, train = rows.where("source_split = 'test'"), rows.where("source_split = 'train'")
    assert {r.row_id for r in prep.overlap_filter(train, test).collect()} == {5, 6}
    assert {r.row_id for r in prep.overlap_filter(train, test, removed=True).collect()} == {1, 3}
    audit = {r.source_split: r for r in prep.split_audit(rows).collect()}
    assert (audit["test"].duplicate_text_rows, audit["test"].conflicting_groups, audit["train"].n_classes) == (1, 0, 2)


def test_subsets_follow_the_seed_and_not_the_order(spark):
    import pytest

    rows = frame(spark, [(7 * i + 3, min(i // 11, 2)) for i in range(61)], "row_id long, label int")
    q = {r.label: r.quota for r in prep.quotas(rows.groupBy("label").agg(F.count("*").alias("n")), 13).collect()}
    # shares 2.34, 2.34 and 8.31: one each, then ten by the largest rest
    assert sum(q.values()) == 13 and min(q.values()) >= 2 and q[2] in (8, 9)
    a = {r.row_id for r in prep.stratified_subset(rows, 13, 1).collect()}
    b = {r.row_id for r in prep.stratified_subset(rows.orderBy(F.desc("row_id")).repartition(5), 13, 1).collect()}
    c = {r.row_id for r in prep.stratified_subset(rows, 13, 2).collect()}
    assert a == b != c and len(a) == 13
    with pytest.raises(ValueError):
        prep.stratified_subset(rows, 2, 1)


def test_bootstrap_modes(spark):
    p = preds(spark, [0, 1] * 40, a=[0, 1, 1, 1] * 20)
    h, m = (boot.stratified_bootstrap(p, 2, 400, 5, mode).first() for mode in ("hash", "multinomial"))
    assert abs(h.macro_f1_low - m.macro_f1_low) < 0.04 and abs(h.macro_f1_high - m.macro_f1_high) < 0.04
    same = preds(spark, [0, 1] * 10, a=[0, 1] * 10, b=[0, 1] * 10)
    d = boot.paired_intervals(same, "a", "b", 2, 100, 1).first()
    assert d.accuracy_low == d.accuracy_high == 0


def test_random_reference_is_an_expectation(spark):
    """Accuracy under random review of m rows is linear in m: every row is reviewed with chance m / n."""
    y, a, b = [0, 1, 2, 2, 1, 0, 1, 0], [0, 0, 2, -1, 1, 1, 1, 2], [1, 1, 2, 2, -1, 0, 1, 0]
    got = {r.rate: r for r in contrast.random_reference(preds(spark, y, s=a, r=b), "s", "r").collect()}
    for rate, m in ((0, 0), (25, 2), (50, 4), (100, 8)):
        want = sum((1 - m / 8) * (p == t) + m / 8 * (q == t) for t, p, q in zip(y, a, b, strict=True)) / 8
        assert abs(got[rate].accuracy - want) < 1e-12
        assert abs(got[rate].harmed - m / 8 * sum(p == t != q for t, p, q in zip(y, a, b, strict=True))) < 1e-12


def test_quotas_against_the_greedy_rule(spark):
    import random

    rng = random.Random(4)
    for case in range(12):
        n = {c: rng.choice([1, 2, 7, 50, 400]) for c in range(rng.randrange(1, 7))}
        limit, total = rng.randrange(len(n), sum(n.values()) + 3), sum(n.values())
        order = sorted(((-(limit * k / total - j), c, j) for c, k in n.items() for j in range(1, k)))
        want = {c: 1 for c in n}
        for _, c, _ in order[: max(limit - len(n), 0)]:
            want[c] += 1
        counts = spark.createDataFrame(list(n.items()), "label int, n long")
        assert {r.label: r.quota for r in prep.quotas(counts, limit).collect()} == want, case


def test_quantiles_against_numpy(spark):
    import numpy as np

    from gradeloom.operators.rank import quantiles

    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=301), "b": rng.integers(0, 4, 50).astype(float), "c": np.array([2.5])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    for r in quantiles(rows, ["g"], "v", {"low": 0.025, "mid": 0.5}).collect():
        assert np.allclose([r.low, r.mid], np.quantile(groups[r.g], [0.025, 0.5]))


def test_group_bootstrap_draws_whole_groups(spark):
    p = preds(spark, [0, 0, 1, 1, 1, 0], a=[0, 1, 1, 0, 1, 0]).withColumn("grp", (F.col("row_id") / 2).cast("int").cast("string"))
    reps = boot.signature_replicates(p, 300, 3).groupBy("rep").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n"))).alias("ok")).collect()
    # groups of two: (right, wrong), (right, wrong), (right, right)
    assert all(r.n == 6 and 3 <= r.ok <= 6 for r in reps) and {r.ok for r in reps} == {3, 4, 5, 6}
    same = preds(spark, [0, 1] * 10, a=[0, 1] * 10, b=[0, 1] * 10)
    d = boot.paired_cells(same, "a", "b", 2, 100, 1).first()
    assert d.accuracy_low == d.accuracy_high == d.macro_f1_low == d.macro_f1_high == 0


def test_injected_violations_show(spark):
    """Rules whose queries report none on sound data."""
    from gradeloom.operators import audit, control

    test = spark.createDataFrame([(0,), (1,), (2,)], "row_id long")
    r = score.alignment(test, frame(spark, [("a", 0, 0, 0), ("a", 0, 0, 0), ("a", 9, 0, 0)], "run_id string, row_id long, y int, pred int")).first()
    assert (r.missing, r.extra, r.duplicate) == (2, 1, 1)
    left = spark.createDataFrame([(1, '{"a":{"b":[1,2]},"c":"x"}')], "id long, m string")
    right = spark.createDataFrame([(1, '{"a":{"b":[1,3,4]},"d":{"n":null}}')], "id long, m string")
    got = {(r.path, r.status) for r in audit.manifest_diff(left, right, "id", "m", [r"^\$\.d"]).collect()}
    assert got == {("$.a.b[1]", "changed"), ("$.a.b[2]", "added"), ("$.c", "missing")}
    rows = frame(spark, [(1, "x", 0, -1), (1, "z", 0, 0), (2, "x", 1, 1)], "case_id long, arm string, y int, pred int")
    expected = spark.createDataFrame([("x", 2), ("z", 2)], "arm string, n_expected long")
    r = control.arm_contrasts(rows, expected, [("x", "z")], 2).first()
    assert r.status == "pending" and r.delta_accuracy is None and r.net is None
    tries = frame(spark, [(1, "x", 1, -1), (1, "x", 2, 0), (2, "x", 1, 0)], "case_id long, arm string, attempt_index int, pred int")
    fixed = {(r.case_id, r.arm): r.pred for r in control.overlay(rows, tries, ["case_id", "arm"]).collect()}
    assert fixed == {(1, "x"): 0, (1, "z"): 0, (2, "x"): 1}


def test_torn_records(spark, tmp_path):
    import pytest

    from gradeloom.sources import files

    (tmp_path / "run.jsonl").write_text('{"k":1}\n{"k":2}\n{"k":')
    path = str(tmp_path / "run.jsonl")
    assert sorted(r.k for r in files.read_jsonl(spark, path, "k long", complete=False).collect()) == [1, 2]
    with pytest.raises(ValueError):
        files.read_jsonl(spark, path, "k long")
    (tmp_path / "bad.jsonl").write_text('{"k":1}\n{"k":\n{"k":3}\n')
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k long", complete=False)


def test_ledger_machine_refuses_and_resumes(spark, tmp_path):
    from gradeloom.streaming import streams

    schema = "ledger_id long, seq long, type string, reservation_id long, reserved_nano long, charged_nano long"
    first = [(1, 1, "reserve", 10, 60, None), (1, 2, "reserve", 11, 50, None), (1, 3, "settle", 10, None, 20), (1, 4, "settle", 12, None, 1)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    rows = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    got = {r.seq: (r.status, r.balance_nano) for r in streams.ledger_machine(rows(), 100, f"{tmp_path}/place").collect()}
    assert got == {1: ("admitted", 60), 2: ("refused", 60), 3: ("settled", 20), 4: ("violation", 20)}
    spark.createDataFrame([(1, 5, "reserve", 13, 80, None)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    got = {r.seq: (r.status, r.balance_nano) for r in streams.ledger_machine(rows(), 100, f"{tmp_path}/place").collect()}
    assert len(got) == 5 and got[5] == ("admitted", 100)


def test_attempt_violations(spark):
    rows = frame(spark, [("r", 1, 1, 0), ("r", 1, 2, 0), ("r", 2, 2, None)], "run_id string, row_id long, attempt_index int, label int")
    n = {r.rule: r.n for r in events.attempt_violations(rows).collect()}
    assert n == {"order": 1, "after_success": 1, "too_many": 0}


def test_chain_tampering_shows(spark):
    from gradeloom.plans.events import chained

    rows = frame(spark, [(1, k, "reserve", k) for k in range(1, 6)], "ledger_id long, seq long, type string, reservation_id long")
    chain = chained(rows)
    assert tuple(events.chain_violations(chain).first())[1:3] == (0, 0)
    bad = chain.withColumn("payload", F.when(F.col("seq") == 3, "x").otherwise(F.col("payload")))
    assert events.chain_violations(bad).first().wrong_hashes == 1


def test_arrays(spark):
    r = spark.range(1).select(valid_probabilities(F.array(F.lit(0.5), F.lit(0.5)), 2).alias("a"), valid_probabilities(F.array(F.lit(float("nan")), F.lit(0.5)), 2).alias("b"), F.get(softmax(F.array(F.lit(0.0), F.lit(0.0))), F.lit(0)).alias("c"), coded(F.lit(7), 4).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (True, False, 0.5, -1)


def test_forest_has_the_surveys_size(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    from gradeloom.operators import features

    made, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, rows: made.append(self) or fit(self, rows))
    rows = spark.createDataFrame([(k, float(k), "ab"[k % 2], k % 2) for k in range(40)], "row_id long, acctbal double, nation string, label int")
    assert features.fit_predict_native(rows, rows).count() == 40
    assert (made[0].getNumTrees(), made[0].getMaxDepth()) == (200, 30)


def test_broken_identities_show(spark):
    """Transitions, intervals and curve ends that contradict themselves."""
    t = contrast.transitions(preds(spark, [0, 1, 1, 0], f=[0, 0, 1, -1], s=[1, 1, 1, 0]), [("f", "s")])
    assert contrast.transition_violations(t).first().violations == 0
    assert contrast.transition_violations(t.withColumn("net", F.col("net") + 1).withColumn("both_wrong", F.lit(9))).first().violations == 2
    ci = frame(spark, [("good", 0.4, 0.6), ("inverted", 0.6, 0.4), ("outside", -0.1, 1.2), ("off", 0.8, 0.9), ("none", None, None)], "run_id string, accuracy_low double, accuracy_high double")
    rows = ci.select("run_id", F.lit(0.5).alias("accuracy"))
    got = {r.run_id: r.violations for r in boot.interval_violations(ci, rows, ["accuracy"]).collect()}
    assert got["good"] == 0 and got["outside"] == 1 and got["off"] == 1 and got["inverted"] >= 1 and got["none"] == 3
    curve = frame(spark, [(0, 0.5, 0.5, 0.7), (50, 0.1, 0.5, 0.7), (100, 0.6, 0.5, 0.7)], "rate int, accuracy double, s_accuracy double, r_accuracy double")
    assert {r.rate: r.violations for r in contrast.endpoint_violations(curve, "s", "r", ["accuracy"]).collect()} == {0: 0, 100: 1}


def test_ledger_against_saved_predictions(spark):
    events_ = [(1, 10, "reserve", 9, None, None), (1, 10, "result", None, None, "returned"), (1, 10, "settle", None, 5, None)]
    for k in (11, 12, 13):
        events_ += [(1, k, t, r, c, o) for (_, _, t, r, c, o) in events_[:3]]
    events_ += [(1, 14, "reserve", 9, None, None), (1, 15, "reserve", 9, None, None), (1, 15, "result", None, None, "returned")]
    rows = frame(spark, events_, "ledger_id long, reservation_id long, type string, reserved_nano long, charged_nano long, outcome string")
    answers = frame(spark, [(1, 10, 5), (1, 11, 6), (1, 12, 5), (1, 12, 5), (1, 15, None), (1, 99, 1)], "ledger_id long, reservation_id long, told_nano long")
    got = {r.reservation_id: r.status for r in events.reconcile(rows, answers).collect()}
    assert got == {10: "settled", 11: "amount_mismatch", 12: "duplicate_prediction", 13: "no_prediction", 14: "no_result", 15: "retained", 99: "no_reserve"}


def test_training_budgets(spark):
    from gradeloom.operators import audit

    runs = frame(spark, [("zero", 0), ("one", 1), ("uneven", 1), ("all", None), ("leak", 1)], "run_id string, train_per_class int")
    p = preds(spark, [0, 1], zero=[0, 1], one=[0, 1], uneven=[0, 1], all=[0, 1], leak=[0, 1])
    training = frame(spark, [("one", 7, 0), ("one", 8, 1), ("uneven", 7, 0), ("uneven", 8, 0), ("all", 7, 0), ("leak", 0, 0), ("leak", 8, 1)], "run_id string, row_id long, label int")
    got = {r.run_id: (r.n_train, r.in_train, r.within_budget) for r in audit.run_checks(p, training, runs, 2).collect()}
    assert got == {"zero": (0, 0, True), "one": (2, 0, True), "uneven": (2, 0, False), "all": (1, 0, True), "leak": (2, 1, True)}


def test_best_runs_and_equivalence(spark):
    from gradeloom.operators import audit

    rows = frame(spark, [("d", "b", 0.7, 0.8), ("d", "a", 0.7, 0.6), ("d", "c", 0.1, 0.8)], "dataset string, run_id string, validation double, test double")
    r = contrast.best_runs(rows).first()
    assert (r.test_best, r.validation_best, r.validation_best_on_test) == ("b", "a", 0.6)
    f = score.fingerprints(preds(spark, [0, 1, 1], x=[0, 1, -1], z=[0, 1, -1], w=[0, 0, -1]), {"truths": ["y"], "decisions": ["pred"]})
    got = {r.run_id: (r.same_truths, r.same_decisions) for r in audit.equivalence(f, "x", ["truths", "decisions"]).collect()}
    assert got == {"x": (True, True), "z": (True, True), "w": (True, False)}
