"""Bootstrap by splitting trees against explicit resampling of rows and whole groups."""

import numpy as np
import pytest

from gradeloom.operators import resample

RNG = np.random.default_rng(12)
N, C = 90, 3
Y = RNG.integers(0, C, N)
A = np.where(RNG.random(N) < 0.7, Y, RNG.integers(-1, C, N))
B = np.where(RNG.random(N) < 0.5, Y, RNG.integers(-1, C, N))
GROUP = RNG.integers(0, 31, N)


def joint(spark, a=A, b=B):
    preds = spark.createDataFrame([(run, k, int(Y[k]), int(p[k])) for run, p in (("a", a), ("b", b)) for k in range(N)], "run_id string, row_id long, y int, pred int")
    groups = spark.createDataFrame([(k, f"g{GROUP[k]}") for k in range(N)], "row_id long, grp string")
    listed = spark.createDataFrame([("both", "a", "b"), ("alone", "a", None), ("none", "a", "zz")], "contrast string, a string, b string")
    return resample.joint_rows(preds, listed, groups)


def score(y, p):
    f1 = 0.0
    for c in range(C):
        den = (y == c).sum() + (p == c).sum()
        f1 += 2 * ((y == c) & (p == c)).sum() / den if den else 0
    return np.array([(y == p).mean(), f1 / C])


def explicit(grouped, samples=4000):
    """Differences of replicates, and the range of rows drawn, row by row in numpy."""
    rng, out, sizes = np.random.default_rng(1), [], []
    names = np.unique(GROUP)
    for _ in range(samples):
        if grouped:
            at = np.concatenate([np.flatnonzero(GROUP == g) for g in rng.choice(names, len(names))])
        else:
            at = np.concatenate([rng.choice(np.flatnonzero(Y == c), (Y == c).sum()) for c in range(C)])
        out.append(np.concatenate([score(Y[at], A[at]) - score(Y[at], B[at]), score(Y[at], A[at])]))
        sizes.append(len(at))
    return np.array(out), min(sizes), max(sizes)


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("leaf_items", [2048, 2])
def test_intervals_equal_explicit_resampling(spark, grouped, leaf_items):
    drawn, least, most = explicit(grouped)
    got = {r.contrast: r for r in resample.contrast_intervals(joint(spark), C, 2000, 5, grouped, leaf_items).collect()}
    assert set(got) == {"both", "alone"}  # a run that is not there gives none
    point = {"both": score(Y, A) - score(Y, B), "alone": score(Y, A)}
    for name, k in (("both", 0), ("alone", 2)):
        r, spread = got[name], drawn[:, k : k + 2].std(axis=0)
        assert r.replicates == 2000 and np.allclose([r.accuracy, r.macro_f1], point[name])
        for m, column in (("accuracy", k), ("macro_f1", k + 1)):
            want = np.quantile(drawn[:, column], [0.025, 0.975])
            assert np.abs(np.array([r[f"{m}_low"], r[f"{m}_high"]]) - want).max() < 0.3 * spread[column - k] + 1 / N
        if grouped:
            assert abs(r.least_rows - least) < 14 and abs(r.most_rows - most) < 14 and r.least_rows < r.most_rows
        else:
            assert r.least_rows == r.most_rows == N


@pytest.mark.parametrize("grouped", [False, True])
def test_draws_are_of_the_right_size_and_repeat(spark, grouped):
    rows = joint(spark).where("contrast = 'both'")
    one, again = (sorted(map(tuple, resample.replicates(x, 120, 9, grouped, 2).collect())) for x in (rows, rows.repartition(5)))
    assert one == again
    if not grouped:
        per = {}
        for _, rep, y, _, _, n in one:
            per[rep, y] = per.get((rep, y), 0) + n
        assert len(per) == 120 * C and all(n == (Y == y).sum() for (_, y), n in per.items())
    # paired: what a and b predict is drawn together
    cells = {(int(y), int(p), int(q)) for y, p, q in zip(Y, A, B, strict=True)}
    assert {(y, p, q) for _, _, y, p, q, _ in one} <= cells


def test_equal_runs_differ_by_nothing(spark):
    r = {x.contrast: x for x in resample.contrast_intervals(joint(spark, A, A), C, 200, 3, True).collect()}["both"]
    assert (r.accuracy, r.accuracy_low, r.accuracy_high, r.macro_f1_low, r.macro_f1_high) == (0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        resample.replicates(joint(spark), 99)


@pytest.mark.parametrize("grouped", [False, True])
def test_closed_form(spark, grouped):
    drawn, _, _ = explicit(grouped)
    rows = joint(spark)
    got = {r.contrast: r.se for r in resample.standard_error(rows, grouped).collect()}
    assert abs(got["both"] / drawn[:, 0].std() - 1) < 0.08 and abs(got["alone"] / drawn[:, 2].std() - 1) < 0.08
    band = resample.in_band(resample.contrast_intervals(rows, C, 1000, 3, grouped), resample.standard_error(rows, grouped)).collect()
    assert all(r.low_in_band and r.high_in_band and r.f1_in_order for r in band)
