"""Paired contrasts, inventories and review-value analytics on coded prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prep import hash_ranked
from .rank import balanced, ranked
from .score import scores


def paired(preds: DataFrame, before: str, after: str) -> DataFrame:
    """(row_id, y, a, b): two runs on the same rows."""
    a = preds.where(F.col("run_id") == before).select("row_id", "y", F.col("pred").alias("a"))
    b = preds.where(F.col("run_id") == after).select("row_id", F.col("pred").alias("b"))
    return a.join(b, "row_id")


def transition_counts(y: Column, a: Column, b: Column) -> list[Column]:
    right, now = a == y, b == y
    return [
        F.count("*").alias("n_rows"), F.count_if(~right & now).alias("wrong_to_correct"), F.count_if(right & ~now).alias("correct_to_wrong"),
        F.count_if(right & ~now & (b >= 0)).alias("harmed_by_label"), F.count_if(right & (b < 0)).alias("harmed_by_failure"),
        F.count_if(right & now).alias("both_correct"), F.count_if(~right & ~now).alias("both_wrong"), F.count_if(a != b).alias("changed"),
        F.count_if(a < 0).alias("source_failures"), F.count_if((a >= 0) & (b < 0)).alias("review_failures"),
        (F.count_if(~right & now) - F.count_if(right & ~now)).alias("net"),
    ]


def transitions(preds: DataFrame, pairs: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """One row per (before, after), by one join on row_id for the whole list of pairs."""
    s = preds.sparkSession
    listed = pairs.select("before", "after").distinct() if isinstance(pairs, DataFrame) else s.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in pairs])))
    a = preds.select(F.col("run_id").alias("before"), "row_id", "y", F.col("pred").alias("a")).join(F.broadcast(listed), "before")
    b = preds.select(F.col("run_id").alias("after"), "row_id", F.col("pred").alias("b"))
    return a.join(b, ["after", "row_id"]).groupBy("before", "after").agg(*transition_counts(F.col("y"), F.col("a"), F.col("b")))


def transition_violations(t: DataFrame) -> DataFrame:
    """Broken identities per pair: the partition, the kinds of harm, and the net change."""
    bad = [
        F.col("wrong_to_correct") + F.col("correct_to_wrong") + F.col("both_correct") + F.col("both_wrong") != F.col("n_rows"),
        F.col("harmed_by_label") + F.col("harmed_by_failure") != F.col("correct_to_wrong"),
        F.col("wrong_to_correct") - F.col("correct_to_wrong") != F.col("net"),
    ]
    return t.select("before", "after", sum((b.cast("int") for b in bad), F.lit(0)).alias("violations"))


def best_runs(rows: DataFrame, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Of runs with ``validation`` and ``test`` scores: the best on test, and the best on validation with its
    test score; ties go to the run that sorts first."""
    best = lambda c: F.min_by(F.struct("run_id", "validation", "test"), F.struct(-F.col(c), "run_id"))
    out = rows.groupBy(*by).agg(best("test").alias("t"), best("validation").alias("v"))
    return out.select(*by, F.col("t.run_id").alias("test_best"), F.col("t.test").alias("test_score"), F.col("v.run_id").alias("validation_best"), F.col("v.validation").alias("validation_score"), F.col("v.test").alias("validation_best_on_test"))


def endpoint_violations(curve: DataFrame, source: str, review: str, metrics: list[str]) -> DataFrame:
    """Per end of a selective curve, the metrics that differ from those of the run it must equal: rows hold
    ``rate``, the curve's metrics, and the runs' as ``<run>_<metric>``."""
    off = lambda m, run: (F.abs(F.col(m) - F.col(f"{run}_{m}")) > 1e-12).cast("int")
    total = sum((F.when(F.col("rate") == 0, off(m, source)).otherwise(off(m, review)) for m in metrics), F.lit(0))
    return curve.where(F.col("rate").isin(0, 100)).select("rate", total.alias("violations"))


def prompt_pairs(rows: DataFrame) -> DataFrame:
    """Per pair of runs, outcomes on equal prompts, from ``rows(prompt, run_id, model, y, pred)``. Prompts on which the
    same runs meet with the same outcomes are counted first; pairs are formed on these patterns, so their number
    follows the runs and outcomes, not the rows. A run has a prompt once."""
    met = F.struct("run_id", "model", (F.col("pred") < 0).alias("failed"), (F.col("pred") == F.col("y")).alias("right"))
    patterns = rows.groupBy("prompt").agg(F.array_sort(F.collect_list(met)).alias("met")).where(F.size("met") > 1).groupBy("met").agg(F.count("*").alias("n"))
    after = lambda i: F.slice("met", i + 2, F.size("met"))
    pairs = F.flatten(F.transform("met", lambda a, i: F.transform(after(i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = patterns.select("n", F.inline(pairs)).where("a.run_id < b.run_id").groupBy(F.col("a.run_id").alias("run_a"), F.col("b.run_id").alias("run_b"))
    part = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    return both.agg(F.sum("n").alias("equal_proposals"), part(F.col("a.failed"), "both_failed"), part(~F.col("a.failed") & (F.col("a.right") != F.col("b.right")), "disagreements"), part(F.col("a.model") != F.col("b.model"), "model_mismatch"))


def joint_correctness(preds: DataFrame, runs: list[str]) -> DataFrame:
    """Counts of all bit patterns of correctness of the listed runs, zero-filled."""
    rows = preds.where(F.col("run_id").isin(runs)).groupBy("row_id").agg(*[F.max(F.when(F.col("run_id") == r, (F.col("pred") == F.col("y")).cast("int"))).alias(f"b{k}") for k, r in enumerate(runs)])
    per = rows.groupBy(F.concat(*[F.col(f"b{k}").cast("string") for k in range(len(runs))]).alias("pattern")).agg(F.count("*").alias("n"))
    grid = preds.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(2 ** len(runs) - 1))).alias("k")).select(F.lpad(F.bin("k"), len(runs), "0").alias("pattern"))
    return grid.join(per, "pattern", "left").fillna(0, ["n"])


def inventory(grid: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Expected conditions against actual runs: complete, running, missing, unexpected or duplicate."""
    per = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.max("status").alias("status"))
    g = grid.select(*[F.col(k).alias(f"g_{k}") for k in keys], F.lit(True).alias("expected"))
    on = [per[k].eqNullSafe(g[f"g_{k}"]) for k in keys]
    same = on[0]
    for c in on[1:]:
        same = same & c
    both = per.join(g, same, "full_outer")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").otherwise(F.col("status"))
    return both.select(*[F.when(F.col("expected"), F.col(f"g_{k}")).otherwise(F.col(k)).alias(k) for k in keys], state.alias("status"))


def review_linkage(runs: DataFrame) -> DataFrame:
    """Per review run: whether its source exists, is complete and has its model, dataset and budget."""
    src = runs.select(F.col("run_id").alias("source_run_id"), F.col("status").alias("s"), F.col("model").alias("m"), F.col("dataset").alias("ds"), F.col("train_per_class").alias("k"))
    r = runs.where("arm = 'review'").join(src, "source_run_id", "left")
    return r.select("run_id", F.col("s").isNotNull().alias("exists"), F.coalesce(F.col("s") == "complete", F.lit(False)).alias("complete"), F.coalesce((F.col("m") == F.col("model")) & (F.col("ds") == F.col("dataset")) & F.col("k").eqNullSafe(F.col("train_per_class")), F.lit(False)).alias("matches"))


# ---- selective review ----------------------------------------------------------------------------

RATES = (0, 10, 25, 50, 75, 100)


def confidence_ranked(preds: DataFrame, run: str) -> DataFrame:
    """Rows of a run by ascending top probability, ties by sha-256 of the id; blind to the truth."""
    rows = preds.where(F.col("run_id") == run).withColumns({"conf": F.coalesce(F.array_max("probabilities"), F.lit(0.0)), "h": F.sha2(F.col("row_id").cast("string"), 256)})
    rows, bucket = balanced(rows, "conf", "h")
    return ranked(rows, [], bucket, ["conf", "h"], "rank").drop("h", "__cuts")


def covered(n: Column, rate: Column) -> Column:
    return F.floor((n * rate + 50) / 100).cast("long")


def _rates(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, RATES))).alias("rate"))


def selective_cells(preds: DataFrame, source: str, review: str) -> DataFrame:
    """(rate, y, a, b, picked, n): cells of source and review predictions, by rate and choice."""
    a = confidence_ranked(preds, source).select("row_id", "y", F.col("pred").alias("a"), "rank")
    b = preds.where(F.col("run_id") == review).select("row_id", F.col("pred").alias("b"))
    n = a.agg(F.count("*").alias("total"))
    rows = a.join(b, "row_id").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(_rates(preds.sparkSession)))
    rows = rows.withColumn("picked", F.col("rank") <= covered(F.col("total"), F.col("rate")))
    return rows.groupBy("rate", "y", "a", "b", "picked").agg(F.count("*").alias("n"))


def selective_curve(preds: DataFrame, source: str, review: str, n_classes: int) -> DataFrame:
    """Per rate: scores of the mixed prediction, rows reviewed, fixed and harmed."""
    cells = selective_cells(preds, source, review)
    y, mixed = F.col("y"), F.when(F.col("picked"), F.col("b")).otherwise(F.col("a"))
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    counts = cells.groupBy("rate").agg(part(F.col("picked")).alias("reviewed"), part(F.col("picked") & (F.col("a") != y) & (F.col("b") == y)).alias("fixed"), part(F.col("picked") & (F.col("a") == y) & (F.col("b") != y)).alias("harmed"))
    grid = _rates(preds.sparkSession).select("rate", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("y")).withColumns({"pred": F.col("y"), "n": F.lit(0).cast("long")})
    conf = cells.select("rate", "y", mixed.alias("pred"), "n").unionByName(grid).groupBy("rate", "y", "pred").agg(F.sum("n").alias("n"))
    return scores(conf, ("rate",)).select("rate", "accuracy", "macro_f1", "balanced_accuracy", "failures").join(counts, "rate")


def random_reference(preds: DataFrame, source: str, review: str) -> DataFrame:
    """Exact expectations when the same number of rows is reviewed at random."""
    y, a, b, n = F.col("y"), F.col("a"), F.col("b"), F.col("n")
    part = lambda c, name: F.sum(F.when(c, n).otherwise(0)).alias(name)
    cells = paired(preds, source, review).groupBy("y", "a", "b").agg(F.count("*").alias("n"))
    classes = cells.groupBy("y").agg(F.sum("n").alias("n"), part(a == y, "sa"), part(b == y, "sb"), part((a != y) & (b == y), "fix"), part((a == y) & (b != y), "harm"), part(a < 0, "fa"), part(b < 0, "fb"))
    s = classes.agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "fix", "harm", "fa", "fb")], F.avg(F.col("sa") / F.col("n")).alias("ra"), F.avg(F.col("sb") / F.col("n")).alias("rb"))
    rows = s.crossJoin(F.broadcast(_rates(preds.sparkSession))).withColumn("share", covered(n, F.col("rate")) / n)
    between = lambda x, z: F.col(x) + F.col("share") * (F.col(z) - F.col(x))
    return rows.select("rate", (between("sa", "sb") / n).alias("accuracy"), between("ra", "rb").alias("balanced_accuracy"), (F.col("share") * F.col("fix")).alias("fixed"), (F.col("share") * F.col("harm")).alias("harmed"), between("fa", "fb").alias("failures"))


def random_macro_f1(preds: DataFrame, source: str, review: str, n_classes: int, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """Monte-Carlo mean and standard error of macro-F1 under random review, drawn over cells of any size; where no row
    or every row is reviewed the value is exact and there are no samples. ``plug_in`` puts the expected counts in."""
    pair = paired(preds, source, review).groupBy("y", "a", "b").agg(F.count("*").alias("n"))
    # at most classes x (classes + 1)^2 cells, whatever the number of rows
    cells = pair.crossJoin(F.broadcast(_rates(preds.sparkSession)))

    def simulate(pdf):
        import numpy as np
        import pandas as pd

        from ..functions.draws import multivariate_hypergeometric

        pdf = pdf.sort_values(["y", "a", "b"])
        rate, n = int(pdf["rate"].iloc[0]), pdf["n"].to_numpy()
        y, a, b = (pdf[c].to_numpy() for c in "yab")
        m = (n.sum() * rate + 50) // 100
        rng = np.random.default_rng([seed, rate])
        exact = m in (0, n.sum())

        def macro_f1(take):
            f1 = np.zeros(len(take))
            for c in range(n_classes):
                tp = ((y == c) & (b == c)) * take + ((y == c) & (a == c)) * (n - take)
                guess = (b == c) * take + (a == c) * (n - take)
                den = n[y == c].sum() + guess.sum(axis=1)
                f1 += np.where(den > 0, 2 * tp.sum(axis=1) / np.maximum(den, 1), 0)
            return f1 / n_classes

        plug_in = macro_f1((n * (m / n.sum()))[None])[0]
        f1 = np.array([plug_in]) if exact else macro_f1(multivariate_hypergeometric(rng, n, m, draws))
        return pd.DataFrame({"rate": [rate], "macro_f1": [f1.mean()], "se": [0.0 if exact else f1.std(ddof=1) / draws**0.5], "samples": [0 if exact else draws], "plug_in": [plug_in]})

    return cells.groupBy("rate").applyInPandas(simulate, "rate int, macro_f1 double, se double, samples int, plug_in double")


def fixed_panel(preds: DataFrame, size: int) -> DataFrame:
    """Per run, correct counts over a panel of rows chosen by hashed id, never by score."""
    ids = preds.select("row_id").distinct()
    panel = hash_ranked(ids, "panel", []).where(F.col("rank") <= size).select("row_id")
    return preds.join(panel, "row_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("pred") == F.col("y")).alias("correct"))
