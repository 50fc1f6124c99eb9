"""Bootstrap intervals that resample cells, never rows.

Rows of a run are first counted into confusion cells (or groups into signatures). A replicate then needs
counts only: by keyed hashes over indexed draws (small data, the same in any engine), or by multinomial
draws over the cells (any size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import keyed
from . import resample
from .rank import ranked
from .score import confusion, scores


def hash_replicates(preds: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Resampled rows (run_id, rep, y, pred): draw i of class y of replicate b takes row u mod n of the
    class in id order. For checks and small tables: replicates x rows are drawn."""
    rows = ranked(preds.select("run_id", "row_id", "y", "pred"), ["run_id", "y"], F.floor(F.col("row_id") / 4096), ["row_id"], "i")
    n = rows.groupBy("run_id", "y").agg(F.count("*").alias("n"))
    draws = rows.select("run_id", "y", "i").join(n, ["run_id", "y"]).select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    pick = keyed(str(seed), F.concat_ws(":", "y", "rep", "i")) % F.col("n") + 1
    return draws.select("run_id", "y", "rep", pick.alias("i")).join(rows, ["run_id", "y", "i"]).select("run_id", "rep", "y", "pred")


def multinomial_replicates(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(run_id, rep, y, pred, n): each class's rows drawn anew over its cells; cost is that of the cells."""

    def draw(pdf):
        import numpy as np
        import pandas as pd

        run, y = pdf["run_id"].iloc[0], int(pdf["y"].iloc[0])
        pdf = pdf.sort_values("pred")
        n = pdf["n"].to_numpy()
        rng = np.random.default_rng([seed, y, *run.encode()])
        out = rng.multinomial(n.sum(), n / max(n.sum(), 1), size=replicates)
        return pd.DataFrame({"run_id": run, "rep": np.repeat(np.arange(replicates), len(n)), "y": y, "pred": np.tile(pdf["pred"].to_numpy(), replicates), "n": out.ravel()})

    return cells.groupBy("run_id", "y").applyInPandas(draw, "run_id string, rep int, y int, pred int, n long")


def group_replicates(preds: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(run_id, rep, y, pred): whole groups (``grp``) drawn with replacement by keyed hashes."""
    groups = ranked(preds.select("grp").distinct(), [], F.substring("grp", 1, 2), ["grp"], "g")
    n = groups.agg(F.count("*").alias("n"))
    draws = groups.select("g").crossJoin(F.broadcast(n)).select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    picked = draws.select("rep", (keyed(str(seed), F.concat_ws(":", "rep", "g")) % F.col("n") + 1).alias("g"))
    return picked.join(groups, "g").join(preds, "grp").select("run_id", "rep", "y", "pred")


def signature_replicates(preds: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(run_id, rep, y, pred, n): whole groups drawn with replacement, over signatures (groups with the same counts
    of cells are alike), by a tree of splits: the cost is that of the signatures, and no run meets in one task."""
    rows = preds.select(F.col("run_id").alias("contrast"), "grp", "y", F.col("pred").alias("pa"), F.lit(None).cast("int").alias("pb"))
    return resample.replicates(rows, replicates, seed, grouped=True).select(F.col("contrast").alias("run_id"), "rep", "y", F.col("pa").alias("pred"), "n")


def intervals(rep_cells: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile intervals of accuracy and macro-F1 from confusion cells per (run_id, rep)."""
    s = scores(rep_cells, ("run_id", "rep"))
    q = lambda c: F.percentile(c, F.array(F.lit(low), F.lit(high)))
    out = s.groupBy("run_id").agg(F.count("*").alias("replicates"), q("accuracy").alias("a"), q("macro_f1").alias("f"))
    return out.select("run_id", "replicates", *[F.get(c, F.lit(k)).alias(f"{n}_{e}") for c, n in (("a", "accuracy"), ("f", "macro_f1")) for k, e in ((0, "low"), (1, "high"))])


def stratified_bootstrap(preds: DataFrame, n_classes: int, replicates: int, seed: int, mode: str = "multinomial") -> DataFrame:
    if mode == "hash":
        return intervals(confusion(hash_replicates(preds, replicates, seed), n_classes, ("run_id", "rep")))
    return intervals(multinomial_replicates(confusion(preds, n_classes), replicates, seed))


def group_bootstrap(preds: DataFrame, n_classes: int, replicates: int, seed: int, mode: str = "signatures") -> DataFrame:
    """Intervals from whole groups, with the range of rows a replicate drew. Mode ``hash`` draws group by group, the
    same in any engine; it costs replicates x groups and is meant for checks."""
    if mode == "signatures":
        reps = signature_replicates(preds, replicates, seed)
        size = reps.groupBy("run_id", "rep").agg(F.sum("n").alias("n")).groupBy("run_id").agg(F.min("n").alias("least_rows"), F.max("n").alias("most_rows"))
        return intervals(reps).join(size, "run_id")
    return intervals(confusion(group_replicates(preds, replicates, seed), n_classes, ("run_id", "rep")))


def paired_cells(preds: DataFrame, a: str, b: str, n_classes: int, replicates: int, seed: int) -> DataFrame:
    """Interval of accuracy and macro-F1 of run a minus run b, each class's rows drawn over the joint cells of
    both predictions: classes x (classes + 1)^2 cells, whatever the number of rows."""
    x = preds.where(F.col("run_id") == a).select("row_id", "y", F.col("pred").alias("pa"))
    z = preds.where(F.col("run_id") == b).select("row_id", F.col("pred").alias("pb"))
    cells = x.join(z, "row_id").groupBy("y", "pa", "pb").agg(F.count("*").alias("n"))

    def draw(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["y", "pa", "pb"])
        y, pa, pb, n = (pdf[c].to_numpy() for c in ("y", "pa", "pb", "n"))
        rng, reps = np.random.default_rng(seed), np.zeros((replicates, len(n)), np.int64)
        for c in np.unique(y):
            own = y == c
            reps[:, own] = rng.multinomial(n[own].sum(), n[own] / n[own].sum(), size=replicates)

        def scored(pred):
            f1 = np.zeros(replicates)
            for c in range(n_classes):
                den = reps[:, y == c].sum(axis=1) + reps[:, pred == c].sum(axis=1)
                f1 += np.where(den > 0, 2 * reps[:, (y == c) & (pred == c)].sum(axis=1) / np.maximum(den, 1), 0)
            return reps[:, pred == y].sum(axis=1) / n.sum(), f1 / n_classes

        accuracy, f1 = (p - q for p, q in zip(scored(pa), scored(pb), strict=True))
        low, high = np.quantile(accuracy, [0.025, 0.975]), np.quantile(f1, [0.025, 0.975])
        return pd.DataFrame({"accuracy_low": [low[0]], "accuracy_high": [low[1]], "macro_f1_low": [high[0]], "macro_f1_high": [high[1]]})

    return cells.groupBy().applyInPandas(draw, "accuracy_low double, accuracy_high double, macro_f1_low double, macro_f1_high double")


def paired_intervals(preds: DataFrame, a: str, b: str, n_classes: int, replicates: int, seed: int) -> DataFrame:
    """The same on indexed hash draws, for checks and small tables."""
    reps = scores(confusion(hash_replicates(preds.where(F.col("run_id").isin(a, b)), replicates, seed), n_classes, ("run_id", "rep")), ("run_id", "rep"))
    x, y = reps.where(F.col("run_id") == a), reps.where(F.col("run_id") == b)
    d = x.alias("x").join(y.alias("y"), F.col("x.rep") == F.col("y.rep")).select(*[(F.col(f"x.{c}") - F.col(f"y.{c}")).alias(c) for c in ("accuracy", "macro_f1")])
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    out = d.agg(q("accuracy").alias("a"), q("macro_f1").alias("f"))
    return out.select(*[F.get(c, F.lit(k)).alias(f"{n}_{e}") for c, n in (("a", "accuracy"), ("f", "macro_f1")) for k, e in ((0, "low"), (1, "high"))])


def interval_violations(intervals: DataFrame, scores: DataFrame, metrics: list[str], slack: float = 0.05) -> DataFrame:
    """Per run, intervals that are inverted, leave [0, 1], or lie more than ``slack`` off the score."""
    bad = []
    for m in metrics:
        low, high = F.col(f"{m}_low"), F.col(f"{m}_high")
        bad += [low > high, (low < 0) | (high > 1), ~F.col(m).between(low - slack, high + slack)]
    return intervals.join(scores, "run_id").select("run_id", sum((F.coalesce(b, F.lit(True)).cast("int") for b in bad), F.lit(0)).alias("violations"))
