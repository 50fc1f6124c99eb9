"""Bootstrap of whole lists of contrasts at once, by a tree of multinomial splits.

What is drawn are items: a class's joint cells (truth, prediction of a, prediction of b), or groups of rows that
have the same counts of cells (a signature). All replicates of a stratum start at a root with the number of
draws; every node splits its draws among up to ``FANOUT`` children by their weight, until a leaf holds few items
and draws these. The law is the multinomial over all items, but no node sees more than its children or the items
of a leaf, so neither a contrast nor a run meets in one task. Draws follow from the seed and the node, so a task
that runs again draws the same."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialized

FANOUT_BITS = 6
LEAF_ITEMS = 2048
REPLICATES, SEED = 2000, 42


def joint_rows(preds: DataFrame, contrasts: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(contrast, y, pa, pb[, grp]) of the rows that both runs of each ``contrasts(contrast, a, b)`` predict; where b
    is null, of a's rows with pb null. ``groups(row_id, grp)`` names each row's group."""
    a = preds.select(F.col("run_id").alias("a"), "row_id", "y", F.col("pred").alias("pa"))
    b = preds.select(F.col("run_id").alias("b"), "row_id", F.col("pred").alias("pb"))
    listed = F.broadcast(contrasts.select("contrast", "a", "b"))  # a row per contrast
    alone = a.join(listed.where("b is null"), "a").withColumn("pb", F.lit(None).cast("int"))
    both = a.join(listed.where("b is not null"), "a").join(b, ["b", "row_id"])
    rows = both.select("contrast", "row_id", "y", "pa", "pb").unionByName(alone.select("contrast", "row_id", "y", "pa", "pb"))
    return rows if groups is None else rows.join(groups.select("row_id", "grp"), "row_id")


def _items(rows: DataFrame, grouped: bool) -> DataFrame:
    """(contrast, stratum, h, cells, held): what is drawn, and how many rows or groups are such."""
    if grouped:
        cells = rows.groupBy("contrast", "grp", "y", "pa", "pb").agg(F.count("*").alias("n"))
        alike = cells.groupBy("contrast", "grp").agg(F.array_sort(F.collect_list(F.struct("y", "pa", "pb", "n"))).alias("cells"))
        items = alike.groupBy("contrast", "cells").agg(F.count("*").alias("held")).withColumn("stratum", F.col("contrast"))
    else:
        one = F.array(F.struct("y", "pa", "pb", F.lit(1).cast("long").alias("n"))).alias("cells")
        items = rows.groupBy("contrast", "y", "pa", "pb").agg(F.count("*").alias("held"))
        items = items.select("contrast", one, "held", F.concat_ws(":", "contrast", "y").alias("stratum"))
    return items.select("contrast", "stratum", F.xxhash64("cells").alias("h"), "cells", "held")


def _node(level: int) -> Column:
    return F.shiftrightunsigned("h", 64 - FANOUT_BITS * level) if level else F.lit(0).cast("long")


def _rng(seed: int, stratum: str, level: int, node: int):
    import numpy as np

    return np.random.default_rng([seed, zlib.crc32(stratum.encode()), len(stratum), level, node])


def _split(items: DataFrame, counts: DataFrame, level: int, seed: int) -> DataFrame:
    """The draws of the nodes of ``level`` from those of their parents."""
    kids = items.groupBy("contrast", "stratum", _node(level).alias("node")).agg(F.sum("held").alias("w"))
    kids = kids.withColumn("parent", F.shiftrightunsigned("node", FANOUT_BITS))

    def draw(key, own, above):
        import numpy as np
        import pandas as pd

        own = own.sort_values("node")
        w = own["w"].to_numpy(float)
        drawn = _rng(seed, key[0], level, int(key[1])).multinomial(np.asarray(above["counts"].iloc[0]), w / w.sum())
        return pd.DataFrame({"contrast": own["contrast"], "stratum": own["stratum"], "node": own["node"], "counts": list(drawn.T)})

    above = counts.select("stratum", "node", "counts").withColumnRenamed("node", "parent")
    return kids.groupBy("stratum", "parent").cogroup(above.groupBy("stratum", "parent")).applyInPandas(draw, "contrast string, stratum string, node long, counts array<long>")


def _leaves(items: DataFrame, counts: DataFrame, level: int, seed: int) -> DataFrame:
    """(contrast, rep, y, pa, pb, n): cells drawn in each leaf, some replicates at a time."""

    def draw(key, own, above):
        import numpy as np
        import pandas as pd

        if not len(own):
            return pd.DataFrame({c: [] for c in ("contrast", "rep", "y", "pa", "pb", "n")})
        none = -(1 << 30)
        parts = sorted((sorted((c["y"], c["pa"], none if c["pb"] is None else c["pb"], c["n"]) for c in x), h) for x, h in zip(own["cells"], own["held"], strict=True))
        flat = [(*c[:3], c[3], k) for k, (x, _) in enumerate(parts) for c in x]
        flat.sort()
        table = np.array(flat, np.int64)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(table[:, :3], axis=0) != 0).any(axis=1)]))
        names, times, item = table[first, :3], table[:, 3], table[:, 4]
        w = np.array([h for _, h in parts], float)
        n = np.asarray(above["counts"].iloc[0])
        rng, out = _rng(seed, key[0], level + 1, int(key[1])), []
        step = max(1, (4 << 20) // max(len(w), len(item)))
        for k in range(0, len(n), step):
            drawn = rng.multinomial(n[k : k + step], w / w.sum())
            cells = np.add.reduceat(drawn[:, item] * times, first, axis=1)
            rep, at = np.nonzero(cells)
            out.append(np.column_stack([rep + k, names[at], cells[rep, at]]))
        out = pd.DataFrame(np.concatenate(out), columns=["rep", "y", "pa", "pb", "n"])
        out["pb"] = out["pb"].astype("Int64").mask(out["pb"] == none)
        out.insert(0, "contrast", own["contrast"].iloc[0])
        return out

    own = items.withColumn("node", _node(level)).groupBy("stratum", "node")
    return own.cogroup(counts.select("stratum", "node", "counts").groupBy("stratum", "node")).applyInPandas(draw, "contrast string, rep int, y int, pa int, pb int, n long")


def replicates(rows: DataFrame, samples: int = REPLICATES, seed: int = SEED, grouped: bool = False, leaf_items: int = LEAF_ITEMS) -> DataFrame:
    """(contrast, rep, y, pa, pb, n): joint cells of ``samples`` replicates of ``rows(contrast, y, pa, pb[, grp])``. Each
    draws as many rows of every class as there are, or as many whole groups as there are."""
    if samples < 100:
        raise ValueError("at least 100 replicates")
    items = materialized(_items(rows, grouped), "items")
    per = items.groupBy("contrast", "stratum").agg(F.count("*").alias("items"), F.sum("held").alias("total"))
    most = per.agg(F.max("items")).first()[0] or 0
    counts = per.select("contrast", "stratum", F.lit(0).cast("long").alias("node"), F.array_repeat("total", samples).alias("counts"))
    level = 0
    while most > leaf_items << (FANOUT_BITS * level) and FANOUT_BITS * (level + 1) < 64:
        level += 1
        counts = _split(items, counts, level, seed)
    parts = _leaves(items, counts, level, seed)
    return parts.groupBy("contrast", "rep", "y", "pa", "pb").agg(F.sum("n").alias("n"))


def joint_scores(cells: DataFrame, n_classes: int, by: tuple[str, ...]) -> DataFrame:
    """Accuracy and macro-F1 of a minus those of b (0 where pb is null), and rows, from joint cells."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    hit = lambda p: F.when(F.col(p) == F.col("y"), n).otherwise(zero)
    part = lambda c, support, ta, tb, ga, gb: F.struct(c.alias("c"), support.alias("support"), ta.alias("ta"), tb.alias("tb"), ga.alias("ga"), gb.alias("gb"))
    parts = F.array(part(F.col("y"), n, hit("pa"), hit("pb"), zero, zero), part(F.col("pa"), zero, zero, zero, n, zero), part(F.col("pb"), zero, zero, zero, zero, n))
    per = cells.select(*by, F.inline(parts)).where(F.col("c").between(0, n_classes - 1)).groupBy(*by, "c").agg(*[F.sum(c).alias(c) for c in ("support", "ta", "tb", "ga", "gb")])
    f1 = lambda t, g: F.sum(F.coalesce(F.try_divide(2 * F.col(t), F.col("support") + F.col(g)), F.lit(0.0))) / n_classes
    return per.groupBy(*by).agg(F.sum("support").alias("n_rows"), (F.sum(F.col("ta") - F.col("tb")) / F.sum("support")).alias("accuracy"), (f1("ta", "ga") - f1("tb", "gb")).alias("macro_f1"))


def contrast_intervals(rows: DataFrame, n_classes: int, samples: int = REPLICATES, seed: int = SEED, grouped: bool = False, leaf_items: int = LEAF_ITEMS) -> DataFrame:
    """Per contrast: the differences a - b of accuracy and macro-F1, their percentile intervals at 95 %, and the
    range of rows that a replicate drew."""
    drawn = joint_scores(replicates(rows, samples, seed, grouped, leaf_items), n_classes, ("contrast", "rep"))
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(f"{c}_q")
    drawn = drawn.groupBy("contrast").agg(F.count("*").alias("replicates"), q("accuracy"), q("macro_f1"), F.min("n_rows").alias("least_rows"), F.max("n_rows").alias("most_rows"))
    point = joint_scores(rows.groupBy("contrast", "y", "pa", "pb").agg(F.count("*").alias("n")), n_classes, ("contrast",)).drop("n_rows")
    ends = [F.get(f"{m}_q", F.lit(k)).alias(f"{m}_{e}") for m in ("accuracy", "macro_f1") for k, e in ((0, "low"), (1, "high"))]
    return drawn.join(point, "contrast").select("contrast", "replicates", "accuracy", "macro_f1", *ends, "least_rows", "most_rows")


def standard_error(rows: DataFrame, grouped: bool = False) -> DataFrame:
    """(contrast, se): what the bootstrap of the accuracy difference must spread by, in closed form."""
    d = (F.col("pa") == F.col("y")).cast("int") - F.coalesce((F.col("pb") == F.col("y")).cast("int"), F.lit(0))
    x = rows.withColumn("d", d.cast("double"))
    if grouped:
        per = x.groupBy("contrast", "grp").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
        s = per.groupBy("contrast").agg(*[F.sum(c).alias(k) for k, c in (("d", F.col("d")), ("n", F.col("n")), ("dd", F.col("d") * F.col("d")), ("dn", F.col("d") * F.col("n")), ("nn", F.col("n") * F.col("n")))])
        r = F.col("d") / F.col("n")
        spread = F.col("dd") - 2 * r * F.col("dn") + r * r * F.col("nn")
        return s.select("contrast", (F.sqrt(F.greatest(spread, F.lit(0.0))) / F.col("n")).alias("se"))
    per = x.groupBy("contrast", "y").agg(F.count("*").alias("n"), F.sum("d").alias("d"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    return per.groupBy("contrast").agg((F.sqrt(F.sum(F.col("dd") - F.col("d") * F.col("d") / F.col("n"))) / F.sum("n")).alias("se"))


def in_band(intervals: DataFrame, errors: DataFrame, share: float = 0.35) -> DataFrame:
    """``intervals`` with se, and whether each end of accuracy's lies within ``share`` of a standard error (and two
    rows) of where the normal law puts it, and whether macro-F1's is in order."""
    rows = intervals.join(errors, "contrast")
    room = share * F.col("se") + 2 / F.col("least_rows")
    end = lambda e, sign: (F.abs(F.col(f"accuracy_{e}") - (F.col("accuracy") + sign * 1.96 * F.col("se"))) <= room).alias(f"{e}_in_band")
    return rows.select("*", end("low", -1), end("high", 1), (F.col("macro_f1_low") <= F.col("macro_f1_high")).alias("f1_in_order"))
