"""Corpus preparation: leakage removal, quotas, nested selections, group-atomic splits, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialized
from .rank import hash_bucket, ranked


def seeded(seed, key: Column) -> Column:
    """The digest by which rows are ranked: sha-256 of 'seed:key'."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def load_rows(records: DataFrame, labels: list[str], dataset: str, n_classes: int | None = None) -> DataFrame:
    """``records(doc_id, text, lang)`` with label, row_id and reason: rejected ones (no text, a name outside the label
    map, a class beyond the ``n_classes`` declared) stay as rows that name the reason and get no id."""
    label = (F.array_position(F.array(*map(F.lit, labels)), F.col("lang")) - 1).cast("int")
    rows = records.withColumn("label", label)
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    reason = F.when(empty, "empty_text").when(F.col("label").isNull() | (F.col("label") < 0), "unknown_label").when(F.col("label") >= (n_classes or len(labels)), "label_out_of_range")
    digest = F.substring(F.sha2(F.concat_ws("|", "text", F.col("label").cast("string")), 256), 1, 16)
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("row_id", F.when(F.col("reason").isNull(), F.concat_ws(":", F.lit(dataset), F.col("doc_id").cast("string"), digest)))


#: sha-256 of the empty text.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def text_key(rows: DataFrame) -> Column:
    """The sha-256 of the normalized text, by which texts are joined and grouped, so that no shuffle carries them:
    a column ``norm_sha256`` where rows have one, else taken from ``norm``."""
    return F.col("norm_sha256") if "norm_sha256" in rows.columns else F.sha2("norm", 256)


def without_texts(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` reduced to ``columns`` and the key of their text."""
    return rows.select(*columns, text_key(rows).alias("norm_sha256"))


def overlap_filter(rows: DataFrame, holdout: DataFrame, removed: bool = False) -> DataFrame:
    """Rows whose normalized text is not (or, ``removed``, is) in the hold-out. Held-out data wins."""
    keys = holdout.select(text_key(holdout).alias("__key")).distinct()
    return rows.withColumn("__key", text_key(rows)).join(keys, "__key", "left_semi" if removed else "left_anti").drop("__key")


def _shares(pdf, limit: int):
    """Quotas of one table of class counts. The cut level of the priorities is found by bisection; what is
    left, a few rows a class, is given out one by one."""
    import heapq

    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("label")
    label, n = pdf["label"].tolist(), pdf["n"].to_numpy(np.int64)
    t = limit * n / n.sum()
    need = min(max(limit - len(n), 0), int((n - 1).sum()))

    def above(level: float):
        return np.clip(np.ceil(t - level) - 1, 0, n - 1).astype(np.int64)

    low, high = float(t.min() - n.max() - 1), float(t.max())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if above(mid).sum() <= need else (mid, high)
    more = np.maximum(above(high) - 1, 0)
    heap = [(-(t[c] - (more[c] + 1)), label[c], c) for c in range(len(n)) if more[c] < n[c] - 1]
    heapq.heapify(heap)
    for _ in range(need - int(more.sum())):
        _, _, c = heapq.heappop(heap)
        more[c] += 1
        if more[c] < n[c] - 1:
            heapq.heappush(heap, (-(t[c] - (more[c] + 1)), label[c], c))
    return pd.DataFrame({"label": label, "quota": 1 + more})


def quotas(counts: DataFrame, limit: int) -> DataFrame:
    """(label, quota) from ``counts(label, n)``: proportional, one each at least, ``limit`` in all.

    A class's target share is limit * n / total; after one row each, the limit - C largest priorities
    target - j (j = 1..n-1) get a row, ties to the lower label. Only the table of classes is touched."""
    one = counts.select(F.col("label").cast("int").alias("label"), F.col("n").cast("long").alias("n"))
    if one.where("n > 0").count() > limit:
        raise ValueError(f"a limit of {limit} leaves a class without a row")
    return one.groupBy().applyInPandas(lambda pdf: _shares(pdf, limit), "label int, quota long")


def hash_ranked(rows: DataFrame, seed, by: list[str], key: str = "row_id") -> DataFrame:
    """``rows`` with ``rank`` by seeded digest within ``by``."""
    rows = rows.withColumn("__h", seeded(seed, F.col(key)))
    return ranked(rows, by, hash_bucket(F.col("__h")), ["__h", key]).drop("__h")


def stratified_subset(rows: DataFrame, limit: int, seed) -> DataFrame:
    """``limit`` rows, proportional by label; independent of the order of the input."""
    per = quotas(rows.groupBy("label").agg(F.count("*").alias("n")), limit)
    return hash_ranked(rows, seed, ["label"]).join(F.broadcast(per), "label").where("rank <= quota").drop("rank", "quota")


def select_examples(rows: DataFrame, k: int, seed) -> DataFrame:
    """Exactly k rows per class where there are as many; nested in k."""
    return hash_ranked(rows, seed, ["label"]).where(F.col("rank") <= k)


def prepare_keys(rows: DataFrame, n_classes: int, percent: int = 10, seed: int = 42) -> DataFrame:
    """(row_id, label, source_split, norm_sha256, split, removal_reason) from ``rows(row_id, norm, label, source_split)``:
    train rows that overlap the test go; a stratified validation is drawn; train rows that overlap it go. All rows
    stay, with split and reason. Texts are read once, for their keys; everything after that is on a narrow table."""
    rows = materialized(without_texts(rows, "row_id", "label", "source_split"), "keys")
    test, train = rows.where("source_split = 'test'"), rows.where("source_split = 'train'")
    held = test.select("norm_sha256").distinct().withColumn("in_test", F.lit(True))
    train = materialized(train.join(held, "norm_sha256", "left"), "train-keys")
    kept = train.where("in_test is null").drop("in_test")
    n = kept.count()
    validation = stratified_subset(kept, max(n_classes, -(-n * percent // 100)), seed)
    # one row of the validation draws all train rows of its text out
    drawn = materialized(validation.select("row_id", "norm_sha256"), "validation-keys")
    texts = drawn.select("norm_sha256").distinct().withColumn("in_validation", F.lit(True))
    out = train.join(drawn.select("row_id", F.lit(True).alias("drawn")), "row_id", "left").join(texts, "norm_sha256", "left")
    reason = F.when(F.col("in_test"), "test_overlap").when(F.col("drawn"), None).when(F.col("in_validation"), "validation_overlap")
    split = F.when(F.col("drawn"), "validation").when(F.col("in_test").isNull() & F.col("in_validation").isNull(), "train")
    out = out.select("row_id", "label", "source_split", "norm_sha256", split.alias("split"), reason.alias("removal_reason"))
    none = F.lit(None).cast("string")
    return out.unionByName(test.select("row_id", "label", "source_split", "norm_sha256", F.lit("test").alias("split"), none.alias("removal_reason")))


def prepare(rows: DataFrame, n_classes: int, percent: int = 10, seed: int = 42) -> DataFrame:
    """``rows`` with the split and removal reason of ``prepare_keys``; here the rows follow their ids once."""
    return rows.join(prepare_keys(rows, n_classes, percent, seed).select("row_id", "split", "removal_reason"), "row_id")


#: Ids that are broadcast at most; more of them are joined by a shuffle.
SENT_IDS = 2_000_000


def prepared_texts(rows: DataFrame, n_classes: int, percent: int = 10, seed: int = 42) -> DataFrame:
    """(row_id, label, text, split) of the rows that ``prepare`` gives a split (ids are unique). Most rows keep the split of
    their source, so only the ids of the others are sent to the texts, which are not shuffled."""
    keys = prepare_keys(rows, n_classes, percent, seed).where("split is null or split = 'validation'")
    others = materialized(keys.select(F.col("row_id").alias("__id"), F.coalesce("split", F.lit("none")).alias("__split")), "other-splits")
    others = F.broadcast(others) if others.count() <= SENT_IDS else others
    out = rows.join(others, F.col("row_id") == F.col("__id"), "left").select("row_id", "label", "text", F.coalesce("__split", "source_split").alias("split"))
    return out.where("split <> 'none'")


def split_audit(rows: DataFrame, split: str = "source_split") -> DataFrame:
    """Per split: rows, classes, duplicate_text_rows, conflicting groups."""
    groups = rows.groupBy(split, text_key(rows).alias("key")).agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    texts = groups.groupBy(split).agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("duplicate_text_rows"), F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("conflicting_groups"))
    return texts.join(rows.groupBy(split).agg(F.count_distinct("label").alias("n_classes")), split)


def violations(rows: DataFrame, n_classes: int, split: str = "split") -> DataFrame:
    """(rule, n) for every rule a prepared corpus must keep."""
    short = rows.groupBy(split).agg((F.lit(n_classes) - F.count_distinct("label")).alias("n")).agg(F.sum("n").alias("n")).select(F.lit("missing_class").alias("rule"), "n")
    ids = rows.groupBy("row_id").agg((F.count("*") - 1).alias("n")).agg(F.sum("n").alias("n")).select(F.lit("duplicate_id").alias("rule"), "n")
    empty = rows.agg(F.count_if(text_key(rows) == EMPTY).alias("n")).select(F.lit("empty_text").alias("rule"), "n")
    cross = rows.groupBy(text_key(rows).alias("key")).agg(F.min(split).alias("a"), F.max(split).alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("n")).select(F.lit("cross_split_text").alias("rule"), "n")
    return short.union(ids).union(empty).union(cross).select("rule", F.col("n").cast("long").alias("n"))


def cap_text(rows: DataFrame, max_chars: int, split: str = "split") -> DataFrame:
    """Prefixes of ``max_chars``; overlaps that this makes leave validation, then train."""
    cut = {"truncated": F.length("text") > max_chars, "text": F.substring("text", 1, max_chars), "norm": F.trim(F.substring("norm", 1, max_chars))}
    capped = rows.drop("norm_sha256").withColumns(cut).withColumn("norm_sha256", F.sha2("norm", 256))
    test, val, train = (capped.where(F.col(split) == s) for s in ("test", "validation", "train"))
    val = overlap_filter(val, test)
    return test.unionByName(val).unionByName(overlap_filter(train, test.select("norm_sha256").union(val.select("norm_sha256"))))


def grouped_folds(rows: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` with ``fold``: groups of equal texts stay whole and are dealt in turn within the class
    that most of their rows have (ties low)."""
    rows = rows.withColumn("group_sha256", text_key(rows))
    per = rows.groupBy("group_sha256", "label").agg(F.count("*").alias("n"))
    groups = per.groupBy("group_sha256").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("stratum"))
    groups = groups.withColumn("__h", seeded(seed, F.col("group_sha256")))
    groups = ranked(groups, ["stratum"], hash_bucket(F.col("__h")), ["__h"], "r").withColumn("fold", ((F.col("r") - 1) % folds).cast("int"))
    return rows.join(groups.select("group_sha256", "fold"), "group_sha256")


def fingerprint(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Order-insensitive content fingerprint: count and sum of 60-bit row digests."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(digest).cast("string").alias("fingerprint"))
