"""Features and supervised baselines."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import keyed
from ..sources.files import materialized
from .rank import quantiles
from .terms import TextCounts, blank_words, grams_of, plain_words, spread, text_counts


def native_table(customer: DataFrame) -> DataFrame:
    """A native table of one numeric (partly missing) and one categorical feature and a class."""
    segments = customer.select("c_mktsegment").distinct().withColumn("label", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).cast("int"))
    key = F.col("c_custkey")
    rows = customer.join(F.broadcast(segments), "c_mktsegment")
    split = F.when(keyed("split", key) % 5 == 0, "test").otherwise("train")
    return rows.select(key.alias("row_id"), F.when(keyed("na", key) % 10 != 0, F.col("c_acctbal").cast("double")).alias("acctbal"), F.col("c_nationkey").cast("string").alias("nation"), "label", split.alias("split"))


def _moments(train: DataFrame, column: str) -> DataFrame:
    some = quantiles(train, [], column, {"m": 0.5})
    # one row, also where training has no value at all
    median = some.agg(F.coalesce(F.max("m"), F.lit(0.0)).alias("median"))
    filled = train.select(column).crossJoin(F.broadcast(median)).withColumn("v", F.coalesce(column, "median"))
    return filled.agg(F.first("median").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale"))


def standardize(rows: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """``rows`` with z: training median for missing values, training mean and population deviation."""
    m = _moments(train, column)
    scale = F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
    return rows.crossJoin(F.broadcast(m)).withColumn("z", (F.coalesce(column, "median") - F.col("mean")) / scale).drop("median", "mean", "scale")


#: The level of rows without one.
MISSING_LEVEL = "__missing__"


def one_hot(rows: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """``rows`` with the slot of their level, null (all zeros) for levels that training lacks. A missing value is a
    level of its own, ``MISSING_LEVEL``, which no value may spell."""
    if rows.union(train.select(*rows.columns)).where(F.col(column) == MISSING_LEVEL).head(1):
        raise ValueError(f"{MISSING_LEVEL} stands for missing values")
    level = F.coalesce(column, F.lit(MISSING_LEVEL))
    levels = train.select(level.alias("__level")).distinct()
    levels = levels.withColumn("slot", F.row_number().over(Window.orderBy("__level")) - 1)
    return rows.join(levels, level == F.col("__level"), "left").drop("__level")


def numeric_matrix(rows: DataFrame, train: DataFrame, numeric: list[str], categorical: str) -> DataFrame:
    """``rows`` with the array ``features``: the numeric columns, missing values as null, and the slots of ``one_hot``."""
    slots = train.agg(F.count_distinct(F.coalesce(categorical, F.lit(MISSING_LEVEL)))).first()[0]
    hot = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: F.coalesce((k == F.col("slot")).cast("double"), F.lit(0.0))) if slots else F.array().cast("array<double>")
    return one_hot(rows, train, categorical).withColumn("features", F.concat(F.array(*[F.col(c).cast("double") for c in numeric]).cast("array<double>"), hot)).drop("slot")


def provenance(train: DataFrame, numeric: str, categorical: str) -> DataFrame:
    levels = train.agg(F.count_distinct(categorical).alias("levels"))
    return _moments(train, numeric).crossJoin(levels).select(F.lit(numeric).alias("feature"), "median", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"), "levels")


def majority(train: DataFrame, test: DataFrame, n_classes: int | None = None) -> DataFrame:
    """``test`` with the most frequent class of ``train`` (the lowest on ties) as label; with ``n_classes`` also with
    probabilities, 1 for that class and 0 for the others."""
    counts = train.groupBy("label").agg(F.count("*").alias("n"))
    best = counts.agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
    out = test.drop("label").crossJoin(F.broadcast(best))
    if n_classes is None:
        return out
    return out.withColumn("probabilities", F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: (k == F.col("label")).cast("double")))


#: Words whose grams a task keeps.
KNOWN_WORDS = 1 << 16


@dataclass(frozen=True)
class Terms:
    """Rows (row_id, source_split, texts: label and words each), dealt by row_id, and how the words of a text become
    counts of terms. A row id that repeats is one row; with ``by_label`` its labels are counted apart."""

    rows: DataFrame
    count: Callable[[list[str]], dict]
    by_label: bool

    def where(self, condition: str) -> Terms:
        return Terms(self.rows.where(condition), self.count, self.by_label)

    def counter(self) -> Callable[[list[dict]], dict]:
        """For tasks: the counts of a row's terms, by label or all under None."""
        count, by_label = self.count, self.by_label

        def counted(texts: list[dict]) -> dict:
            out: dict = {}
            for x in texts:
                out.setdefault(x["label"] if by_label else None, Counter()).update(count(x["words"] or []))
            return out

        return counted


def _dealt(rows: DataFrame, **words: Column) -> DataFrame:
    """Texts are shuffled by row_id; their terms are made where they are then."""
    return spread(rows.select("row_id", "source_split", "label", "text")).groupBy("row_id", "source_split").agg(F.collect_list(F.struct("label", *[w.alias(name) for name, w in words.items()])).alias("texts"))


def _word_counts(words: list[str]) -> Counter:
    return Counter(chain(words, map(" ".join, pairwise(words))))


def word_terms(rows: DataFrame) -> Terms:
    """Words (two characters or more) and pairs of words."""
    return Terms(_dealt(rows, words=plain_words()), _word_counts, True)


def char_terms(rows: DataFrame, low: int, high: int) -> Terms:
    """Grams of ``low`` to ``high`` characters within blank-padded words; a word not longer than n counts
    once and ends the sizes. Words are counted first, so that each is cut into grams once a document."""

    known: dict[str, list[str]] = {}

    def grams(word: str) -> list[str]:
        if word not in known:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            known[word] = grams_of(word, low, high)
        return known[word]

    def count(words: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        for word, times in Counter(words).items():
            for g in grams(word):
                out[g] = out.get(g, 0) + times
        return out

    return Terms(_dealt(rows, words=blank_words()), count, False)


def term_counts(terms: Terms, vocab: DataFrame | None = None) -> DataFrame:
    """(row_id, source_split, label, term, tf); label is null where terms are not counted by it. Of the terms of
    ``vocab`` only, if given."""
    kept, counted, kind = None if vocab is None else _sent(vocab.select("term")), terms.counter(), _kind(terms.rows)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in range(0, len(batch), ROWS):
                own = batch.slice(part, ROWS)
                at, labels, names, tfs = [], [], [], []
                for k, texts in enumerate(own.column("texts").to_pylist()):
                    for label, counts in counted(texts).items():
                        found = counts if kept is None else {t: n for t, n in counts.items() if t in kept.value}
                        at += [k] * len(found)
                        labels += [label] * len(found)
                        names += found.keys()
                        tfs += found.values()
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([own.column("row_id").take(at), own.column("source_split").take(at), pa.array(labels, pa.int32()), pa.array(names, pa.string()), pa.array(tfs, pa.int64())], ["row_id", "source_split", "label", "term", "tf"])

    return terms.rows.mapInArrow(run, f"row_id {kind}, source_split string, label int, term string, tf long")


#: Rows whose terms a task holds at a time.
ROWS = 256


def _kind(rows: DataFrame) -> str:
    return rows.schema["row_id"].dataType.simpleString()


def _sent(vocab: DataFrame):
    """A vocabulary, whose size is bounded, for the tasks: its terms with what else the first other column says."""
    return vocab.sparkSession.sparkContext.broadcast({r[0]: r[1] if len(r) > 1 else None for r in vocab.toLocalIterator()})


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """The most frequent terms of training counts, with their document frequency: ``size`` rows at most."""
    per = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return per.orderBy(F.desc("total"), "term").limit(size).select("term", "df")


def weighted(terms: Terms, rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row_id, terms, ws) for the terms of ``vocab(term, df)``, two lists a row: sublinear tf, smooth idf of the training
    rows, unit length. The vocabulary's size is bounded, so it is broadcast, and terms are not shuffled."""
    n, kept = rows.where("source_split = 'train'").count(), _sent(vocab)
    counted = terms.counter()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in range(0, len(batch), ROWS):
                own, names, ws = batch.slice(part, ROWS), [], []
                for texts in own.column("texts").to_pylist():
                    found = [(t, tf, kept.value[t]) for counts in counted(texts).values() for t, tf in counts.items() if t in kept.value]
                    tf, df = np.array([x[1] for x in found], float), np.array([x[2] for x in found], float)
                    w = (1 + np.log(tf)) * (np.log((1 + n) / (1 + df)) + 1)
                    names.append([x[0] for x in found])
                    ws.append(w / np.sqrt((w * w).sum()) if len(w) else w)
                yield pa.RecordBatch.from_arrays([own.column("row_id"), pa.array(names, pa.list_(pa.string())), pa.array(ws, pa.list_(pa.float64()))], ["row_id", "terms", "ws"])

    return terms.rows.mapInArrow(run, f"row_id {_kind(terms.rows)}, terms array<string>, ws array<double>")


def tfidf(terms: Terms, rows: DataFrame, size: int) -> DataFrame:
    """(row_id, term, w): ``weighted`` over the ``size`` most frequent terms of the training rows. Terms are made twice,
    for the vocabulary and for the weights, as they are many times the size of the texts and would be written otherwise."""
    vocab = vocabulary(term_counts(terms.where("source_split = 'train'")), size)
    return weighted(terms, rows, vocab).select("row_id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("ws").alias("w")))).toDF("row_id", "term", "w")


def union_features(parts: dict[str, DataFrame]) -> DataFrame:
    """Feature tables side by side: terms carry the name of their part."""
    out = None
    for name, part in parts.items():
        named = part.select("row_id", F.concat(F.lit(f"{name}:"), "term").alias("term"), "w")
        out = named if out is None else out.union(named)
    return out


def text_vectors(rows: DataFrame, words: int = 60_000, chars: int = 80_000) -> tuple[DataFrame, DataFrame, int]:
    """(vectors, weights, width): ``rows(row_id, text, label, source_split)`` with their sparse features idx and w (word
    and character TF-IDF side by side, vocabulary and idf from train rows), the same as (row_id, idx, w), and the
    number of features, from ``text_counts``. Models are fitted on its blocks, which are a small part of these tables."""
    counts = text_counts(rows, words, chars)
    out = counts.vectors()
    return out, out.select("row_id", F.inline(F.arrays_zip("idx", "w"))), counts.width


def fit_text(method: str, train: DataFrame | TextCounts, strength: float, n_classes: int, width: int, start: np.ndarray | None = None):
    """A fitted baseline on ``text_counts`` or rows of ``text_vectors`` (or ``linear.packed`` ones). ``strength`` is C for the linear models
    (the loss of all rows times C, plus half the squared weights; steps begin at ``start``) and the smoothing of naive Bayes."""
    from . import linear

    train = train.blocks() if isinstance(train, TextCounts) else train
    return linear.bayes(train, n_classes, width, strength) if method == "bayes" else linear.fit(train, method, n_classes, width, strength, start=start)


def predict_text(model, rows: DataFrame | TextCounts) -> DataFrame:
    """(row_id, y, label, probabilities)."""
    from . import linear

    return linear.predict(model, rows.blocks() if isinstance(rows, TextCounts) else rows)


def optimality(model, train: DataFrame, weights: DataFrame, strength: float) -> DataFrame:
    """(steepest): the largest slope of the logistic objective at the fitted weights, from the feature table: per class
    and feature the mean of residual times feature, plus the weight's own pull; 0 where they are optimal."""
    import pandas as pd

    n, coefficients = train.count(), model.weights
    k, width = coefficients.shape[0], coefficients.shape[1] - 1

    @F.pandas_udf("double")
    def pull(c, idx):
        return pd.Series(coefficients[c.to_numpy(), idx.to_numpy()] / (strength * n))

    residuals = [(F.get("probabilities", c) - (F.col("y") == c).cast("double")).alias(f"r{c}") for c in range(k)]
    rows = materialized(predict_text(model, train).select("row_id", *residuals), "residuals")
    slopes = weights.join(rows, "row_id").groupBy("idx").agg(*[(F.sum(F.col("w") * F.col(f"r{c}")) / n).alias(f"s{c}") for c in range(k)])
    grid = train.sparkSession.range(width).select(F.col("id").cast("int").alias("idx"))
    per = grid.join(slopes, "idx", "left").select("idx", F.posexplode(F.array(*[F.coalesce(f"s{c}", F.lit(0.0)) for c in range(k)])).alias("c", "slope"))
    whole = per.select(F.abs(F.col("slope") + pull("c", "idx")).alias("slope"))
    free = rows.agg(F.greatest(*[F.abs(F.sum(f"r{c}") / n) for c in range(k)]).alias("slope"))
    return whole.union(free).agg(F.max("slope").alias("steepest"))


def tuned(rows: DataFrame, candidates: list[tuple[str, float]], n_classes: int, per_class: int | None = None, seed: int = 42, words: int = 60_000, chars: int = 80_000) -> tuple[DataFrame, DataFrame]:
    """(predictions, trials) of ``rows(row_id, text, label, split)`` with splits train, validation and test. Each
    candidate (method, strength) is fitted on train rows and scored by macro-F1 on validation rows; the first best
    one predicts the test rows. With ``per_class`` that many train rows of every class are selected, and of each
    method only the candidate of strength 1 is fitted, as validation labels are no part of such a budget. The
    vocabulary comes from the rows trained on; test labels are not looked at. Predictions carry the mean seconds
    a row of the transform and prediction took."""
    import time

    from .prep import select_examples
    from .score import confusion, scores

    if per_class is not None:
        # texts are not ranked: ``per_class`` ids of every class are, and a table of so many rows is broadcast
        picks = select_examples(rows.where("split = 'train'").select("row_id", "label"), per_class, seed).select("row_id", "label").distinct()
        train = rows.where("split = 'train'").join(F.broadcast(picks), ["row_id", "label"], "left_semi")
        rows = train.unionByName(rows.where("split = 'test'"))
        candidates = [c for c in candidates if c[1] == 1.0]
    if rows.where("split = 'train'").select("label").distinct().count() != n_classes:
        raise ValueError("training rows must cover every class")
    counts = text_counts(rows.withColumnRenamed("split", "source_split"), words, chars)
    train, validation, test = (counts.where(s) for s in ("train", "validation", "test"))
    spark, trials, best = rows.sparkSession, [], None
    # the optimum is one, so a fit may begin at the weights of the method's last candidate
    last: dict[str, np.ndarray] = {}
    for k, (method, strength) in enumerate(candidates):
        model, value = fit_text(method, train, strength, n_classes, counts.width, last.get(method)), None
        last[method] = model.weights
        if per_class is None:
            out = predict_text(model, validation).select(F.lit(str(k)).alias("run_id"), "y", F.col("label").alias("pred"))
            value = scores(confusion(out, n_classes)).first()["macro_f1"]
        if best is None or (value is not None and value > best[0]):
            best = (value, k, model)
        trials.append((k, method, strength, value))
    began = time.perf_counter()
    predictions = materialized(predict_text(best[2], test), "text-predictions")
    latency = (time.perf_counter() - began) / max(predictions.count(), 1)
    told = spark.createDataFrame([(*t, t[0] == best[1]) for t in trials], "trial int, method string, strength double, macro_f1 double, chosen boolean")
    return predictions.withColumn("latency_s", F.lit(latency)), told


def fit_predict_native(train: DataFrame, test: DataFrame, trees: int = 200, depth: int = 30) -> DataFrame:
    """(row_id, y, label) of a forest on the imputed numeric and one-hot categorical features, by Spark ML: every level of
    its trees passes over all rows once for each tree. ``forest.forest`` grows the same kind of forest from counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    a, b = standardize(train, train, "acctbal"), standardize(test, train, "acctbal")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=42)
    stages = [StringIndexer(inputCol="nation", outputCol="level", handleInvalid="keep"), OneHotEncoder(inputCol="level", outputCol="hot"), VectorAssembler(inputCols=["z", "hot"], outputCol="features"), forest]
    out = Pipeline(stages=stages).fit(a).transform(b)
    return out.select("row_id", F.col("label").alias("y"), F.col("prediction").cast("int").alias("label"))
