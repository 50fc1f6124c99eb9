"""Language ID: multinomial naive Bayes over hashed character n-grams.

Grams of 2 and 3 characters of the lower-cased text hash into ``BUCKETS``. Training counts them per
language over a bounded sample of labelled rows: each language's rows are thinned by a hash of doc_id
to about ``TRAIN_ROWS`` (a documented parameter; it binds the fit alone). The model, one row of log
probabilities per language, is broadcast. It has all languages: where languages x BUCKETS pass ``CELLS``,
grams share half as many buckets, and so on down to ``LEAST_BUCKETS``, so the broadcast stays at 64 MB up
to 32,768 languages (more are an error). Scoring gathers the grams of a batch from it and sums them per
text, on top of the log of each language's share of the labelled rows; whole texts always, long ones piece
by piece, so that a batch has about a million characters however long a text is.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the
language that sorts first; without training rows everything is ``und``; repeated rows are scored
alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_batches import BATCH_CHARS, chunks, code_points, slices

BUCKETS = 1 << 15
TRAIN_ROWS = 1500
CELLS = 1 << 23
LEAST_BUCKETS = 256
SMOOTHING = 0.1
MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _grams(points: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the gram that starts at each place (the last order - 1 have none)."""
    n = max(0, len(points) - order + 1)
    h = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ points[k : k + n]) * MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
    return (h % np.uint32(buckets)).astype(np.int32)


def _padded(texts: list[str]) -> list[str]:
    return [f" {t.lower()} " for t in texts]


def _pieces(texts: list[str], limit: int) -> tuple[list[int], list[str], list[int]]:
    """Texts in pieces of about ``limit`` characters: (text of each piece, the piece with the two characters behind
    it, how many of its characters start grams of their own). Every piece has three characters at least."""
    owner, piece, own = [], [], []
    for k, t in enumerate(texts):
        first = 0
        while len(t) - first > limit + 2:
            owner.append(k)
            piece.append(t[first : first + limit + 2])
            own.append(limit)
            first += limit
        owner.append(k)
        piece.append(t[first:])
        own.append(len(t) - first)
    return owner, piece, own


def _count(batches, buckets: int):
    """Gram counts per language of a partition, as sparse rows."""
    import pandas as pd

    held: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, rows in pdf.groupby("lang")["text"]:
            total = held.setdefault(lang, np.zeros(buckets, np.int64))
            _, texts, own = _pieces(_padded(list(rows)), BATCH_CHARS)
            for t, n in zip(texts, own, strict=True):
                points, _ = code_points([t])
                for order in (2, 3):
                    total += np.bincount(_grams(points, order, buckets)[:n], minlength=buckets)
    for lang, total in held.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})


def training_sample(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, dict[str, int]]:
    """(lang, text) of about ``train_rows`` rows a language, and the labelled rows of each language."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a row a language
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return rows.select("lang", "text").limit(0), per
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, train_rows / n)) for k, n in per.items()], "lang string, __rate double")
    lot = F.pmod(F.xxhash64(F.lit("lang"), F.col("doc_id")), F.lit(1_000_000)) / 1e6
    return rows.select("doc_id", "lang", "text").join(F.broadcast(rates), "lang").where(lot < F.col("__rate")).select("lang", "text"), per


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their log probabilities (languages x buckets) and their log priors."""
    sample, per = training_sample(docs, train_rows)
    if len(per) * min(LEAST_BUCKETS, buckets) > CELLS:
        raise ValueError("too many languages for one model")
    while len(per) * buckets > CELLS:
        buckets //= 2
    counts = sample.mapInPandas(lambda it: _count(it, buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((len(langs), buckets), SMOOTHING)
    place = {k: i for i, k in enumerate(langs)}
    table[counts["lang"].map(place).to_numpy(int), counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(float)
    prior = np.array([per[k] for k in langs], float)
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if len(langs) else table, np.log(prior / prior.sum()) if len(langs) else prior


def score_texts(texts: list[str | None], langs: list[str], table: np.ndarray, prior: np.ndarray, limit: int = BATCH_CHARS) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior for each text."""
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    live = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if langs else []
    owner, pieces, own = _pieces(_padded([texts[k] for k in live]), limit)
    total = np.repeat(prior[:, None], len(live), axis=1)
    for a, b in chunks(pieces, limit):
        points, at = code_points(pieces[a:b])
        for order in (2, 3):
            grams = _grams(points, order, table.shape[1])
            # grams across two pieces are left out, and those of characters that the next piece has again
            ends = np.minimum(at[:-1] + own[a:b], at[1:] - order + 1)
            cut = np.stack([at[:-1], ends], axis=1).ravel()
            last = len(cut) - 1 if cut[-1] == len(grams) else len(cut)
            for k in range(len(langs)):
                np.add.at(total[k], owner[a:b], np.add.reduceat(table[k][grams], cut[:last])[::2])
    if live:
        odds = np.exp(total - total.max(axis=0))
        best = total.argmax(axis=0)
        for j, k in enumerate(live):
            pred[k], score[k] = langs[best[j]], 1.0 / odds[:, j].sum()
    return pred, score


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, train_rows, buckets))

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            pred, score = score_texts(part.column("text").to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_language_id": op2_language_id}
ORACLE: dict[str, str] = {}
