"""Packed counts against plain counting, and what they leave on disk."""

from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import features, linear, prep, terms

RNG = np.random.default_rng(8)
SCHEMA = "row_id long, text string, label int, source_split string"


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    words = ["ab", "abc", "né", "x", "ÄPFEL", "zwölf,", "q_1", "tree", "river;", "日本語", "𝔘𝔫", "a\tb"]
    return [(k, " ".join(rng.choice(words, rng.integers(0, 30))), int(k % 3), "train" if k % 4 else "test") for k in range(n)]


def test_packed_numbers_come_back():
    sizes = np.array([0, 3, 1, 0, 2])
    idx, tf = np.array([0, 65_535, 300_000, 131_071, 5, 65_542]), np.array([1, 300, 2, 1, 7, 1])
    for own in (tf, np.minimum(tf, 255)):
        got_sizes, got_idx, got_tf = terms.unpack(*terms.pack(sizes, idx, own), 10)
        keep = got_tf > 0
        assert got_idx[keep].tolist() == (idx + 10).tolist() and got_tf[keep].tolist() == own.tolist()
        assert np.bincount(np.repeat(np.arange(5), got_sizes)[keep], minlength=5).tolist() == sizes.tolist()
    assert [len(x) for x in terms.unpack(*terms.pack(sizes[:1], idx[:0], tf[:0]))] == [1, 0, 0]


@pytest.mark.parametrize("chars", [1 << terms.BITS, 2])
def test_grams_by_key_and_by_text(spark, monkeypatch, chars):
    """Both ways of looking up grams count as a plain loop does; so do both ways of counting pairs."""
    monkeypatch.setattr(terms, "NUMBERED", 8 if chars > 2 else 0)
    monkeypatch.setattr(terms, "_keyed", lambda low, high: chars > 2)
    rows = texts(60)
    counts = terms.text_counts(spark.createDataFrame(rows, SCHEMA), 25, 60)
    grams, plain, df = Counter(), Counter(), Counter()
    for _, text, _, split in rows:
        own = [w for w in text.lower().replace("\t", " ").split(" ") if w]
        words = [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split() if len(w) > 1]
        found = Counter(g for w in own for g in terms.grams_of(w, 3, 5)), Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
        if split == "train":
            grams.update(found[0])
            plain.update(found[1])
            df.update([*(("g", t) for t in found[0]), *(("w", t) for t in found[1])])
    top = lambda c, n: sorted(sorted(c, key=lambda t: (-c[t], t.encode()))[:n], key=str.encode)
    assert counts.grams == top(grams, 60) and counts.words == top(plain, 25)
    n = sum(r[3] == "train" for r in rows)
    assert np.allclose(counts.idf, [np.log((1 + n) / (1 + df[t])) + 1 for t in [*(("g", t) for t in counts.grams), *(("w", t) for t in counts.words)]])


def test_repeated_ids_are_one_row_with_labels_counted_apart(spark):
    rows = [(1, "ab cd ab cd", 0, "train"), (1, "cd ef", 1, "train"), (2, "ab zz", None, "test"), (3, None, 0, "train"), (4, "cd cd", 0, "train")]
    counts = terms.text_counts(spark.createDataFrame(rows, SCHEMA), 20, 0)
    got = counts.vectors().collect()
    assert sorted((r.row_id, -1 if r.y is None else r.y, len(r.idx)) for r in got) == [(1, 0, 7), (1, 1, 7), (2, -1, 1), (3, 0, 0), (4, 0, 2)]
    assert all(abs(sum(w * w for w in r.w) - 1) < 1e-9 for r in got if r.idx) and counts.rows == 4
    want = {r.row_id: r.label for r in terms.naive_bayes(counts).collect()}
    assert want == {2: 0}


def test_fits_on_blocks_are_fits_on_rows(spark):
    counts = terms.text_counts(spark.createDataFrame(texts(80), SCHEMA), 40, 200)
    train, rows = counts.where("train"), counts.vectors().where("source_split = 'train'")
    for method in ("logistic", "svm", "bayes"):
        a, b = (features.fit_text(method, x, 1.0, 3, counts.width) for x in (train, rows))
        assert np.abs(a.weights - b.weights).max() < 1e-6
        told = [sorted((r.row_id, r.y, r.label) for r in features.predict_text(a, x).collect()) for x in (counts.where("test"), counts.vectors().where("source_split = 'test'"))]
        assert told[0] == told[1] and len(told[0]) == 20
    model = features.fit_text("logistic", train, 1.0, 3, counts.width)
    assert linear.steepest(model, train.blocks(), 1.0).first().steepest <= 1.01e-5
    model.weights[0, 3] += 1
    assert linear.steepest(model, train.blocks(), 1.0).first().steepest > 1e-3


def test_steps_leave_little_on_disk(spark):
    """Less is written than the weights of the terms take, and no step leaves shuffle files behind."""
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(base.glob("*"))
    held = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    rng = np.random.default_rng(2)
    rows = [(k, " ".join("".join(chr(97 + c) for c in rng.integers(0, 12, 7)) for _ in range(400)), k % 2, "train") for k in range(60)]
    counts = terms.text_counts(spark.createDataFrame(rows, SCHEMA), 20_000, 40_000)
    kept = held()
    assert features.fit_text("logistic", counts, 1.0, 2, counts.width).steps > 1 and held() <= kept + 1  # the count of rows
    entries = counts.vectors().agg(F.sum(F.size("idx"))).first()[0]
    size = sum(p.stat().st_size for f in set(base.glob("*")) - before for p in f.rglob("*.parquet") if not f.name.startswith("word-totals"))
    assert entries > 60_000 and size < 4 * entries


def test_splits_follow_ids_without_a_shuffle_of_texts(spark, monkeypatch):
    rows = [(k, t.lower(), t.lower(), y, s) for k, t, y, s in texts(90, 5)]
    rows = spark.createDataFrame(rows, "row_id long, text string, norm string, label int, source_split string")
    want = sorted((r.row_id, r.label, r.split, r.text) for r in prep.prepare(rows, 3).where("split is not null").collect())
    for most in (prep.SENT_IDS, 0):
        monkeypatch.setattr(prep, "SENT_IDS", most)
        out = prep.prepared_texts(rows, 3)
        assert sorted((r.row_id, r.label, r.split, r.text) for r in out.collect()) == want and {r[2] for r in want} == {"train", "validation", "test"}
        assert most == 0 or "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
