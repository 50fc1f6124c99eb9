"""Hard negatives, centroid clustering and token counts: edge cases, brute force and the public library."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.llm import clustering, hard_negatives, token_counts
from gradeloom.llm.token_records import tokenizer_path

DATA = "/root/testdata/sf0.001"
PLACE = tokenizer_path(token_counts.MODEL)
VECTORS = "vec_id long, embedding array<float>, label int, v int, chunk long, cluster string"


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PLACE)


def odd_vectors(n, dims, seed, labels=3):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(dims)], rng.randrange(labels)) for k in range(n)]
    same = [0.25] * dims
    rows += [(n + k, same, 0) for k in range(n // 3)]  # many alike
    rows += [rows[0], rows[0], rows[100 % n], (None, [0.1] * dims, 1), (None, [0.1] * dims, 1)]
    bad = [(900, None, 1), (1000, [0.1] * (dims - 1) + [None], 1), (1100, [math.nan] * dims, 2), (1200, [0.1] * (dims - 1) + [math.inf], 2), (1300, [0.2] * dims, None), (1400, [], 1), (1500, [0.5], 1), (1600, [0.5], 1), (1601, [0.4], 2)]
    return [(*r, 7, 8, "x") for r in rows + bad]


def whole(x, scale):
    x = [np.float32(c) if c is not None else None for c in x] if x is not None else None
    if x is None or any(c is None or not np.isfinite(c) for c in x):
        return None
    return [math.floor(scale * float(c)) for c in x]


def plain_negatives(rows, every):
    kept = []
    for i, x, label, *_ in rows:
        v = whole(x, 256)
        if v is not None and label is not None:
            kept.append((i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out, order = [], lambda r: (-r[1], r[0] is None, r[0] or 0)
    for k, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(j, sum(a * b for a, b in zip(v, w, strict=True)), other) for m, (j, w, other) in enumerate(kept) if m != k and len(w) == len(v)]
        for p, ps, _ in sorted((r for r in scored if r[2] == label), key=order)[:5]:
            found = sorted((r for r in scored if r[2] != label and 30 * ps <= 100 * r[1] <= 90 * ps), key=order)[:10]
            out += [(i, p, rank, j, ps, s) for rank, (j, s, _) in enumerate(found, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("sizes", [(512, 256), (7, 3)])
def test_hard_negatives_against_plain_python(spark, sizes):
    rows = odd_vectors(260, 6, 3)
    frame = spark.createDataFrame(rows, VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    some = clustering.integer_vectors(frame.where("label IS NOT NULL"), 256, None, label=label)
    got = hard_negatives.hard_negatives(some, F.col("vec_id") % 20 == 0, *sizes)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_negatives(rows, 20)


def test_packed_scores_of_any_width():
    rng = np.random.default_rng(5)
    for reach in (1, 30, 300, 1 << 14, 1 << 24):
        a, v = rng.integers(-reach, reach + 1, (9, 12)), rng.integers(-reach, reach + 1, (31, 12))
        norm2 = float(max((a.astype(object) ** 2).sum(axis=1).max(), (v.astype(object) ** 2).sum(axis=1).max()))
        packed = hard_negatives.Packed(norm2, int(v.min()))
        assert packed.fields >= 1 and (reach > 30 or packed.fields > 2)
        assert (packed.scores(np.ascontiguousarray(a), packed.pack(v), 31) == a @ v.T).all()


def test_vectors_without_rows(spark):
    for rows in ([], [(1, None, 1, 7, 8, "x")], [(100, [0.5] * 64, 1, 7, 8, "x")]):
        frame = spark.createDataFrame(rows, VECTORS)
        some = clustering.integer_vectors(frame, 256, None, label=F.col("label").cast("long"))
        assert hard_negatives.hard_negatives(some, F.col("vec_id") % 100 == 0).count() == 0
        got = clustering.cluster(frame).collect()
        assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in got] == ([(100, 0, 0, 0)] if rows and rows[0][1] else [])


def plain_clusters(rows, k, rounds, scale, dims):
    kept = [(i, v) for i, x, *_ in rows if x is not None and len(x) == dims and (v := whole(x, scale)) is not None]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(x) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {n: sum(r[2] for r in found if r[1] == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(str((i, n, far, per[n], sum(per.values()), sha[n])) for i, n, far in found)


@pytest.mark.parametrize("k, block_rows", [(5, 256), (16, 9), (400, 32)])
def test_clusters_against_plain_python(spark, k, block_rows):
    rows = odd_vectors(230, 6, 4)
    got = clustering.cluster(spark.createDataFrame(rows, VECTORS), k=k, dims=6, block_rows=block_rows).drop("compared").collect()
    assert sorted(str(tuple(r)) for r in got) == plain_clusters(rows, k, 3, 64, 6)


def test_boxes_leave_out_far_centroids_only():
    rng = np.random.default_rng(2)
    for scale in (50, 1 << 20):
        centroids = rng.integers(-scale, scale, (12, 5))
        axes = np.linalg.qr(rng.normal(size=(5, 5)))[0]
        zones, left = clustering.Zones(centroids.tolist(), axes, scale), []
        assert zones.exact == (scale == 50 or zones.exact)
        for _ in range(60):
            points = rng.integers(-scale, scale, (1, 5)) + rng.integers(-scale // 20 - 1, scale // 20 + 2, (40, 5))
            turned = points @ axes
            lo, hi = turned.min(axis=0), turned.max(axis=0)
            label, far, n = zones.nearest(points, lo, hi)
            every = ((points[:, None] - centroids) ** 2).sum(axis=2)
            assert (label == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
            left.append(n)
        assert np.mean(left) < 6


def test_clustered_vectors_are_compared_with_few_centroids(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(16, 64))
    rows = [(k, (centres[k % 16] + rng.normal(size=64) * 0.05).tolist(), 0, 7, 8, "x") for k in range(4000)]
    # a vector of each centre comes first
    got = clustering.cluster(spark.createDataFrame(rows, VECTORS), block_rows=64)
    assert got.agg(F.avg("compared")).first()[0] < 8


def test_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        size = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(size)] * n), -1).reshape(-1, n)
        order = np.argsort(clustering.curve_places(cells, bits))
        assert sorted(clustering.curve_places(cells, bits).tolist()) == list(range(size**n))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_components_beyond_64_bits_are_refused(spark):
    frame = spark.createDataFrame([(0, [1e30] * 64, 1, 7, 8, "x"), (1, [0.1] * 64, 1, 7, 8, "x")], VECTORS)
    with pytest.raises(ValueError):
        clustering.cluster(frame)
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(clustering.integer_vectors(frame, 256, None, label=F.col("label").cast("long")), F.col("vec_id") == 0)


@pytest.mark.parametrize("module", [clustering, hard_negatives])
def test_sql(spark, module):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    for name, f in module.QUERIES.items():
        got, want = f(spark, DATA), con.sql(module.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(getattr(v, "item", lambda v=v: v)() for v in r)) for r in want[columns].itertuples(index=False))


def test_token_counts_of_the_table(spark, library):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = token_counts.op12_token_counts(spark, DATA).collect()
    assert len(got) == len(rows)
    for r in got:
        n = len(library.encode(rows[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 4096)


def test_token_counts_on_edge_cases(spark, library):
    texts = [None, "", " ", "   \n\n  x", "\t\r\n", "<s> </s> <unk> <0x41>", "▁ a▁b", "你好 🤦🏼‍♂️ ﬁ É \x00  ", "a" * 70_000, " " * 999 + "b", "x " * 3000, "wort" * 5000]
    rows = [(k, t, 1, 2, True) for k, t in enumerate(texts)] + [(None, "null id", 1, 2, True), (1, "same id", 1, 2, True), (1, "same id", 1, 2, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, n_tokens int, over_limit boolean")
    got = sorted(map(str, map(tuple, token_counts.token_counts(docs, limit=10).collect())))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 10) for i, t, *_ in rows]
    assert got == sorted(map(str, want))
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_long_texts_come_in_runs_and_stretches(monkeypatch, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice("のにをはがで日本語abc") for _ in range(3000)), "".join(rng.choice(["the ", "  and\n", "xyz"]) for _ in range(2000)), "abab" * 700, "0" * 2500]
    monkeypatch.setattr(token_counts, "CELLS", 64)
    monkeypatch.setattr(token_counts, "CACHE_CHARS", 300)
    merges = token_counts.Merges(PLACE)
    assert merges.n_tokens(texts) == [len(library.encode(t)) for t in texts]
    assert merges.held < 2000 and all(len(w) <= token_counts.LONG for w in merges.cache)


def test_pieces_strung_together(library):
    merges, rng = token_counts.Merges.of(PLACE), random.Random(6)
    pieces = [p for p in merges.rank if len(p) > 1]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.choice([2, 3, 8, 60]))).replace("▁", rng.choice([" ", ""])) for _ in range(3000)]
    texts += ["".join(rng.choice(some) for _ in range(rng.choice([5, 40, 300]))) for some in ("ab", "aab ", "the in", "=-", "01", "аеиост", "xX\n") for _ in range(60)]
    assert merges.n_tokens(texts) == [len(library.encode(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab e\n▁"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    from sentencepiece import SentencePieceProcessor

    assert token_counts.Merges.of(PLACE).n_tokens([text]) == [len(SentencePieceProcessor(model_file=PLACE).encode(text))]


def test_other_models_are_refused(monkeypatch):
    class Unigram:
        def __init__(self, model_file):
            pass

        get_piece_size = lambda self: 3
        is_byte = is_control = is_unknown = lambda self, k: False
        id_to_piece = lambda self, k: ["a", "b", "ab"][k]
        get_score = lambda self, k: -1.5

    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Unigram)
    with pytest.raises(ValueError):
        token_counts.Merges("any")
