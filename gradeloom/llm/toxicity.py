"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon is learned from a bounded sample of labelled rows: words, and word beginnings, that almost
only toxic documents hold. It becomes a trie; walking the trie together with the Levenshtein automaton
of one edit, and making the pairs deterministic, gives one table (state x character). Tokens of a batch
run through that table side by side. A token is an exact term, has a term's beginning, or is one edit
from a term. Around each hit a context window looks for quotation marks and words of reported speech,
so that quoting a term counts apart from using it. A logistic regression over the counts per document,
fitted on the same sample with the classes' sampling rates undone, gives the score.

The sample's bounds (``TRAIN_ROWS`` a class) are documented parameters of the fit. The lexicon has every term
that the sample bears out, words of two characters or more: a term needs ``MIN_ROWS`` toxic documents of the
sample and ``MIN_SHARE`` of them, so it cannot outgrow the sample. Scoring covers every whole text, and what
is broadcast has the lexicon's size.

Defined results: null and empty texts score as a document without any hit; without labelled rows of
both classes nothing is toxic (score 0); a doc_id that is labelled both toxic and not takes no part in the
fit, equal labels of one doc_id count once; repeated rows are scored alike; an empty table gives an empty
result; further columns are kept by ``drop_toxic`` and ignored by the report.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import held_out
from .text_batches import chunks, code_points, slices, texts_of

TRAIN_ROWS = 6000
MIN_SHARE = 0.005
MIN_ROWS = 4
MIN_PRECISION = 0.9
LEAST_CHARS = 2
STEM = 4
THRESHOLD = 0.3
WINDOW = 24
#: A token of the lower-cased text: letters, digits, '_', '@' and '$', in any script.
TOKEN = re.compile(r"[\w@$]+")
QUOTES = "\"'«»“”„‘’‹›"
#: Words of reported speech.
REPORTS = re.compile(r"\b(said|says|say|called|calls|quote|quoted|wrote|word|term|insult|sagte|nannte|zitat|wort|dit|appelé|cita|dijo|llamó|palabra|mot)\b")
NONE, FUZZY, STARTS, EXACT = 0, 1, 2, 3


# ---- lexicon -------------------------------------------------------------------------------------


def _candidates(batches):
    """Document frequencies by label of words (mark '=') and of word beginnings (mark '^')."""
    import pandas as pd

    held: tuple[Counter, Counter] = (Counter(), Counter())
    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            words = {w for w in TOKEN.findall((text or "").lower()) if len(w) >= LEAST_CHARS}
            held[int(toxic)].update({"=" + w for w in words} | {"^" + w[:k] for w in words for k in (STEM, STEM + 1, STEM + 2) if len(w) > k})
    terms = list(held[0].keys() | held[1].keys())
    yield pd.DataFrame({"term": terms, "pos": [held[1][t] for t in terms], "neg": [held[0][t] for t in terms]})


def learn_lexicon(sample: DataFrame, n_pos: int) -> list[str]:
    """Terms ('=word' or '^beginning') with enough toxic documents and hardly any other."""
    least = max(MIN_ROWS, int(MIN_SHARE * n_pos))
    rows = sample.mapInPandas(_candidates, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = rows.where((F.col("pos") >= least) & (F.col("pos") >= MIN_PRECISION * (F.col("pos") + F.col("neg")))).collect()
    kept: list[str] = []
    words = {r["term"][1:]: r["pos"] for r in rows if r["term"][0] == "="}
    for r in sorted(rows, key=lambda r: (r["term"][0] == "^", len(r["term"]), r["term"])):
        mark, term = r["term"][0], r["term"][1:]
        if mark == "^":
            # a beginning earns its place by words beyond the listed one
            if any(term.startswith(k[1:]) for k in kept if k[0] == "^") or r["pos"] <= 1.2 * max([0, *(n for w, n in words.items() if w.startswith(term))]):
                continue
        kept.append(r["term"])
    # words that have a kept beginning stay beside it: only whole words are matched with an edit
    return sorted(kept)


# ---- trie x automaton ----------------------------------------------------------------------------


def compile_automaton(terms: list[str], edits: int = 1) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(symbol of each character, transitions[state, symbol], verdict[state]).

    A position is (trie node, edits so far); a state is a set of positions. Symbol 0 is any character
    outside the lexicon; state 0 is dead, state 1 the start. Terms under 5 characters match exactly.
    """
    nodes, ends, size, depth = [{}], [0], [0], [0]
    for t in terms:
        node = 0
        for c in t[1:]:
            if c not in nodes[node]:
                nodes[node][c] = len(nodes)
                nodes.append({})
                ends.append(0)
                size.append(0)
                depth.append(depth[node] + 1)
            node = nodes[node][c]
            size[node] = max(size[node], len(t) - 1)
        size[0] = max(size[0], len(t) - 1)
        ends[node] |= 1 if t[0] == "=" else 2
    alphabet = sorted({c for t in terms for c in t[1:]})
    symbols = {c: k + 1 for k, c in enumerate(alphabet)}

    def close(pos: frozenset) -> frozenset:
        out, todo = set(pos), list(pos)
        while todo:
            n, e = todo.pop()
            if n >= 0 and e < edits:
                for m in nodes[n].values():
                    if size[m] >= 5 and (m, e + 1) not in out:
                        out.add((m, e + 1))
                        todo.append((m, e + 1))
        return frozenset(p for p in out if p[0] < 0 or not any((p[0], e) in out for e in range(p[1])))

    def step(pos: frozenset, c: str | None) -> frozenset:
        out = set()
        for n, e in pos:
            if n < 0:
                out.add((n, e))  # a beginning has been seen: the rest of the token is free
                continue
            for d, m in nodes[n].items():
                if d == c:
                    out.add((m, e))
                elif e < edits and size[m] >= 5:
                    out.add((m, e + 1))
            # an inserted character, before the first one too
            if e < edits and size[n] >= 5:
                out.add((n, e + 1))
        out |= {(-1, e) for n, e in out if n > 0 and ends[n] & 2 and e == 0}
        return close(frozenset(out))

    def verdict(pos: frozenset) -> int:
        best = NONE
        for n, e in pos:
            if n < 0:
                best = max(best, STARTS)
            elif ends[n]:
                near = FUZZY if depth[n] >= 5 else NONE
                best = max(best, (EXACT if e == 0 else near) if ends[n] & 1 else (STARTS if e == 0 else NONE))
        return best

    start = close(frozenset({(0, 0)}))
    ids, rows, todo = {frozenset(): 0, start: 1}, [[0] * (len(alphabet) + 1)], [start]
    for pos in todo:
        row = []
        for c in (None, *alphabet):
            nxt = step(pos, c)
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            row.append(ids[nxt])
        rows.append(row)
    return symbols, np.array(rows, np.int32), np.array([verdict(p) for p in ids], np.int8)


def match_tokens(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, automaton) -> np.ndarray:
    """Verdict of each token points[start:end]; tokens that die drop out at every step."""
    symbols, table, verdicts = automaton
    out = np.zeros(len(starts), np.int8)
    # up to the lexicon's last character, and one place for all beyond
    lookup = np.zeros(max([0, *map(ord, symbols)]) + 2, np.int32)
    for c, k in symbols.items():
        lookup[ord(c)] = k
    coded = lookup[np.minimum(points, len(lookup) - 1)]
    live, state, t = np.arange(len(starts)), np.ones(len(starts), np.int32), 0
    while len(live):
        state = table[state, coded[starts[live] + t]]
        t += 1
        done = ends[live] - starts[live] == t
        out[live[done]] = verdicts[state[done]]
        on = ~done & (state > 0)
        live, state = live[on], state[on]
    return out


# ---- features and model --------------------------------------------------------------------------


def word_points(points: np.ndarray) -> np.ndarray:
    """Which code points belong to words, by the same classes as ``TOKEN`` in any script."""
    classes = np.zeros(0x250, bool)
    classes[[c for c in range(0x250) if TOKEN.match(chr(c))]] = True
    out = classes[np.minimum(points, 0x24F)]
    high = np.flatnonzero(points >= 0x250)
    if len(high):
        some, at = np.unique(points[high], return_inverse=True)
        out[high] = np.array([bool(TOKEN.match(chr(c))) for c in some])[at]
    return out


def features(texts: list[str], automaton) -> np.ndarray:
    """Per text: log counts of exact, beginning, fuzzy and quoted hits, whether any, hits per word."""
    out = np.zeros((len(texts), 8))
    lowered = [(t or "").lower() for t in texts]
    for a, b in chunks(lowered):
        joined = "\n".join(lowered[a:b])
        points, _ = code_points([joined])
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered[a:b]])])
        word = word_points(points)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        doc = np.searchsorted(offsets, starts, "right") - 1
        words = np.bincount(doc, minlength=b - a)
        found = match_tokens(points, starts, ends, automaton)
        hits = np.flatnonzero(found)
        counts = np.zeros((b - a, 4))
        for h in hits:
            d, s, e = doc[h], starts[h], ends[h]
            window = joined[max(offsets[d], s - WINDOW) : min(offsets[d + 1] - 1, e + WINDOW)]
            near = joined[max(offsets[d], s - 2) : s] + joined[e : min(e + 2, offsets[d + 1] - 1)]
            quoted = any(c in QUOTES for c in near) or bool(REPORTS.search(window))
            counts[d, 3 if quoted else EXACT - found[h]] += 1
        out[a:b, :4] = np.log1p(counts)
        out[a:b, 4:7] = counts[:, :3] > 0
        out[a:b, 7] = counts[:, :3].sum(axis=1) / np.maximum(words, 1) * 10
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Newton's method with a ridge penalty (none on the intercept)."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty
        move = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of about ``train_rows`` labelled rows a class, and each class's sampling rate."""
    marked = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("most"))
    marked = marked.where("toxic = most").drop("most")
    per = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rates = {k: min(1.0, train_rows / n) for k, n in per.items()}
    lot = F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id")), F.lit(1_000_000)) / 1e6
    rate = F.when(F.col("toxic") == 1, rates.get(1, 0.0)).otherwise(rates.get(0, 0.0))
    # at most about 2 x train_rows ids: a bounded side
    chosen = F.broadcast(marked.where(lot < rate))
    return docs.join(chosen, "doc_id").select("text", "toxic").dropDuplicates(["text", "toxic"]), rates


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """(automaton, weights), or None without both classes."""
    from .shared import materialize

    sample, rates = training_sample(docs, labels, train_rows)
    sample = materialize(sample.repartition(16), "toxic-sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    automaton = compile_automaton(learn_lexicon(sample, n[1]))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            f = features([t if isinstance(t, str) else "" for t in pdf["text"]], automaton)
            yield pd.DataFrame({"toxic": pdf["toxic"], "f": list(f)})

    rows = sample.mapInPandas(run, "toxic int, f array<double>").toPandas()
    y = rows["toxic"].to_numpy(float)
    weight = np.where(y == 1, 1 / rates[1], 1 / rates[0])
    return automaton, fit_logistic(np.stack(rows["f"].to_numpy()), y, weight / weight.mean())


def toxic_scores(texts: list[str], model) -> np.ndarray:
    """Scores from 0 to 1 by a fitted model; 0 without one."""
    if not model:
        return np.zeros(len(texts))
    automaton, w = model
    return 1 / (1 + np.exp(-np.clip(w[0] + features(texts, automaton) @ w[1:], -30, 30)))


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows))

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            s = toxic_scores(texts_of(part), model.value)
            columns = [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` not predicted toxic, with all their columns; they stay Arrow batches throughout."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            yield part.filter(pa.array(toxic_scores(texts_of(part), model.value) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
