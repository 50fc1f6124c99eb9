"""Token counts by rank-synchronous merging over ragged numpy arrays.

A batch's distinct pre-tokens (blanks with the word behind them) lie end to end in one array of symbols, one
symbol a character. They are cut wherever two characters stand side by side in no piece, which leaves sequences
that no merge can join. Each step then finds every sequence's lowest rank among its adjacent pairs and merges
that pair in all sequences at once; finished sequences leave the array, and what is counted is the symbols that
are left. Nothing is decoded to strings or ids.

Equal to merging one pair at a time, leftmost first:
* All places of a sequence's lowest pair merge in one step, every other one of overlapping places. Where a new
  piece could take part in a still lower rank than its own (a property of the vocabulary, found once), only the
  leftmost place merges.
* A long sequence does not wait for its single lowest pair: a pair merges if none within ``longest`` symbols on
  both sides ranks lower. An earlier merge would have to come in from outside that window, and a piece that
  grows inwards ends within ``longest`` characters of the edge.

Characters outside the model count as their UTF-8 bytes, as byte fallback gives them.

Defined results: null and empty texts have 0 bytes and 0 tokens; texts of blanks only count their pieces; the
strings of special pieces ("<s>") are ordinary text; repeated rows count alike; a null doc_id stays null; an
empty table gives an empty result; further columns are ignored. A text is taken whole, in runs of pre-tokens; a
pre-token without blanks is taken in stretches between cuts, so memory follows neither the text nor its words,
but for a stretch in which every two neighbours stand in some piece. Models other than BPE are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_batches import code_points, slices, texts_of
from .token_records import tokenizer_path

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BLANK = "▁"
PART = re.compile(" *[^ \n]+| +|\n")
#: Characters of pre-tokens that are merged together, and of a text whose pre-tokens are found together.
CELLS = 400_000
#: Characters of pre-tokens whose counts are remembered; longer ones than ``LONG`` are not.
CACHE_CHARS = 4_000_000
LONG = 96
NONE = np.int32(2**31 - 1)


class Merges:
    """The model's tables, made once per process. A merged piece is named by its rank, so that the rank of a
    pair is the symbol it becomes; characters come first."""

    _of: dict[str, Merges] = {}

    @classmethod
    def of(cls, path: str) -> Merges:
        return cls._of.get(path) or cls._of.setdefault(path, cls(path))

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        plain = [k for k in range(sp.get_piece_size()) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))]
        names, score = {k: sp.id_to_piece(k) for k in plain}, {k: sp.get_score(k) for k in plain}
        merged = sorted((k for k in plain if len(names[k]) > 1), key=lambda k: (-score[k], k))
        # merges of a BPE model are numbered; log probabilities of a unigram model are no whole numbers
        if any(score[k] != round(score[k]) for k in merged):
            raise ValueError(f"{path} is no BPE model")
        if any(BLANK in names[k].lstrip(BLANK) for k in merged):
            raise ValueError(f"{path} has pieces with a blank behind a character")
        chars = [k for k in plain if len(names[k]) == 1]
        self.rank = {names[k]: r for r, k in enumerate([*chars, *merged])}
        self.longest = max(map(len, self.rank))
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[[ord(names[k]) for k in chars]] = np.arange(len(chars))
        self.blank = self.rank.get(BLANK, -1)
        pairs, inside = {}, set()
        for piece, r in self.rank.items():
            inside.update(ord(a) << 21 | ord(b) for a, b in zip(piece, piece[1:], strict=False))
            for k in range(1, len(piece)):
                a, b = self.rank.get(piece[:k]), self.rank.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        self.inside = np.array(sorted(inside), np.int64)
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.merged = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(keys)] = True
        # pieces that a lower rank than their own can go on with
        self.hasty = np.zeros(len(self.rank), bool)
        for part in (keys >> 20, keys & (1 << 20) - 1):
            self.hasty[part[(part >= len(chars)) & (self.merged < part)]] = True
        self.cache: dict[str, int] = {}
        self.held = 0

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, ``NONE`` where they don't merge."""
        key = a.astype(np.int64) << 20 | b
        out = np.full(len(key), NONE, np.int32)
        may = np.flatnonzero(self.maybe[self._slot(key)])
        at = np.minimum(np.searchsorted(self.keys, key[may]), len(self.keys) - 1)
        hit = self.keys[at] == key[may]
        out[may[hit]] = self.merged[at[hit]]
        return out

    def _near(self, rank: np.ndarray) -> np.ndarray:
        """The lowest rank within ``longest`` places of each place."""
        side, size = np.full(self.longest, NONE), len(rank)
        low, width, whole = np.concatenate([side, rank, side]), 1, 2 * self.longest + 1
        while width < whole:
            step = min(width, whole - width)
            low, width = np.minimum(low[: len(low) - step], low[step:]), width + step
        return low[:size]

    def _chosen(self, rank: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Places to merge now: of places side by side with one rank every other one, from the first on."""
        lowest = (rank == low) & (rank != NONE)
        size = np.arange(len(rank))
        first = np.ones(len(rank), bool)
        first[1:] = rank[1:] != rank[:-1]
        first = np.maximum.accumulate(np.where(first, size, 0))
        # a place waits while one before it in its run waits
        waits = np.maximum.accumulate(np.where(lowest, -1, size))
        chosen = lowest & (waits < first) & ((size - first) % 2 == 0)
        hasty = np.flatnonzero(chosen & self.hasty[np.where(chosen, rank, 0)])
        if len(hasty):
            before = hasty[:, None] - np.arange(1, self.longest + 1)
            chosen[hasty[((rank[np.maximum(before, 0)] == rank[hasty, None]) & (before >= 0)).any(axis=1)]] = False
        return np.flatnonzero(chosen)

    def _merge(self, symbols: np.ndarray, seq: np.ndarray, long: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sequence, symbols left) of sequences as they end; ``seq`` numbers the sequence of each symbol."""
        rank = np.full(len(symbols), NONE, np.int32)
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(seq):
            start = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            size = np.diff(np.append(start, len(seq)))
            low = np.minimum.reduceat(rank, start)
            over = np.repeat(low == NONE, size)
            if over.any():
                yield seq[over], symbols[over]
                symbols, seq, rank = symbols[~over], seq[~over], rank[~over]
                low, size = low[low != NONE], size[low != NONE]
                if not len(seq):
                    break
            at = self._chosen(rank, self._near(rank) if long else np.repeat(low, size))
            symbols[at] = rank[at]
            keep = np.ones(len(seq), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, seq, rank, at = symbols[keep], seq[keep], rank[keep], place[at]
            # the pairs on both sides of a new symbol are new
            for k in (at, at[at > 0] - 1):
                rank[k] = NONE
                k = k[k + 1 < len(seq)]
                k = k[seq[k] == seq[k + 1]]
                rank[k] = self.ranks(symbols[k], symbols[k + 1])

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Whether no piece reaches across the gap before each character but the first."""
        key = points[:-1].astype(np.int64) << 21 | points[1:]
        return self.inside[np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)] != key

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        points, at = code_points(words)
        word = np.repeat(np.arange(len(words)), np.diff(at))
        begins = np.ones(len(points), bool)
        begins[1:] = self.cuts(points) | (word[1:] != word[:-1])
        seq = np.cumsum(begins) - 1
        of = word[begins]
        symbols = self.symbol[points.astype(np.int64)]
        known = symbols >= 0
        odd = points[~known]
        out = np.bincount(word[~known], 1 + (odd > 0x7F) + (odd > 0x7FF) + (odd > 0xFFFF), len(words)).astype(np.int64)
        long = np.bincount(seq, known, len(of))[seq] > 2 * self.longest
        for kind, some in ((False, known & ~long), (True, known & long)):
            for ended, _ in self._merge(symbols[some], seq[some], kind):
                out += np.bincount(of[ended], minlength=len(words))
        return out

    def _stretches(self, word: str) -> Iterator[str]:
        """A long pre-token in parts that no piece joins."""
        rest = ""
        for k in range(0, len(word), CELLS):
            rest += word[k : k + CELLS]
            cut = np.flatnonzero(self.cuts(code_points([rest])[0]))
            if len(cut):
                yield rest[: cut[-1] + 1]
                rest = rest[cut[-1] + 1 :]
        yield rest

    def learn(self, words: set[str]) -> None:
        fresh = words.difference(self.cache)
        self.held += sum(map(len, fresh))
        if self.held > CACHE_CHARS:
            # what this batch holds is kept, so frequent words stay
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
            self.held = sum(map(len, words))
        some, size = [], 0
        for w in sorted(fresh, key=len):
            if len(w) > CELLS:
                self.cache[w] = sum(int(self.count([s])[0]) for s in self._stretches(w.replace(" ", BLANK)) if s)
                continue
            if size + len(w) > CELLS:
                self.cache.update(zip(some, self.count([x.replace(" ", BLANK) for x in some]).tolist(), strict=True))
                some, size = [], 0
            some.append(w)
            size += len(w)
        if some:
            self.cache.update(zip(some, self.count([x.replace(" ", BLANK) for x in some]).tolist(), strict=True))

    def _forget_long(self, words: set[str]) -> None:
        for w in words:
            if len(w) > LONG and w in self.cache:
                del self.cache[w]
                self.held -= len(w)

    def n_tokens(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        texts = [" " + t.replace(BLANK, " ") if t else "" for t in texts]
        # a long text is taken run by run
        parts = [PART.findall(t) if len(t) <= CELLS else None for t in texts]
        words = set(chain.from_iterable(p for p in parts if p is not None))
        self.learn(words)
        get = self.cache.__getitem__
        out = [None if p is None else sum(map(get, p)) for p in parts]
        self._forget_long(words)
        for k, t in enumerate(texts):
            if out[k] is None:
                out[k], found = 0, PART.finditer(t)
                while part := [m.group() for m in islice(found, CELLS // 4)]:
                    words = set(part)
                    self.learn(words)
                    out[k] += sum(map(self.cache.__getitem__, part))
                    self._forget_long(words)
        return out


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row."""
    place = tokenizer_path(model)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        merges = Merges.of(place)
        for part in slices(batches):
            n = pa.array(merges.n_tokens(texts_of(part)), pa.int64())
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, tokens, and whether they exceed the limit of a context of 4,096."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_token_counts": op12_token_counts}
ORACLE: dict[str, str] = {}
