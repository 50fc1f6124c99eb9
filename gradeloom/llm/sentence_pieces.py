"""SentencePiece encoding and decoding by batched numpy Viterbi.

Distinct words of a batch are grouped by length and advance together, one character at a time. The hashes
of all their substrings probe the sorted keys of the pieces (behind a bitmap of the keys), and what is found
is compared with the piece character by character. At each place a candidate's score is its length if it may
follow the piece chosen where it starts, else nothing; a vectorised maximum over the lengths picks the piece
and stores its length as backpointer. The model at hand is a byte-fallback BPE, whose own scores rank merges and do not
add up; a sum of them would give other ids than the model's. So the Viterbi step tests the pair
instead: two pieces may stand next to each other if merging their text in rank order yields just those
two, and exactly one segmentation of a word has only such pairs, the one that merging gives. The results
equal the sentencepiece library's.

A word is cut where no piece crosses, and parts over ``LONG`` characters take the same steps one by one, so
that a text without blanks costs in proportion to its length.

No piece holds a blank behind another character, so words start at blanks; characters outside the model
become byte pieces and never merge. Runs of blanks merge last, leftmost first.

Defined results: null and empty texts have no ids; decoding gives back the text exactly,
but for the model's own blank mark (U+2581), which it reads as a blank; repeated rows
are encoded alike; an empty table gives an empty result; further columns are kept, but one named ids
(by ``encode``) or decoded (by ``decode``) is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_batches import slices, texts_of
from .token_records import tokenizer_path

IDS = np.dtype("<i4")
MODEL = "piece_bpe_32k.model"
BLANK = "▁"
PART = re.compile(" ?[^ \n]+| |\n")
CACHE_WORDS = 100_000
MEMO_BITS = 20
#: Words of more characters are segmented alone.
LONG = 96
#: Characters of words that are segmented together, of texts whose words are found together.
CELLS = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def _merge(symbols: list[str], rank: dict[str, int]) -> list[tuple[str, tuple | None]]:
    """Plain rank-order merging of a short string; each result with the pair it was merged from."""
    items: list[tuple[str, tuple | None]] = [(s, None) for s in symbols]
    while True:
        best = min(((rank[items[k][0] + items[k + 1][0]], k) for k in range(len(items) - 1) if items[k][0] + items[k + 1][0] in rank), default=None)
        if best is None:
            return items
        k = best[1]
        items[k : k + 2] = [(items[k][0] + items[k + 1][0], (items[k][0], items[k + 1][0]))]


class Pieces:
    """The model's tables: made once per process, of the vocabulary's size."""

    _of: dict[str, Pieces] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        return cls._of.get(path) or cls._of.setdefault(path, cls(path))

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(k) for k in range(n)]
        self.bytes_at = next(k for k in range(n) if sp.is_byte(k))
        plain = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))]
        self.id_of = {names[k]: k for k in plain}
        score = {names[k]: sp.get_score(k) for k in plain}
        # ranks: single characters first, then merges from the best score on
        chars = sorted((p for p in score if len(p) == 1), key=lambda p: self.id_of[p])
        merges = sorted((p for p in score if len(p) > 1), key=lambda p: (-score[p], self.id_of[p]))
        order = {p: k for k, p in enumerate(merges)}
        self.run_rank = {p: 0 for p in merges if set(p) == {BLANK}}
        merges = [p for p in merges if p not in self.run_rank]
        made = {}
        for p in merges:
            done = _merge(list(p), order)
            if len(done) == 1:
                made[p] = done[0][1]
        ranked = chars + [p for p in merges if p in made]
        rank = {p: k for k, p in enumerate(ranked)}
        self.ids = np.array([self.id_of[p] for p in ranked], np.int32)
        self.left = np.array([rank[made[p][0]] if p in made else rank[p] for p in ranked], np.int64)
        self.right = np.array([rank[made[p][1]] if p in made else rank[p] for p in ranked], np.int64)
        pair = [(self.left[k] << 20 | self.right[k], k) for k in range(len(chars), len(ranked))]
        pair.sort()
        self.pair_keys, self.pair_rank = np.array([p for p, _ in pair]), np.array([k for _, k in pair])
        self.longest = max(map(len, ranked))
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(c) for c in chars]] = True
        keys = sorted((int((self._hash(np.array([[ord(c) for c in p]], np.uint64))[:, -1] * np.uint64(2 * len(p) + 1))[0]), rank[p]) for p in ranked)
        self.keys, self.key_rank = np.array([k for k, _ in keys], np.uint64), np.array([r for _, r in keys])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.points = np.zeros((len(ranked), self.longest), np.uint32)
        for k, p in enumerate(ranked):
            self.points[k, : len(p)] = [ord(c) for c in p]
        self.rank_of_pair = dict(zip(self.pair_keys.tolist(), self.pair_rank.tolist(), strict=True))
        self.sides = self.left.tolist(), self.right.tolist()
        self.pairs: dict[int, bool] = {}
        self.memo_key, self.memo_ok = np.full(1 << MEMO_BITS, -1, np.int64), np.zeros(1 << MEMO_BITS, bool)
        self.blank = rank[BLANK]
        self.cache: dict[str, bytes] = {}  # ids as 4-byte integers
        self.runs: dict[int, bytes] = {}
        self.blank_id = np.array([self.id_of[BLANK]], IDS).tobytes()
        raw = [b""] * n
        for k in plain:
            raw[k] = names[k].replace(BLANK, " ").encode()
        for k in range(256):
            raw[self.bytes_at + k] = bytes([k])
        self.raw = raw

    @staticmethod
    def _hash(points: np.ndarray) -> np.ndarray:
        """Prefix hashes (one more column than ``points``): h[k+1] = h[k] * BASE + mixed point."""
        h = np.zeros((len(points), points.shape[1] + 1), np.uint64)
        for k in range(points.shape[1]):
            c = (points[:, k] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            h[:, k + 1] = h[:, k] * BASE + (c ^ c >> np.uint64(29))
        return h

    def _valid_now(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a and b leaves a and b: their merge trees are unwound
        along the seam, from the latest merge on; a pair that would merge earlier breaks them up."""
        ok = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), 1 << 40)
        a, b = a.copy(), b.copy()
        while len(live):
            key = a << 20 | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            broken = (self.pair_keys[at] == key) & (self.pair_rank[at] < limit)
            ok[live[broken]] = False
            first = a > b
            na, nb = self.right[a], self.left[b]
            leaf_a, leaf_b = na == a, nb == b
            use_a = (first & ~leaf_a) | (~first & leaf_b & ~leaf_a)
            use_b = ~use_a & ~leaf_b
            limit = np.where(use_a, a, b + 1)
            a, b = np.where(use_a, na, a), np.where(use_b, nb, b)
            on = ~broken & (use_a | use_b)
            live, limit, a, b = live[on], limit[on], a[on], b[on]
        return ok

    def valid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_valid_now`` through a memo of fixed size."""
        key = a << 20 | b
        slot = (key.astype(np.uint64) * BASE >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        miss = self.memo_key[slot] != key
        ok = self.memo_ok[slot]
        if miss.any():
            fresh, back = np.unique(key[miss], return_inverse=True)
            good = self._valid_now(fresh >> 20, fresh & (1 << 20) - 1)
            ok[miss] = good[back]
            at = (fresh.astype(np.uint64) * BASE >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
            # of keys that share a slot one stays, key and answer alike
            at, first = np.unique(at, return_index=True)
            self.memo_key[at], self.memo_ok[at] = fresh[first], good[first]
        return ok

    def found(self, points: np.ndarray) -> np.ndarray:
        """The piece of each substring: [word, end, span - 1], -1 where there is none."""
        n, size = points.shape
        most = min(self.longest, size)
        h = self._hash(points.astype(np.uint64))
        out = np.full((n, size + 1, most), -1, np.int32)
        power = np.cumprod(np.full(most, BASE))
        for span in range(1, most + 1):
            key = (h[:, span:] - h[:, : size + 1 - span] * power[span - 1]) * np.uint64(2 * span + 1)
            row, start = np.nonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
            key = key[row, start]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == key)
            row, start, piece = row[hit], start[hit], self.key_rank[at[hit]]
            same = np.ones(len(hit), bool)
            for k in range(span):
                same &= points[row, start + k] == self.points[piece, k]
            out[row[same], start[same] + span, span - 1] = piece[same]
        return out

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of words of equal length, as 4-byte integers."""
        n, size = len(words), len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size)
        known, found = self.known[points.astype(np.int64)], self.found(points)
        chosen, back = np.full((n, size + 1), -1, np.int64), np.ones((n, size + 1), np.int32)
        spans = np.arange(1, found.shape[2] + 1, dtype=np.int32)
        for end in range(1, size + 1):
            row, span = np.nonzero(found[:, end] >= 0)
            piece, span = found[row, end, span].astype(np.int64), span + 1
            before = chosen[row, end - span]
            # a piece may start the word, or follow a byte character
            ok = (before < 0) & ((end == span) | ~known[row, np.maximum(end - span - 1, 0)])
            ask = np.flatnonzero(before >= 0)
            ok[ask] = self.valid(before[ask], piece[ask])
            score = np.zeros((n, len(spans)), np.int32)
            score[row[ok], span[ok] - 1] = span[ok]
            best = score.max(axis=1)
            live = np.flatnonzero(best)
            back[live, end] = best[live]
            chosen[live, end] = found[live, end, best[live] - 1]
        # back from the ends: (word, place, id) of every piece, a byte piece for each byte of an unknown character
        end, live = np.full(n, size), np.arange(n)
        rows, places, out = [], [], []
        while len(live):
            at = end[live]
            piece = chosen[live, at]
            plain = piece >= 0
            rows.append(live[plain])
            places.append(at[plain] << 3)
            out.append(self.ids[piece[plain]])
            for r, e in zip(live[~plain].tolist(), at[~plain].tolist(), strict=True):
                raw = words[r][e - 1].encode("utf-8", "surrogatepass")
                rows.append(np.full(len(raw), r))
                places.append((e << 3) + np.arange(len(raw)))
                out.append(np.frombuffer(raw, np.uint8).astype(np.int32) + self.bytes_at)
            end[live] = at - back[live, at]
            live = live[end[live] > 0]
        row, place = np.concatenate(rows), np.concatenate(places)
        order = np.argsort(row * ((size + 1) << 3) + place)
        raw = np.concatenate(out)[order].astype(IDS).tobytes()
        cut = (np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]) * IDS.itemsize).tolist()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _may_follow(self, a: int, b: int) -> bool:
        """``_valid_now`` of one pair, remembered."""
        key = a << 20 | b
        if key not in self.pairs:
            if len(self.pairs) > CACHE_WORDS:
                self.pairs.clear()
            (left, right), x, y, limit = self.sides, a, b, 1 << 40
            while (seam := self.rank_of_pair.get(x << 20 | y, limit)) >= limit:
                if right[x] != x and (x > y or left[y] == y):
                    x, limit = right[x], x
                elif left[y] != y:
                    y, limit = left[y], y + 1
                else:
                    break
            self.pairs[key] = seam >= limit
        return self.pairs[key]

    def segment_long(self, word: str) -> Iterator[bytes]:
        """Ids of one long word, part by part between places that no piece crosses; of each stretch of
        characters the pieces are found at once, the steps are taken one by one."""
        held: list[tuple[int, int]] = [(-1, 0)]  # piece and span chosen at each end of the open part
        first, step = 0, CELLS // self.longest
        for a in range(0, len(word), step):
            lead = max(0, a - self.longest + 1)
            points = np.frombuffer(word[lead : a + step].encode("utf-32-le", "surrogatepass"), np.uint32)[None]
            known, found = self.known[points[0].astype(np.int64)], self.found(points)[0]
            end_at, span_at = np.nonzero(found >= 0)
            pieces = found[end_at, span_at].tolist()
            reach = np.arange(len(found) + 1)
            np.minimum.at(reach, end_at, end_at - span_at - 1)
            # a place is crossed if a later end's piece starts before it
            crossed = (np.minimum.accumulate(reach[::-1])[::-1][1:] < np.arange(len(found))).tolist()
            cut = np.searchsorted(end_at, np.arange(len(found) + 1)).tolist()
            spans, known = (span_at + 1).tolist(), known.tolist()
            for end in range(a - lead + 1, len(found)):
                best = (-1, 1)
                for k in range(cut[end], cut[end + 1]):
                    start = lead + end - spans[k]
                    if start < first:
                        continue
                    before = held[start - first][0]
                    if self._may_follow(before, pieces[k]) if before >= 0 else start == first or not known[end - spans[k] - 1]:
                        best = max(best, (pieces[k], spans[k]), key=lambda x: x[1] * (x[0] >= 0))
                held.append(best)
                # the end of a stretch says nothing about pieces that reach beyond it
                if not crossed[end] and (end < len(found) - self.longest or a + step >= len(word)) or lead + end == len(word):
                    yield self._unwound(word[first : lead + end], held)
                    first, held = lead + end, [(-1, 0)]

    def _unwound(self, part: str, held: list[tuple[int, int]]) -> bytes:
        out, end = [], len(part)
        while end:
            piece, span = held[end]
            out.append([int(self.ids[piece])] if piece >= 0 else [self.bytes_at + x for x in part[end - 1].encode("utf-8", "surrogatepass")])
            end -= span
        return np.array([k for ids in reversed(out) for k in ids], IDS).tobytes()

    def run(self, n: int) -> bytes:
        """Ids of n blanks with no character to join."""
        if n not in self.runs:
            if len(self.runs) > 1000:
                self.runs = {}
            # blanks merge pairwise from the left, the same way in every block of the longest piece of blanks
            block = max(map(len, self.run_rank), default=1)
            whole, rest = divmod(n, block) if n > 2 * block else (0, n)
            out = (_merge([BLANK] * block, self.run_rank) if whole else []) * whole + _merge([BLANK] * rest, self.run_rank)
            self.runs[n] = np.array([self.id_of[p] for p, _ in out], IDS).tobytes()
        return self.runs[n]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [k.tolist() for k in self.encode_arrays(texts)]

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        parts = [PART.findall(" " + t.replace(BLANK, " ")) if t else [] for t in texts]
        words = set(chain.from_iterable(parts))
        if len(self.cache) > CACHE_WORDS:
            # what this batch holds is kept, so frequent words stay
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
        by_length: dict[int, list[str]] = {}
        long = []
        for w in words.difference(self.cache):
            if w == " ":
                self.cache[w] = self.run(1)
            elif len(w) > LONG:
                long.append(w)
                self.cache[w] = b"".join(self.segment_long(w.replace(" ", BLANK)))
            else:
                by_length.setdefault(len(w), []).append(w)
        for size, some in by_length.items():
            step = max(1, CELLS // (size + 1))
            for k in range(0, len(some), step):
                self.cache.update(zip(some[k : k + step], self.segment([w.replace(" ", BLANK) for w in some[k : k + step]]), strict=True))
        get = self.cache.__getitem__
        out = [np.frombuffer(self._with_runs(p) if " " in p else b"".join(map(get, p)), IDS) for p in parts]
        # long words are no use to other texts
        for w in long:
            del self.cache[w]
        return out

    def _with_runs(self, parts: list[str]) -> bytes:
        out, held = [], 0
        for p in parts:
            if p == " ":
                held += 1
                continue
            ids = self.cache[p]
            if held and p[0] == " " and ids.startswith(self.blank_id):
                out.append(self.run(held + 1))
                ids = ids[len(self.blank_id) :]
            elif held:
                out.append(self.run(held))
            out.append(ids)
            held = 0
        return b"".join(out) + (self.run(held) if held else b"")

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _with_column(batch, name: str, values, kind):
    import pyarrow as pa

    fields = [f for f in batch.schema if f.name != name]
    arrays = [batch.column(f.name) for f in fields]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(values, kind)], schema=pa.schema([*fields, pa.field(name, kind)]))


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``: the pieces of each text. A column of that name is replaced."""
    place = tokenizer_path(model)
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import pyarrow as pa

        pieces = Pieces.of(place)
        for part in slices(batches, text_col):
            yield _with_column(part, "ids", pieces.encode_arrays(texts_of(part, text_col)), pa.list_(pa.int32()))

    return docs.mapInArrow(run, schema)


def decode(ids: DataFrame, model: str = MODEL) -> DataFrame:
    """``ids`` with ``decoded``: the text of each row's pieces (null ids: empty). A column of that name is replaced."""
    place = tokenizer_path(model)
    ids = ids.drop("decoded")
    schema = T.StructType([*ids.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        import pyarrow as pa

        pieces = Pieces.of(place)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield _with_column(part, "decoded", [pieces.decode(x or ()) for x in part.column("ids").to_pylist()], pa.string())

    return ids.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: number and checksum of its ids, and whether decoding them gives
    the text back. Texts are encoded and decoded in one pass, so no ids travel between processes."""
    place = tokenizer_path(model)

    def run(batches):
        import pyarrow as pa

        pieces = Pieces.of(place)
        for part in slices(batches):
            texts = texts_of(part)
            ids = pieces.encode_arrays(texts)
            same = [pieces.decode(k.tolist()) == t for k, t in zip(ids, texts, strict=True)]
            columns = [part.column("doc_id"), pa.array([len(k) for k in ids], pa.int64()), pa.array([zlib.crc32(k) for k in ids], pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and checksum of its ids, and whether decoding gives the text back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_sentence_pieces": op6_sentence_pieces}
ORACLE: dict[str, str] = {}
