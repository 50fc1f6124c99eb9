"""Texts as counts of a bounded vocabulary, packed into blocks.

The vocabulary comes from totals over all training texts: every distinct word is cut into grams once, and pairs are
counted as pairs of word numbers. Then each text is read once more and becomes the numbers and counts of its terms: gaps
between ascending numbers, two bytes each, and counts of one byte where they fit, about two bytes a term after
compression. Document frequencies, weights, slopes and sums are taken from the blocks, where they lie; nothing of the
size of the weights is written or shuffled. Texts are shuffled only where a row id repeats or the files give too few tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialized, passing
from .linear import Blocks, summed

#: Bytes of text a task gets where texts are dealt anew.
TASK_TEXT = 2 << 20
#: Rows and words whose terms a task counts at a time.
ROWS, WORDS = 1 << 10, 1 << 17
#: Bits of a character's number in the key of a gram.
BITS = 12
#: Times the vocabulary's size: so many words at most are numbered for the count of pairs, beyond it pairs are counted as text.
NUMBERED = 8
#: The label of rows without one; the widest gap.
NONE, WIDE = np.iinfo(np.int32).min, (1 << 16) - 1


def plain_words() -> Column:
    """Words of two characters or more."""
    return F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def blank_words() -> Column:
    """What stands between blanks."""
    return F.filter(F.split(F.lower("text"), r"[ \t\n\r\f\x0b]+"), lambda w: w != "")


def grams_of(word: str, low: int, high: int) -> list[str]:
    """Grams of ``low`` to ``high`` characters of a blank-padded word; a word not longer than n counts once and ends the sizes."""
    w = f" {word} "
    return [w[i : i + n] for n in range(low, max(low, min(high, len(w))) + 1) for i in range(max(1, len(w) - n + 1))]


def _padded(words) -> tuple[np.ndarray, np.ndarray]:
    """(characters, characters of each word) of an Arrow array of words between blanks."""
    import pyarrow.compute as pc

    padded = pc.binary_join_element_wise(" ", words, " ", "")
    return np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le"), np.uint32), pc.utf8_length(padded).to_numpy().astype(np.int64)


def _windows(numbers: np.ndarray, lengths: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, word, key) for each size of gram: all grams of the words whose characters have numbers other than 0. Keys of
    ``BITS`` a character are exact, so sizes go to 5."""
    word, left = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(lengths.sum())
    key, numbered = numbers, numbers > 0
    for n in range(1, high + 1):
        if n > 1:
            key, numbered = key[:-1] << BITS | numbers[n - 1 :], numbered[:-1] & (numbers[n - 1 :] > 0)
        if n >= low:
            at = np.flatnonzero(numbered & (left[: len(key)] >= n))
            yield n, word[at], key[at]


def _keyed(low: int, high: int) -> bool:
    """Whether grams of these sizes have keys: a padded word has three characters at least."""
    return low <= 3 and high * BITS < 63


class _GramNumbers:
    """For tasks: the numbers of the grams of words. Grams are looked up by key for all words at once; where the vocabulary
    has more characters than keys can tell, by text."""

    def __init__(self, grams: list[str], low: int, high: int):
        self.low, self.high, self.at = low, high, None
        chars = sorted(set("".join(grams)))
        if _keyed(low, high) and len(chars) < 1 << BITS:
            self.table = np.zeros(0x110000, np.int64)
            self.table[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
            keys = np.array([int(sum(int(self.table[ord(c)]) << BITS * k for k, c in enumerate(reversed(g)))) for g in grams], np.int64)
            self.order = np.argsort(keys)
            self.keys = keys[self.order]
        else:
            self.at = {g: k for k, g in enumerate(grams)}

    def of(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, how many of them each word has) for an Arrow array of words."""
        if self.at is not None:
            lists = [[self.at[g] for g in grams_of(w, self.low, self.high) if g in self.at] for w in words.to_pylist()]
            return np.array([k for x in lists for k in x], np.int64), np.array([len(x) for x in lists], np.int64)
        text, lengths = _padded(words)
        found = []
        for _, word, key in _windows(self.table[text], lengths, self.low, self.high):
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            found.append((word[hit], self.order[place[hit]]))
        word, number = (np.concatenate(x) for x in zip(*found, strict=True))
        return number[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))


def spread(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows by row_id, about ``TASK_TEXT`` bytes a part, however few files or row groups they come from; as they are, if
    they come in ``parts`` parts and there are no more cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if parts is not None and parts >= cores:
        return rows
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows.repartition(max(cores, -(-size // TASK_TEXT)), "row_id")


def shape(rows: DataFrame) -> tuple[int, int, int]:
    """(rows, most rows of an id, parts that hold rows). Only ids are read."""
    per = rows.select("row_id", F.spark_partition_id().alias("part")).groupBy("row_id").agg(F.count("*").alias("n"), F.max("part").alias("part"))
    found = per.agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.count_distinct("part").alias("parts")).first()
    return found.rows or 0, found.most or 0, found.parts


def word_totals(rows: DataFrame, words: Column, parts: int | None = None) -> DataFrame:
    """(word, n) over the texts of ``rows``."""
    texts = spread(rows, parts).where(F.col("text").isNotNull())
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def gram_totals(rows: DataFrame, low: int, high: int, parts: int | None = None) -> DataFrame:
    """(term, total) of the grams of all words: every distinct word is cut into grams once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            terms, totals = [], []
            text, lengths = _padded(batch.column("word"))
            chars = np.unique(text)
            if _keyed(low, high) and len(chars) < 1 << BITS and (not len(chars) or chars[0]):
                chars = np.concatenate([np.zeros(1, np.uint32), chars])
                for size, word, key in _windows(np.searchsorted(chars, text), lengths, low, high):
                    order = np.argsort(key)
                    key = key[order]
                    first = np.flatnonzero(np.diff(key, prepend=-1))
                    if len(first):
                        spelled = np.stack([chars[key[first] >> BITS * k & (1 << BITS) - 1] for k in range(size - 1, -1, -1)], axis=1)
                        terms += np.ascontiguousarray(spelled).view(f"<U{size}")[:, 0].tolist()
                        totals += np.add.reduceat(batch.column("n").to_numpy()[word[order]], first).tolist()
            else:
                by_term: dict[str, int] = {}
                for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    for g in grams_of(word, low, high):
                        by_term[g] = by_term.get(g, 0) + n
                terms, totals = list(by_term), list(by_term.values())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(totals, pa.int64())], ["term", "total"])

    # counts of words are few bytes and would be put together into one task
    words = word_totals(rows, blank_words(), parts).repartition(rows.sparkSession.sparkContext.defaultParallelism, "word")
    return words.mapInArrow(run, "term string, total long").groupBy("term").agg(F.sum("total").alias("total"))


def _tokens(column):
    """(words a text, code of each word, Arrow array of words by code) of an Arrow list column."""
    import pyarrow.compute as pc

    coded = column.flatten().dictionary_encode()
    return pc.fill_null(column.value_lengths(), 0).to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _pairs(sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of the pairs of words that stand together in a text and both have a number."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero((text[1:] == text[:-1]) & (numbers[1:] >= 0) & (numbers[:-1] >= 0))
    return at, numbers[at] << 32 | numbers[at + 1]


def _pair_totals(rows: DataFrame, words: list[str], least: int, parts: int | None) -> DataFrame:
    """(term, total) of the pairs of ``words`` with at least ``least`` in all, counted as pairs of numbers."""
    sent = rows.sparkSession.sparkContext.broadcast((words, {w: k for k, w in enumerate(words)}))

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, codes, found = _tokens(batch.column("words"))
            number = np.array([sent.value[1].get(w, -1) for w in found.to_pylist()], np.int64)
            key, n = np.unique(_pairs(sizes, number[codes])[1], return_counts=True) if len(codes) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["pair", "n"])

    def name(batches):
        import pyarrow as pa

        for batch in batches:
            pair, known = batch.column("pair").to_numpy(), sent.value[0]
            terms = [f"{known[a]} {known[b]}" for a, b in zip((pair >> 32).tolist(), (pair & 0xFFFFFFFF).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), batch.column("total")], ["term", "total"])

    texts = spread(rows, parts).where(F.col("text").isNotNull()).select(plain_words().alias("words"))
    totals = texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    return totals.mapInArrow(name, "term string, total long")


def pair_totals_as_text(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(term, total) of all pairs of words."""
    pairs = F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))
    texts = spread(rows, parts).where(F.col("text").isNotNull()).select(plain_words().alias("words"))
    return texts.select(F.explode(pairs).alias("term")).groupBy("term").agg(F.count("*").alias("total"))


def _top(totals: DataFrame, size: int) -> DataFrame:
    return totals.orderBy(F.desc("total"), "term").limit(size)


def frequent_grams(rows: DataFrame, low: int, high: int, size: int, parts: int | None = None) -> list[str]:
    """The most frequent grams, ``size`` at most, in ascending order."""
    return sorted((r.term for r in _top(gram_totals(rows, low, high, parts), size).collect()), key=str.encode)


def frequent_words(rows: DataFrame, size: int, parts: int | None = None) -> list[str]:
    """The most frequent words and pairs of words, ``size`` at most, in ascending order. A pair is no more frequent than
    its words, so pairs with a word rarer than the ``size``-th word are not counted."""
    totals = materialized(word_totals(rows, plain_words(), parts).select(F.col("word").alias("term"), F.col("n").alias("total")), "word-totals")
    top = _top(totals, size).agg(F.count("*").alias("k"), F.min("total").alias("least")).first()
    least = top.least if top.k == size else 1
    words = totals.where(F.col("total") >= least)
    if words.count() <= NUMBERED * size:
        pairs = _pair_totals(rows, [r.term for r in words.select("term").toLocalIterator()], least, parts)
    else:
        pairs = pair_totals_as_text(rows, parts).where(F.col("total") >= least)
    return sorted((r.term for r in _top(words.unionByName(pairs), size).collect()), key=str.encode)


def _shut(data: bytes) -> bytes:
    """Compressed here, as every step carries the blocks through Spark to its tasks."""
    import pyarrow as pa

    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def _opened(data):
    import pyarrow as pa

    data = memoryview(data)
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], size) if size else b""


def pack(sizes: np.ndarray, idx: np.ndarray, tf: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sizes of the units, gaps between their ascending numbers, and counts, as bytes. A gap wider than two bytes is split
    by entries of count 0."""
    ends = np.cumsum(sizes)
    gaps = np.diff(idx, prepend=0)
    first = (ends - sizes)[sizes > 0]
    gaps[first] = idx[first]
    more = np.maximum(gaps - 1, 0) // WIDE
    if more.any():
        unit = np.repeat(np.arange(len(sizes)), sizes)
        sizes = sizes + np.bincount(unit, more, len(sizes)).astype(np.int64)
        last = np.cumsum(1 + more) - 1
        wide, counts = np.full(last[-1] + 1, WIDE), np.zeros(last[-1] + 1, np.int64)
        wide[last], counts[last] = gaps - more * WIDE, tf
        gaps, tf = wide, counts
    kind = np.uint8 if not len(tf) or tf.max() < 256 else np.int32
    return tuple(_shut(x.tobytes()) for x in (sizes.astype(np.int32), gaps.astype(np.uint16), tf.astype(kind)))


def unpack(sizes: bytes, gaps: bytes, tf: bytes, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, idx, tf) of ``pack``, numbers from ``base`` on; entries of count 0 say nothing."""
    sizes, gaps, tf = np.frombuffer(_opened(sizes), np.int32), np.frombuffer(_opened(gaps), np.uint16), _opened(tf)
    tf = np.frombuffer(tf, np.uint8 if len(tf) == len(gaps) else np.int32)
    idx = np.cumsum(gaps, dtype=np.int64)
    some = sizes[sizes > 0]
    before = np.full(len(some), -base)
    before[1:] += idx[np.cumsum(some)[:-1] - 1]
    idx -= np.repeat(before, some)
    return sizes, idx, tf


_LOG = np.concatenate([[0.0], 1 + np.log(np.arange(1, 256))])


def sublinear(tf: np.ndarray) -> np.ndarray:
    """1 + ln tf, and 0 for 0."""
    return _LOG.take(tf) if tf.dtype == np.uint8 else np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0.0)


#: A block: rows of one split (ids, and labels of their texts, of which ``at`` names the row); grams by row; words and pairs by row and label.
FIELDS = ["y", "at", "gram_sizes", "gram_gaps", "gram_tf", "word_rows", "word_labels", "word_sizes", "word_gaps", "word_tf"]


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sum of ``n`` (below 2^31) by key (below 2^32)."""
    both = np.sort(key << 31 | n)
    key = both >> 31
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(both & 0x7FFFFFFF, first) if len(first) else n[:0]


def _counted(rows: DataFrame, grams: list[str], words: list[str], low: int, high: int, repeats: bool, parts: int) -> DataFrame:
    """The blocks of ``rows(row_id, source_split, label, text)``."""
    pairs = [tuple(w.split(" ")) for w in words if " " in w]
    number = {w: k for k, w in enumerate(sorted({w for w in words if " " not in w} | {w for p in pairs for w in p}))}
    single = np.full(len(number) + 1, -1)
    for k, w in enumerate(words):
        if " " not in w:
            single[number[w]] = k
    keys = sorted((number[a] << 32 | number[b], k) for k, (a, b) in zip((k for k, w in enumerate(words) if " " in w), pairs, strict=True))
    pair_key, pair_at = np.array([x[0] for x in keys], np.int64), np.array([x[1] for x in keys], np.int64)
    sent = rows.sparkSession.sparkContext.broadcast((grams, number, single, pair_key, pair_at))
    kind = rows.schema["row_id"].dataType.simpleString()

    some_grams, some_words, width = bool(grams), bool(words), len(words)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        grams, word_at, single, pair_key, pair_at = sent.value
        numbers = _GramNumbers(grams, low, high) if grams else None

        def gram_counts(row, column):
            sizes, codes, found = _tokens(column)
            each, times = np.unique(np.repeat(row, sizes) * max(len(found), 1) + codes, return_counts=True)
            at, code = np.divmod(each, max(len(found), 1))
            flat, lengths = numbers.of(found)
            start = np.cumsum(lengths) - lengths
            n = lengths[code]
            own = flat[np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            return _sums(np.repeat(at, n) * len(grams) + own, np.repeat(times, n))

        def word_counts(unit, column, width):
            sizes, codes, found = _tokens(column)
            own = np.array([word_at.get(w, -1) for w in found.to_pylist()], np.int64)[codes] if len(codes) else codes
            of = np.repeat(unit, sizes)
            one = single[own]
            keys = [(of * width + one)[one >= 0]]
            if len(pair_key):
                at, pair = _pairs(sizes, own)
                place = np.minimum(np.searchsorted(pair_key, pair), len(pair_key) - 1)
                hit = pair_key[place] == pair
                keys.append(of[at[hit]] * width + pair_at[place[hit]])
            return np.unique(np.concatenate(keys), return_counts=True)

        def block(own):
            texts = own.column("texts")
            at = np.repeat(np.arange(len(own)), texts.value_lengths().to_numpy())
            flat = texts.flatten()
            y = pc.fill_null(flat.field("label"), int(NONE)).to_numpy().astype(np.int64)
            out = [y.astype(np.int32).tobytes(), at.astype(np.int32).tobytes()]
            if some_grams:
                key, tf = gram_counts(at, flat.field("blank"))
                row, idx = np.divmod(key, len(grams))
                out += pack(np.bincount(row, minlength=len(own)), idx, tf)
            else:
                out += pack(np.zeros(len(own), np.int64), *(np.zeros(0, np.int64),) * 2)
            units, unit = np.unique(at * (1 << 32) + (y - int(NONE)), return_inverse=True)
            key, tf = word_counts(unit, flat.field("plain"), width) if some_words else (np.zeros(0, np.int64),) * 2
            of, idx = np.divmod(key, max(width, 1))
            out += [(units >> 32).astype(np.int32).tobytes(), ((units & 0xFFFFFFFF) + int(NONE)).astype(np.int32).tobytes(), *pack(np.bincount(of, minlength=len(units)), idx, tf)]
            ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.column("row_id"))
            return pa.RecordBatch.from_arrays([own.column("source_split").slice(0, 1), ids, *[pa.array([x], pa.binary()) for x in out]], ["source_split", "row_ids", *FIELDS])

        for batch in batches:
            flat = batch.column("texts").flatten()
            n = pc.fill_null(flat.field("blank" if some_grams else "plain").value_lengths(), 0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(batch.column("texts").value_lengths().to_numpy())]
            at = 0
            while at < len(batch):
                to = min(at + ROWS, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right"))))
                own = batch.slice(at, to - at)
                for split in pc.unique(own.column("source_split")).to_pylist():
                    yield block(own.filter(pc.equal(own.column("source_split"), split)))
                at = to

    none = F.lit(None).cast("array<string>")
    text = F.struct(F.col("label").cast("int").alias("label"), (blank_words() if grams else none).alias("blank"), (plain_words() if words else none).alias("plain"))
    rows = rows.select("row_id", "source_split", "label", "text")
    if repeats:
        dealt = spread(rows).groupBy("row_id", "source_split").agg(F.collect_list(text).alias("texts"))
    else:
        dealt = spread(rows, parts).select("row_id", "source_split", F.array(text).alias("texts"))
    return dealt.mapInArrow(run, f"source_split string, row_ids array<{kind}>, " + ", ".join(f"{f} binary" for f in FIELDS))


@dataclass(frozen=True)
class TextCounts:
    """Blocks of counts with the vocabulary's document frequencies: grams come first, then words and pairs. ``rows``: texts trained on."""

    frame: DataFrame
    grams: list[str]
    words: list[str]
    rows: int
    idf: np.ndarray
    kind: str

    @property
    def width(self) -> int:
        return max(len(self.grams) + len(self.words), 1)

    def where(self, split: str) -> TextCounts:
        return replace(self, frame=self.frame.where(F.col("source_split") == split))

    def blocks(self) -> Blocks:
        """For ``linear``."""
        return Blocks(self.frame, self.reader(), self.kind)

    def reader(self):
        """For tasks: (row ids, y, row of each y, [(row sizes, idx, w, scale) of grams and of words and pairs]) of each block:
        sublinear tf, smooth idf; a row's scale gives either part of it unit length."""
        idf, n_grams = self.frame.sparkSession.sparkContext.broadcast(self.idf), len(self.grams)

        def weighted(sizes, idx, tf):
            w, scale = sublinear(tf), np.zeros(len(sizes))
            if len(idx):
                w *= idf.value.take(idx)
                some = sizes > 0
                scale[some] = 1 / np.sqrt(np.add.reduceat(w * w, (np.cumsum(sizes) - sizes)[some]))
            return sizes, idx, w, scale

        def read(batch) -> Iterator:
            columns = [batch.column(f) for f in ("row_ids", *FIELDS)]
            for k in range(len(batch)):
                ids, *own = (c[k] for c in columns)
                own = [x.as_buffer() for x in own]
                y, at, word_rows = (np.frombuffer(own[j], np.int32) for j in (0, 1, 5))
                unit_sizes, idx, tf = unpack(*own[7:], n_grams)
                sizes = np.bincount(word_rows, unit_sizes, len(ids.values)).astype(np.int64)
                yield ids.values, y, at, [weighted(*unpack(*own[2:5])), weighted(sizes, idx, tf)]

        return read

    def vectors(self) -> DataFrame:
        """(row_id, y, source_split, idx, w): a row per text."""
        reader = self.reader()

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for k in range(len(batch)):
                    for ids, y, at, parts in reader(batch.slice(k, 1)):
                        row = np.concatenate([np.repeat(np.arange(len(ids)), p[0]) for p in parts])
                        order = np.argsort(row, kind="stable")
                        idx, w = (np.concatenate(x)[order] for x in ([p[1] for p in parts], [p[2] * np.repeat(p[3], p[0]) for p in parts]))
                        keep = w > 0
                        sizes = np.bincount(row[order][keep], minlength=len(ids))
                        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                        lists = [pa.ListArray.from_arrays(ends, pa.array(x[keep])) for x in (idx.astype(np.int32), w)]
                        at, split = pa.array(at), pa.array([batch.column("source_split")[k].as_py()] * len(y), pa.string())
                        labels = pa.array(y, mask=y == NONE)
                        yield pa.RecordBatch.from_arrays([ids.take(at), labels, split, *[x.take(at) for x in lists]], ["row_id", "y", "source_split", "idx", "w"])

        return self.frame.mapInArrow(run, f"row_id {self.kind}, y int, source_split string, idx array<int>, w array<double>")

    def digests(self, codes: np.ndarray) -> DataFrame:
        """(row_id, n_terms, total, checksum) of rows with a term: terms, their weights, and weights in millionths times the
        term's code."""
        reader, sent = self.reader(), self.frame.sparkSession.sparkContext.broadcast(codes.astype(np.int64))

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for ids, _, _, parts in reader(batch):
                    n, total, sums = (np.zeros(len(ids), t) for t in (np.int64, float, np.int64))
                    for sizes, idx, w, scale in parts:
                        some, w = sizes > 0, w * np.repeat(scale, sizes)
                        if some.any():
                            first = (np.cumsum(sizes) - sizes)[some]
                            n[some] += np.add.reduceat((w > 0).astype(np.int64), first)
                            total[some] += np.add.reduceat(w, first)
                            sums[some] += np.add.reduceat(np.floor(w * 1e6 + 0.25).astype(np.int64) * sent.value.take(idx), first)
                    kept = pa.array(np.flatnonzero(n))
                    yield pa.RecordBatch.from_arrays([ids.take(kept), *[pa.array(x).take(kept) for x in (n, total, sums)]], ["row_id", "n_terms", "total", "checksum"])

        return self.frame.mapInArrow(run, f"row_id {self.kind}, n_terms long, total double, checksum long")


def _word_units(batch) -> Iterator:
    """(row ids, row and label of each unit, sizes, idx, tf) of the words and pairs of each block."""
    columns = [batch.column(f) for f in ("row_ids", *FIELDS[5:])]
    for k in range(len(batch)):
        ids, *own = (c[k] for c in columns)
        own = [x.as_buffer() for x in own]
        yield ids.values, np.frombuffer(own[0], np.int32), np.frombuffer(own[1], np.int32), *unpack(*own[2:])


def _frequencies(frame: DataFrame, grams: int, words: int) -> np.ndarray:
    """How many rows hold each term (words: rows and labels)."""

    def add(batch, total):
        for field, base, width in (("gram", 0, grams), ("word", grams, words)):
            for own in zip(*[batch.column(f"{field}_{x}") for x in ("sizes", "gaps", "tf")], strict=True):
                _, idx, tf = unpack(*[x.as_buffer() for x in own])
                if width:
                    total[base : base + width] += np.bincount(idx[tf > 0], minlength=width)

    return summed(frame, grams + words, add)


def text_counts(rows: DataFrame, words: int = 60_000, chars: int = 80_000, low: int = 3, high: int = 5) -> TextCounts:
    """The counts of ``rows(row_id, text, label, source_split)``, packed and written: words and pairs, ``words`` at most, and
    grams, ``chars`` at most, by their totals in train rows."""
    rows = rows.select("row_id", "source_split", "label", "text")
    train = rows.where("source_split = 'train'")
    with passing(rows.sparkSession):
        n, most, parts = shape(rows)
        own = train.count() if n else 0
        grams = frequent_grams(train, low, high, chars, parts) if chars else []
        plain = frequent_words(train, words, parts) if words else []
        frame = materialized(_counted(rows, grams, plain, low, high, most > 1, parts), "text-counts", "uncompressed")
    df = _frequencies(frame.where("source_split = 'train'"), len(grams), len(plain))
    return TextCounts(frame, grams, plain, own, np.log((1 + own) / (1 + df)) + 1, rows.schema["row_id"].dataType.simpleString())


def naive_bayes(counts: TextCounts, alpha: float = 1.0) -> DataFrame:
    """(row_id, label) of the test rows: multinomial naive Bayes over words and pairs, fitted on train rows; scores are
    compared in millionths, ties go to the lower class."""
    train, read, v = counts.where("train").frame, _word_units, len(counts.words)

    def labels(batches):
        import pyarrow as pa

        for batch in batches:
            own = [np.unique(label[sizes > 0]) for _, _, label, sizes, _, _ in read(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.int32), *own])))], ["c"])

    # a row per class; the class of rows without a label comes last
    classes = np.array(sorted((r.c for r in train.mapInArrow(labels, "c int").distinct().collect()), key=lambda c: (c == NONE, c)), np.int64)
    place = {int(c): k for k, c in enumerate(classes)}

    def add(batch, total):
        sums = total.reshape(len(classes), v + 1)
        for _, _, label, sizes, idx, tf in read(batch):
            some = sizes > 0
            cls = np.array([place.get(int(c), 0) for c in label], np.int64)
            sums[:, -1] += np.bincount(cls[some], minlength=len(classes))
            sums[:, :-1] += np.bincount(np.repeat(cls, sizes) * v + idx, tf, len(classes) * v).reshape(-1, v)

    sums = summed(train, len(classes) * (v + 1), add).reshape(len(classes), v + 1)
    k, rows = sums[:, :-1], sums[:, -1]
    total = k.sum(axis=1, keepdims=True)
    k = np.where(classes[:, None] == NONE, 0, k)
    spark = counts.frame.sparkSession
    sent = spark.sparkContext.broadcast((np.ascontiguousarray(np.log((k + alpha) / (total + alpha * v)).T), np.log(rows)))

    def run(batches):
        import pyarrow as pa

        own, share = sent.value
        for batch in batches:
            for ids, row, _, sizes, idx, tf in read(batch):
                at, n = np.repeat(row, sizes), len(ids)
                some = np.flatnonzero(np.bincount(at, tf, n)) if len(classes) else np.zeros(0, np.int64)
                score = np.stack([np.bincount(at, tf * own[:, c].take(idx), n) + share[c] for c in range(len(classes))], axis=1)[some] if len(some) else np.zeros((0, 1))
                best = classes[np.round(-score, 6).argmin(axis=1)] if len(some) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(best.astype(np.int32), mask=best == NONE)], ["row_id", "label"])

    return counts.where("test").frame.mapInArrow(run, f"row_id {counts.kind}, label int")
