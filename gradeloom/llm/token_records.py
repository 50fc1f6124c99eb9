"""Token-ID output: length-delimited binary records with masked checksums, and an offset index.

A record is ``length (uint64) | masked crc of the length (uint32) | payload | masked crc of the payload
(uint32)``, little-endian; the payload is ``doc_id (int64), has_id (uint8), width (uint8), ids`` with 2-
or 4-byte ids. A mask rotates the CRC-32 right by 15 bits and adds a constant, so that a checksum stored
inside checked data does not check itself. Documents are range-partitioned and sorted by doc_id; each
task streams its shard to a file of its own attempt in the shared folder, and the index, a Parquet table
written by Spark, names only files of attempts that committed: a lost executor leaves at most an
orphaned file.

Texts are encoded with the tokenizers library, special tokens that a text spells included, as the library
does by default. Its byte-level pre-tokenizer never joins what stands on
the two sides of a blank, so texts are cut there and a bounded cache holds the ids of chunks.

Defined results: null text is empty (its record holds the end id alone); a null doc_id is written with
has_id 0 and sorts first; repeated rows give repeated records; an empty table gives no shards and an
empty empty result; further columns are ignored; rows of equal doc_id come in order of their texts.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_dir, text_of
from .text_batches import slices, texts_of

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
CACHE_CHUNKS = 150_000
#: Bytes of text that a shard file takes.
SHARD_BYTES = 256 << 20
_S = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]")
HEAD = struct.Struct("<QI")
IDS = np.dtype("<u4")
PAYLOAD = struct.Struct("<qBB")
CRC = struct.Struct("<I")


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file of a public tokenizer: a path as given, or a name in the installed collection."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of texts; chunks already seen come from the cache, which holds ids as 4-byte integers."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) if special else r"(?!)")
        self.cache: dict[str, bytes] = {}
        self.lengths = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.tokenizer.get_vocab_size())], np.int64)

    @classmethod
    def of(cls, path: str) -> Encoder:
        return cls._of.get(path) or cls._of.setdefault(path, cls(path))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # texts that spell a special token are rare and cut differently: the library takes them whole
        whole = {k for k, t in enumerate(texts) if self.special.search(t)}
        parts = [[] if k in whole else CHUNK.findall(t) for k, t in enumerate(texts)]
        words = set(chain.from_iterable(parts))
        if len(self.cache) > CACHE_CHUNKS:
            # what this batch holds is kept, so frequent chunks stay
            self.cache = {c: self.cache[c] for c in words if c in self.cache}
        fresh = words.difference(self.cache)
        blank = [c for c in fresh if c.isspace()]
        for c, e in zip(blank, self.tokenizer.encode_batch_fast(blank, add_special_tokens=False), strict=True):
            self.cache[c] = np.array(e.ids, IDS).tobytes()
        self._learn(list(fresh.difference(blank)))
        get = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(get, p)), IDS) for p in parts]
        for k in whole:
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, IDS)
        return out

    def _learn(self, fresh: list[str], per_call: int = 512) -> None:
        """Encode new chunks, many to a call. Each starts with a blank or behind a line break, so none
        joins its neighbour; lengths of the ids in bytes tell where each one ends."""
        marked = [c if c[0] == " " else "\n" + c for c in fresh]
        joined = ["".join(marked[k : k + per_call]) for k in range(0, len(marked), per_call)]
        skip, at = [0 if c[0] == " " else IDS.itemsize for c in fresh], 0
        for text, e in zip(joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            some = marked[at : at + per_call]
            sizes = list(map(len, some)) if text.isascii() else [len(c.encode()) for c in some]
            ids = np.array(e.ids, IDS)
            ends = ((np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes), "left") + 1) * IDS.itemsize).tolist()
            raw = ids.tobytes()
            self.cache.update(zip(fresh[at : at + per_call], [raw[a + s : b] for a, s, b in zip([0, *ends], skip[at : at + per_call], ends, strict=False)], strict=True))
            at += per_call

    @property
    def width(self) -> int:
        return 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _rows(batches, rows: int = 256):
    for pdf in batches:
        for k in range(0, len(pdf), rows):
            yield pdf.iloc[k : k + rows]


def _write_shard(batches, path: str, tokenizer: str, end_id: int):
    import pyarrow as pa

    encoder = Encoder.of(tokenizer)
    width, kind = encoder.width, np.dtype(f"<u{encoder.width}")
    end = np.array([end_id], kind).tobytes()
    out, at, name = None, 0, f"{path}/shards/{uuid.uuid4().hex}.rec"
    try:
        for part in slices(batches):
            doc_ids, sizes, counts = part.column("doc_id").to_pylist(), [], []
            for doc_id, ids in zip(doc_ids, encoder.encode(texts_of(part)), strict=True):
                body = PAYLOAD.pack(doc_id or 0, doc_id is not None, width) + ids.astype(kind).tobytes() + end
                record = HEAD.pack(len(body), masked_crc(struct.pack("<Q", len(body)))) + body + CRC.pack(masked_crc(body))
                if out is None:
                    files, inner = _filesystem(path)
                    files.create_dir(f"{inner}/shards", recursive=True)
                    out = files.open_output_stream(f"{inner}/shards/{os.path.basename(name)}", buffer_size=1 << 20)
                out.write(record)
                sizes.append(len(record))
                counts.append(len(ids) + 1)
            starts = at + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            at = int(starts[-1])
            columns = [pa.array([name] * len(part)), pa.array(starts[:-1]), pa.array(sizes, pa.int64()), part.column("doc_id"), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "at", "size", "doc_id", "n_tokens"])
    finally:
        if out is not None:
            out.close()


def write_records(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write shards and index below ``path``; returns the index: shard, at, size, doc_id, n_tokens."""
    place = tokenizer_path(tokenizer)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    held = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // SHARD_BYTES))
    texts = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = texts.mapInArrow(lambda it: _write_shard(it, path, place, end_id), "shard string, at long, size long, doc_id long, n_tokens long")
    rows.write.parquet(f"{path}/index")
    return docs.sparkSession.read.parquet(f"{path}/index")


def parse_record(data: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of one framed record; raises ValueError if a checksum fails."""
    size, check = HEAD.unpack_from(data)
    body = data[HEAD.size : HEAD.size + size]
    if masked_crc(data[:8]) != check or masked_crc(body) != CRC.unpack_from(data, HEAD.size + size)[0]:
        raise ValueError("a record's checksum fails")
    doc_id, has_id, width = PAYLOAD.unpack_from(body)
    return doc_id if has_id else None, np.frombuffer(body, f"<u{width}", offset=PAYLOAD.size)


def _read_shards(batches):
    import pandas as pd

    for pdf in batches:
        for shard in pdf["shard"]:
            files, inner = _filesystem(shard)
            start, rows = 0, []
            with files.open_input_stream(inner, buffer_size=1 << 20) as f:
                while head := f.read(HEAD.size):
                    rest = f.read(HEAD.unpack(head)[0] + CRC.size)
                    doc_id, ids = parse_record(head + rest)
                    rows.append((doc_id, shard, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=["doc_id", "shard", "within", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "shard", "within", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record, read back from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    index = spark.read.parquet(f"{path}/index")
    shards = index.groupBy("shard").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("held"), F.max(F.col("doc_id").isNull()).alias("nulls"))
    # one row per shard: a prefix sum over the list of files
    order = Window.orderBy(F.desc("nulls"), "first", "shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("base"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = index.select("shard").distinct().repartition(parts).mapInPandas(_read_shards, "doc_id long, shard string, within long, n_tokens long, ids_crc32 long")
    return records.join(bases, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _fetch(batches):
    import pandas as pd

    for pdf in _rows(batches):
        rows = []
        for shard, at, size in zip(pdf["shard"], pdf["at"], pdf["size"], strict=True):
            files, inner = _filesystem(shard)
            with files.open_input_file(inner) as f:
                f.seek(int(at))
                doc_id, ids = parse_record(f.read(int(size)))
            rows.append((doc_id, ids.astype(np.int32)))
        yield pd.DataFrame(rows, columns=["doc_id", "ids"]).astype({"doc_id": "Int64"})


def read_shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """doc_id and token ids in a random order, each record fetched through its entry in the index."""

    index = spark.read.parquet(f"{path}/index")
    lot = F.xxhash64(F.lit(seed), "shard", "at")
    return index.repartitionByRange(lot).sortWithinPartitions(lot).mapInPandas(_fetch, "doc_id long, ids array<int>")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-records")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_records(spark, path)


QUERIES = {"op7_token_records": op7_token_records}
ORACLE: dict[str, str] = {}
