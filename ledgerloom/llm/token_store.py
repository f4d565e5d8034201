"""Token ids as binary blocks: one concatenated id array with Elias-Fano encoded document boundaries.

A store is a Parquet table of blocks. Rows are in the order (part, block), parts being ranges of the document id:
  part int, block int    place in the order
  n_docs bigint          documents in the block
  before bigint          ids in earlier blocks of the part
  n_tokens bigint        ids in the block
  data binary            the block (below)
Block format, little-endian: magic "EFID" | u8 bytes of an id (2 or 4) | u32 documents without an id, which come first |
i64 first document id | u64 u ids | list of document ids, less the first | list of boundaries | ids.
Boundaries are the n running ends of the documents. Both lists are Elias-Fano encoded: u8 low bits | u32 n | u32 bytes of
the upper part | low parts | upper part | select samples (u32 each). The low bits of each number are packed; its high
bits h are written as a 1 at position h + i of the upper part. Sample j is the position of the 1 with number 64 * j, so
that any number is found by a scan of a few bytes, in about 2 + log2(u / n) bits a document instead of a 64-bit table.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import BEYOND_LATIN, Recent, shared_dir, text_slices

HEAD = struct.Struct("<4sBIqQ")
EF_HEAD = struct.Struct("<BII")
SAMPLE = 64
BLOCK_TOKENS = 1 << 18
READ_DOCS = 4096
MOST_CACHED = 400_000
# Fixed value: the pattern of words of byte-level vocabularies, with the letters, numbers and white space up to U+024F.
LETTERS, NUMBERS, SPACE = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
WORD = re.compile(rf" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class EliasFano:
    """A sorted list of unsigned 64-bit numbers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.upper, self.samples = n, low_bits, low, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (max(most, 1) // max(n, 1)).bit_length() - 1)
        bits = values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros((most >> low_bits) + n + 1, np.uint8)
        upper[ones] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(upper, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def tobytes(self) -> bytes:
        return EF_HEAD.pack(self.low_bits, self.n, len(self.upper)) + self.low.tobytes() + self.upper.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        """The list at a byte of data, and where it ends."""
        low_bits, n, upper = EF_HEAD.unpack_from(data, at)
        at += EF_HEAD.size
        sizes = ((n * low_bits + 7) // 8, upper, 4 * -(-n // SAMPLE))
        low, high, samples = (np.frombuffer(data, np.uint8, size, at + sum(sizes[:k])) for k, size in enumerate(sizes))
        return cls(n, low_bits, low, high, samples.view("<u4")), at + sum(sizes)

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values with numbers i: each from its nearest sample on, over the bytes of the upper part up to its own 1."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        start = self.samples[i // SAMPLE].astype(np.int64)
        byte, left = start >> 3, i % SAMPLE
        word = self.upper[byte] & (0xFF << (start & 7) & 0xFF).astype(np.uint8)
        going = np.flatnonzero(np.bitwise_count(word) <= left)
        while len(going):
            left[going] -= np.bitwise_count(word[going])
            byte[going] += 1
            word[going] = self.upper[byte[going]]
            going = going[np.bitwise_count(word[going]) <= left[going]]
        for _ in range(7):
            some = left > 0
            word[some] &= word[some] - np.uint8(1)
            left[some] -= 1
        one = 8 * byte + np.log2(word & -word).astype(np.int64)
        return (one - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for j in range(self.low_bits):
            at = i * self.low_bits + j
            out |= (self.low[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.uint64) << np.uint64(j)
        return out


def pack_block(doc_ids: list[int | None], lengths: np.ndarray, ids: bytes, id_bytes: int) -> bytes:
    """A block of documents, in ascending order of their ids, with the given numbers of ids; ids are 32-bit, stored in id_bytes each."""
    ends = np.cumsum(lengths, dtype=np.int64)
    named = np.array([i for i in doc_ids if i is not None], np.int64)
    first = int(named[0]) if len(named) else 0
    body = np.frombuffer(ids, "<u4").astype(f"<u{id_bytes}").tobytes()
    head = HEAD.pack(b"EFID", id_bytes, len(doc_ids) - len(named), first, int(ends[-1]) if len(ends) else 0)
    return b"".join((head, EliasFano.of(named.view(np.uint64) - np.int64(first).view(np.uint64)).tobytes(), EliasFano.of(ends).tobytes(), body))


@dataclass
class Block:
    """An open block: offsets and ids come from its select structures."""

    n_null: int
    first: int
    names: EliasFano
    ends: EliasFano
    ids: np.ndarray

    def doc_ids(self, i: np.ndarray) -> pa.Array:
        """The ids of the documents with numbers i; documents without an id come first."""
        named = self.names.select(np.maximum(i - self.n_null, 0)) if self.names.n else np.zeros(len(i), np.uint64)
        return pa.array((named + np.int64(self.first).view(np.uint64)).view(np.int64), mask=i < self.n_null)

    def spans(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the documents with numbers i begin and end."""
        ends = self.ends.select(i).astype(np.int64)
        return np.where(i > 0, self.ends.select(np.maximum(i - 1, 0)).astype(np.int64), 0), ends


def open_block(data: bytes) -> Block:
    magic, id_bytes, n_null, first, u = HEAD.unpack_from(data)
    if magic != b"EFID":
        raise ValueError("not a token block")
    names, at = EliasFano.read(data, HEAD.size)
    ends, at = EliasFano.read(data, at)
    return Block(n_null, first, names, ends, np.frombuffer(data, f"<u{id_bytes}", u, at))


class Encoder:
    """The library's byte-level encoding, with each different word encoded once.

    Words are those of the vocabulary's pattern, here in classes for letters up to U+024F. Texts with letters beyond,
    whose classes depend on the version of Unicode, and texts that may hold special tokens go to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Recent(MOST_CACHED)

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode new words: those of a blank and letters many to a text, as nothing joins them; the rest one by one."""
        words = self.words.new
        plain = [w for w in new if w[0] == " " and w[1:].isalpha()]
        other = [w for w in new if not (w[0] == " " and w[1:].isalpha())]
        words.update(zip(other, self._direct(other), strict=True))
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids, of = array("I", e.ids).tobytes(), np.array(e.word_ids)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            if len(cuts) != len(group) + 1:
                raise ValueError("words were joined")
            words.update(zip(group, [ids[4 * a : 4 * b] for a, b in itertools.pairwise(cuts)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        texts = [t or "" for t in texts]
        whole = [i for i, t in enumerate(texts) if "<|" in t or not t.isascii() and BEYOND_LATIN.search(t)]
        done = dict(zip(whole, self._direct([texts[i] for i in whole]), strict=True))
        split = [[] if i in done else WORD.findall(t) for i, t in enumerate(texts)]
        self._learn(self.words.missing(set().union(*split)))
        held = self.words.new
        return [done[i] if i in done else b"".join(map(held.__getitem__, s)) for i, s in enumerate(split)]


@lru_cache(maxsize=4)
def load(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


STORE = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("data", T.BinaryType())])
ROWS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> str:
    """Encode text_col with the tokenizer file, append end_id to each document, and write the store at path, in ascending id order.

    Null and empty texts hold end_id alone. Rows without an id come first; rows with one id stay next to each other, by
    text. Text is shuffled once, to be sorted by id; a long text is a block of its own.
    """
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        id_bytes = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, block, before, doc_ids, ids, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in ids])
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "n_docs": len(ids), "before": before, "n_tokens": size, "data": pack_block(doc_ids, lengths, b"".join(ids), id_bytes)}], ROWS)

        for batch in batches:
            for first, texts in text_slices(batch):
                for doc_id, own in zip(batch.column("_id").slice(first, len(texts)).to_pylist(), encoder.encode(texts), strict=True):
                    if size and size + len(own) // 4 + 1 > BLOCK_TOKENS:
                        yield row()
                        block, before, doc_ids, ids, size = block + 1, before + size, [], [], 0
                    doc_ids.append(doc_id)
                    ids.append(own + end)
                    size += len(own) // 4 + 1
        if doc_ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    dealt = rows.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    dealt.mapInArrow(blocks, STORE).write.option("compression", "zstd").parquet(path)
    return path


def _read(spark: SparkSession, path: str, name: str, kind: T.DataType, value: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    """(doc_id, start, n_tokens, name) of every document; value makes the last column from ids and where documents begin and end."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, data in zip(batch.column("start").to_pylist(), batch.column("data"), strict=True):
                block = open_block(data.as_py())
                for at in range(0, block.ends.n, READ_DOCS):
                    i = np.arange(at, min(at + READ_DOCS, block.ends.n))
                    starts, ends = block.spans(i)
                    yield pa.record_batch({"doc_id": block.doc_ids(i), "start": pa.array(before + starts), "n_tokens": pa.array(ends - starts), name: value(block.ids, starts, ends)})

    return _placed(spark, path).mapInArrow(documents, T.StructType([*[T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens")], T.StructField(name, kind)]))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the store at path: doc_id, start (ids before it), n_tokens, ids array<int>."""

    def lists(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[starts[:1], ends] - starts[0], pa.int32()), pa.array(ids[starts[0] : ends[-1]].astype(np.int32)))

    return _read(spark, path, "ids", T.ArrayType(T.IntegerType()), lists)


def store_index(spark: SparkSession, path: str) -> DataFrame:
    """As read_store, with the CRC-32 of the ids as little-endian 32-bit integers (ids_crc32) in place of the ids."""

    def sums(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.array([zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())

    return _read(spark, path, "ids_crc32", T.LongType(), sums)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with the number of ids before each. Parts are summed up and broadcast: one number a task of the writing
    stage, of which the driver itself holds far more. The blocks' data is not shuffled."""
    store = spark.read.schema(STORE).parquet(path)
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    earlier = parts.select("part", (F.sum("_size").over(Window.orderBy("part")) - F.col("_size")).alias("_earlier"))
    start = (F.col("_earlier") + F.col("before")).alias("start")
    return store.join(F.broadcast(earlier), "part").select(start, "data")


def new_store(docs: DataFrame, tokenizer: str, **options) -> str:
    """A store in the shared folder."""
    return write_store(docs, f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}", tokenizer, **options)
