"""Removal of lines that many documents share, with two Bloom filters in front of the exact count.

1. A scan sends the hashes of lines to shards, by hash range, with the number of documents of a batch that hold each. A
   shard's task keeps the first Bloom filter, of the hashes seen once, and puts out those that it meets again.
2. Hashes met again as often as a line of min_docs documents must be make the second filter, of at most `max_bits` bits,
   which is broadcast. A second scan tests lines against it: only suspected repeats leave the scan, whatever the size of
   the corpus. The filter is sized by how many hashes it holds; beyond max_bits / 16 of them it lets more lines through,
   which then are counted like the others.
3. Suspects, as 128-bit digests with the place of the line, are counted exactly per key, and the document that keeps
   the line is chosen.
4. Documents are told the numbers of the lines they lose. A Bloom filter of the documents that lose lines lets all
   others through where they are: their text is not shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, text_slices, written

SEGMENT_BITS = 1 << 19
MOST_SHARDS = 1 << 10
LARGEST_SHARD = 1 << 29
# Shards of the first scan: one for each so many bytes of text, up to a number of them.
SHARD_BYTES, MOST_SCAN_SHARDS = 1 << 24, 1 << 14
HASHES = 4
BITS_A_KEY = 16


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space and with A-Z lower-cased; None when it is shorter than min_chars."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def keyed_lines(texts: list[bytes | None], min_chars: int) -> tuple[list[int], list[int], list[bytes]]:
    """(text, line, key) of every line that has a key."""
    rows, lines, keys = [], [], []
    for i, text in enumerate(texts):
        for j, line in enumerate((text or b"").split(b"\n")):
            if (key := line_key(line, min_chars)) is not None:
                rows.append(i)
                lines.append(j)
                keys.append(key)
    return rows, lines, keys


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def filter_bits(keys: int) -> int:
    """A power of two of at least BITS_A_KEY bits a key."""
    return max(SEGMENT_BITS, 1 << (BITS_A_KEY * max(keys, 1) - 1).bit_length())


def shard_bits(bits: int) -> int:
    """The size of a shard of a filter of so many bits: at most MOST_SHARDS shards, more once they reach LARGEST_SHARD."""
    return min(max(SEGMENT_BITS, bits // MOST_SHARDS), LARGEST_SHARD)


def shards(h: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each hash: its high bits."""
    n = bits // shard_bits(bits)
    return (h >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64) if n > 1 else np.zeros(len(h), np.int64)


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash within its shard of `bits` bits, by double hashing: one row a hash."""
    a, b = h & np.uint64(0xFFFFFFFF), (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


def set_bits(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def has_bits(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sharded(h: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(shard, hashes) rows of sorted hashes."""
    if len(h):
        of = shards(h, bits)
        cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        parts = np.split(h, cuts)
        yield pa.record_batch({"shard": pa.array([int(of[c]) for c in (0, *cuts)], pa.int64()), "hashes": pa.array([p.tobytes() for p in parts], pa.binary())})


def filter_table(hashes: DataFrame, bits: int) -> DataFrame:
    """(shard, bits) of a filter over (shard, hashes). Empty shards are left out.

    A task holds one shard at a time, and the result does not depend on the order of rows.
    """
    size = shard_bits(bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once = None, None

        def row() -> pa.RecordBatch:
            return pa.record_batch({"shard": pa.array([at], pa.int64()), "bits": pa.array([zlib.compress(once.tobytes(), 1)], pa.binary())})

        for batch in batches:
            for shard, h in zip(batch.column("shard").to_pylist(), batch.column("hashes"), strict=True):
                if shard != at:
                    if at is not None:
                        yield row()
                    at, once = shard, np.zeros(size // 8, np.uint8)
                set_bits(once, positions(np.frombuffer(h.as_buffer(), np.uint64), size).ravel())
        if at is not None:
            yield row()

    return hashes.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, "shard bigint, bits binary")


def gathered(table: DataFrame, bits: int) -> bytes:
    """All shards of a filter in one piece of bits / 8 bytes, which the caller bounds."""
    size = shard_bits(bits) // 8
    out = bytearray(bits // 8)
    for row in table.toLocalIterator():
        out[row["shard"] * size : (row["shard"] + 1) * size] = zlib.decompress(row["bits"])
    return bytes(out)


def passes(packed: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes a gathered filter lets through."""
    size = shard_bits(bits)
    return has_bits(packed, positions(h, size) + (shards(h, bits) * size)[:, None]).all(axis=1) if len(h) else np.zeros(0, bool)


def scan_shards(total_bytes: int) -> int:
    """The number of shards for a text of so many bytes: a power of two."""
    return min(MOST_SCAN_SHARDS, 1 << max(0, (total_bytes // SHARD_BYTES).bit_length()))


def line_hashes(texts: DataFrame, min_chars: int, n_shards: int) -> DataFrame:
    """(shard, n, hashes, counts): the hashes of the keyed lines of _text (binary) of a batch in a shard, in order, and how
    many documents of the batch hold each; n is how many hashes there are."""
    low = np.uint64(64 - (n_shards.bit_length() - 1))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for _, part in text_slices(batch):
                rows, _, keys = keyed_lines(part, min_chars)
                h, row = hashes_of(keys), np.array(rows, np.int64)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                own.append(h[np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]])  # a key counts once a document
            h, n = np.unique(np.concatenate(own or [np.zeros(0, np.uint64)]), return_counts=True)
            if len(h):
                of = (h >> low).astype(np.int64) if n_shards > 1 else np.zeros(len(h), np.int64)
                cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
                parts, counts = np.split(h, cuts), np.split(n.astype(np.uint32), cuts)
                yield pa.record_batch({
                    "shard": pa.array(of[np.r_[0, cuts]]), "n": pa.array([len(p) for p in parts], pa.int64()),
                    "hashes": pa.array([p.tobytes() for p in parts], pa.binary()), "counts": pa.array([c.tobytes() for c in counts], pa.binary()),
                })

    return texts.select("_text").mapInArrow(hashes, "shard bigint, n bigint, hashes binary, counts binary")


def met_again(hashes: DataFrame, bits: int) -> DataFrame:
    """(hash, again): the hashes of line_hashes that a filter of `bits` bits a shard has seen before, and in how many more
    documents they are than in the first that it saw. A task holds one shard's filter; a false alarm adds one."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once = None, None
        for batch in batches:
            found, more = [], []
            for shard, own, counts in zip(batch.column("shard").to_pylist(), batch.column("hashes"), batch.column("counts"), strict=True):
                if shard != at:
                    at, once = shard, np.zeros(bits // 8, np.uint8)
                h = np.frombuffer(own.as_buffer(), np.uint64)
                places = positions(h, bits)
                n = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64) - 1 + has_bits(once, places).all(axis=1)
                set_bits(once, places.ravel())
                found.append(h[n > 0])
                more.append(n[n > 0])
            yield pa.record_batch({"hash": pa.array(np.concatenate(found).view(np.int64)), "again": pa.array(np.concatenate(more))})

    return hashes.repartition("shard").sortWithinPartitions("shard").mapInArrow(again, "hash bigint, again bigint")


def bounded_filter(keys: DataFrame, n: int, max_bits: int):
    """(broadcast filter, its bits) over the single column of longs of keys, of which there are n: at most max_bits bits."""
    bits = max(SEGMENT_BITS, min(filter_bits(n), max_bits))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from sharded(np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), bits)

    return keys.sparkSession.sparkContext.broadcast(gathered(filter_table(keys.mapInArrow(hashes, "shard bigint, hashes binary"), bits), bits)), bits


def found_lines(batch: pa.RecordBatch, rows: np.ndarray, lines: np.ndarray, keys: list[bytes]) -> pa.RecordBatch:
    """A row (_id, _text_hash, _line, _digest) for each line; rows are numbers of rows of the batch."""
    at = pa.array(rows, pa.int64())
    columns = {c: batch.column(c).take(at) for c in ("_id", "_text_hash")}
    digests = [hashlib.blake2b(k, digest_size=16).digest() for k in keys]
    return pa.record_batch(columns | {"_line": pa.array(lines, pa.int32()), "_digest": pa.array(digests, pa.binary())})


def suspected_lines(texts: DataFrame, min_chars: int, min_docs: int, max_bits: int) -> DataFrame:
    """(_id, _text_hash, _line, _digest) of the lines whose key the filters saw in min_docs documents. texts: (_id, _text_hash, _text)."""
    total = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    hashes = written(line_hashes(texts, min_chars, scan_shards(total)), "line-hashes")
    most = hashes.groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    again = met_again(hashes, min(filter_bits(most), LARGEST_SHARD)).groupBy("hash").agg(F.sum("again").alias("again"))
    often = written(again.filter(F.col("again") >= min_docs - 1).select("hash"), "suspected-hashes")
    seen, bits = bounded_filter(often, often.count(), max_bits)
    shape = T.StructType([texts.schema["_id"], texts.schema["_text_hash"], T.StructField("_line", T.IntegerType()), T.StructField("_digest", T.BinaryType())])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(seen.value, np.uint8)
        for batch in batches:
            for first, part in text_slices(batch):
                rows, lines, keys = keyed_lines(part, min_chars)
                hit = np.flatnonzero(passes(packed, hashes_of(keys), bits))
                if len(hit):
                    yield found_lines(batch, first + np.array(rows)[hit], np.array(lines)[hit], [keys[i] for i in hit])

    return texts.mapInArrow(suspects, shape)


def repeated_lines(suspects: DataFrame, min_docs: int) -> DataFrame:
    """(_digest, _n, _keep): the exact count of documents that hold a key, and the largest id among them."""
    counted = suspects.groupBy("_digest").agg((F.countDistinct("_id") + F.max(F.col("_id").isNull().cast("int"))).alias("_n"), F.max("_id").alias("_keep"))
    return counted.filter(F.col("_n") >= min_docs)


def lost_lines(suspects: DataFrame, repeated: DataFrame) -> DataFrame:
    """(_id, _text_hash, _lost): the numbers of the lines that each document loses."""
    # A key held by more than a 512th of the suspects would fill one task: there are at most 512 such keys, so they are broadcast.
    often = max(1000, suspects.count() // 512)
    hot = repeated.filter(F.col("_n") > often).select("_digest", F.struct("_keep").alias("_hot"))
    split = suspects.join(F.broadcast(hot), "_digest", "left")
    place = ["_id", "_text_hash", "_line"]
    parts = split.filter("_hot is not null").select(*place, F.col("_hot._keep").alias("_keep"))
    parts = parts.unionByName(split.filter("_hot is null").join(repeated.filter(F.col("_n") <= often).hint("merge"), "_digest").select(*place, "_keep"))
    return parts.filter(~F.col("_id").eqNullSafe(F.col("_keep"))).groupBy("_id", "_text_hash").agg(F.collect_set("_line").alias("_lost"))


def may_hold(keys: DataFrame, max_bits: int):
    """A column function that is true for every long in the single column of keys, and for few others, from a Bloom filter of at most max_bits bits."""
    seen, bits = bounded_filter(keys, keys.count(), max_bits)

    @F.arrow_udf(T.BooleanType())
    def may(key: pa.Array) -> pa.Array:
        return pa.array(passes(np.frombuffer(seen.value, np.uint8), key.to_numpy(zero_copy_only=False).view(np.uint64), bits), pa.bool_())

    return may


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, max_bits: int = 1 << 29) -> DataFrame:
    """Drop lines that at least min_docs documents hold, except in the document with the largest id that holds them.

    A text is split at line feeds; null and empty texts are one empty line. The key of a line is the line without
    white space at its ends and with A-Z in lower case; keys of fewer than min_chars code points are never dropped.
    Returns the rows and columns of docs with text_col replaced (null becomes empty), and n_lines and n_dropped, which
    replace columns of these names. Rows with one id are one document: it counts once, and its rows are treated alike.
    Rows without an id are one document too, whose id is below all others. What is broadcast has at most max_bits bits,
    twice; the filter of documents lets more through beyond max_bits / 16 documents that lose lines, whose text is then
    shuffled like theirs. The rows do not depend on it.
    """
    rows, at = numbered(docs)
    id_at, text_at = at[id_col], at[text_col]
    text = F.coalesce(F.col(text_at), F.lit(""))
    rows = rows.withColumns({text_at: text, "_text_hash": F.xxhash64(text)})
    texts = rows.select(F.col(id_at).alias("_id"), "_text_hash", F.col(text_at).cast("binary").alias("_text"))
    suspects = written(suspected_lines(texts, min_chars, min_docs, max_bits), "suspected-lines")
    repeated = written(repeated_lines(suspects, min_docs), "repeated-lines")
    lost = written(lost_lines(suspects, repeated).withColumn("_doc", F.xxhash64("_id", "_text_hash")), "lost-lines")
    may = may_hold(lost.select("_doc"), max_bits)

    n = F.octet_length(text_at) - F.octet_length(F.replace(F.col(text_at), F.lit("\n"))) + 1
    asked = rows.withColumn("_doc", F.xxhash64(id_at, "_text_hash")).withColumn("_may", may("_doc"))
    stay = asked.filter("not _may").withColumns({"n_lines": n.cast("long"), "n_dropped": F.lit(0).cast("long")})
    met = asked.filter("_may").join(lost.select(*[F.col(c).alias(f"{c}2") for c in ("_doc", "_id", "_text_hash", "_lost")]), (F.col("_doc") == F.col("_doc2")) & (F.col("_text_hash") == F.col("_text_hash2")) & F.col(id_at).eqNullSafe(F.col("_id2")), "left")
    split = F.split(text_at, "\n", -1)
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "_lost2"), lambda i: F.get(split, i)), "\n")
    moved = met.withColumns({"n_lines": F.size(split).cast("long"), "n_dropped": F.when(F.col("_lost2").isNull(), 0).otherwise(F.size("_lost2")).cast("long"), text_at: F.when(F.col("_lost2").isNull(), F.col(text_at)).otherwise(left)})
    own = at | {"n_lines": "n_lines", "n_dropped": "n_dropped"}
    done = stay.select(*own.values()).unionByName(moved.select(*own.values()))
    return done.toDF(*own)
