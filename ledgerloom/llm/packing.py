"""Best-fit packing of documents into training sequences, with conflicts.

Documents are cut into pieces of at most the capacity. Pieces are dealt evenly to shards of a bounded size, whatever
their source or cluster, and each shard is packed by itself: longest pieces first, each into the fullest bin that has
room and holds no piece it conflicts with. A shard's open bins are kept in the order of their room; each carries a
bitmap of its sources and one of its duplicate clusters, and the search goes on to the next bin until both are clear.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

CAPACITY = 2048
SHARD = 4096


def bits(values: list) -> list[int]:
    """A bit for each value that occurs more than once; 0 for others and for None, which conflict with nothing."""
    seen: dict[object, int] = {}
    for v in values:
        if v is not None:
            seen[v] = seen.get(v, 0) + 1
    places = {v: 1 << i for i, v in enumerate(v for v, n in seen.items() if n > 1)}
    return [places.get(v, 0) for v in values]


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each piece; pieces are placed in the order given, which should be by falling length."""
    source_bits, cluster_bits = bits(sources), bits(clusters)
    has_source: list[int] = []
    has_cluster: list[int] = []
    open_bins: list[tuple[int, int]] = []  # (room, bin), by room
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, source_bits, cluster_bits, strict=True):
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (has_source[b] & source or has_cluster[b] & cluster):
                break
            at += 1
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, len(has_source)
            has_source.append(0)
            has_cluster.append(0)
        has_source[b] |= source
        has_cluster[b] |= cluster
        bins.append(b)
        offsets.append(capacity - room)
        insort(open_bins, (room - length, b))
    return bins, offsets


def pieces(docs: DataFrame, length: str, id_col: str, source_col: str, cluster_col: str, capacity: int) -> DataFrame:
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.col(cluster_col).cast("string").alias("_cluster"), n.alias("_n"))
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / capacity)))
    cut = rows.select("*", F.explode(parts).alias("piece"))
    return cut.withColumns({"start": F.col("piece") * capacity, "length": F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity)}).drop("_n")


def pack_documents(docs: DataFrame, length_col: str, id_col: str = "doc_id", source_col: str = "source", cluster_col: str = "cluster", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(id_col, piece, start, length, bin, offset): where each piece of each document goes.

    A bin holds at most `capacity` units, and no two pieces of one source or of one duplicate cluster, so a document's
    own pieces are never together either if it has a source. Null sources and clusters conflict with nothing. Null,
    negative and zero lengths give one piece of length 0. Every row is packed by itself, repeated ones too. Shards have
    about `shard` pieces, dealt without regard to any key, and a task packs many of them one after another; bin is unique
    over shards. Other columns are dropped.
    """
    # Rows are numbered before they are written, so that a lost task deals them as before.
    cut = written(pieces(docs, length_col, id_col, source_col, cluster_col, capacity).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    n_shards = max(1, -(-cut.count() // shard))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards come one after another; one is held at a time."""
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            names = {c: rows.column(c).to_pylist() for c in ("length", "_source", "_cluster")}
            bins, offsets = best_fit(names["length"], names["_source"], names["_cluster"], capacity)
            base = rows.column("_shard")[0].as_py() << 32
            out = {c: rows.column(c) for c in ("_id", "piece", "start", "length")}
            return pa.record_batch(out | {"bin": pa.array([base + b for b in bins], pa.int64()), "offset": pa.array(offsets, pa.int64())})

        for batch in batches:
            of = batch.column("_shard").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in itertools.pairwise(cuts):
                if held and b > a and held[0].column("_shard")[0].as_py() != of[a]:
                    yield done()
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield done()

    dealt = cut.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(n_shards))).drop("_row").repartition("_shard").sortWithinPartitions("_shard", F.desc("length"), "_id", "piece")
    shape = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "bin", "offset")]])
    return dealt.mapInArrow(pack, shape).withColumnRenamed("_id", id_col)
