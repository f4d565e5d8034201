"""Hash chains over append-only ledgers: building, verifying, heads, gaps, anchors, guarded appends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import NATIVE, WIDTHS, digest, envelope, event_hash, genesis, hasher
from ..sources.shared import dealt, tasks
from .findings import finding, row_findings

KEY, SEQ = "project_id", "event_sequence"


def chain_parts(df: DataFrame, key: str, order: str, head: Column, tail: Column, algorithm: str = "sha256", start: str | None = None) -> DataFrame:
    """df with previous_hash and event_hash: each hash covers head, the hash before it in its key, and tail.

    Heads and tails are made in parallel. Links of one key follow one another, so its rows pass in order through one
    task, one at a time; keys run side by side. Ties in `order` are put in the order of their heads. `start` is a column
    with the hash that a key's first row goes on from, zeroes by default.
    """
    rows = df.withColumns({"_head": head, "_tail": tail}).drop("previous_hash", "event_hash")
    zero = "0" * WIDTHS[algorithm]
    out = T.StructType([*rows.drop("_head", "_tail").schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("event_hash", T.StringType())])
    at, kept = rows.columns.index(key), [c for c in rows.columns if c not in ("_head", "_tail")]

    def link(batches: Iterator) -> Iterator:
        import pyarrow as pa

        new, held, previous, started = hasher(algorithm), None, zero, False
        for batch in batches:
            keys, heads, tails = (batch.column(c).to_pylist() for c in (at, batch.schema.get_field_index("_head"), batch.schema.get_field_index("_tail")))
            starts = batch.column(batch.schema.get_field_index(start)).to_pylist() if start else [zero] * len(keys)
            before, after = [], []
            for k, a, b, first in zip(keys, heads, tails, starts, strict=True):
                if not started or k != held:
                    held, previous, started = k, first, True
                before.append(previous)
                previous = new(f"{a}{previous}{b}".encode()).hexdigest()
                after.append(previous)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "previous_hash", "event_hash"])

    return dealt(rows, key).sortWithinPartitions(key, order, "_head").mapInArrow(link, out)


def build_chain(ledger: DataFrame, schema: str = "audit-event/v3", algorithm: str = "sha256", key: str = KEY) -> DataFrame:
    """A ledger's events with previous_hash and event_hash, chained by event_sequence within each key."""
    head, tail = envelope(schema, algorithm)
    return chain_parts(ledger, key, SEQ, head, tail, algorithm)


def fold_chain(df: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """(key, n, head): the last hash of a plain SHA-256 chain over payloads, by order and payload; a null payload adds nothing.

    Rows pass one by one, as in chain_parts: a key may be as long as it likes. One shuffle, and only heads come out.
    """
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("n", T.LongType()), T.StructField("head", T.StringType())])

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        new, held, n, previous = hasher("sha256"), None, 0, "0" * 64
        for batch in batches:
            done, column = [], batch.column(0)
            for k, p in zip(column.to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n and k != held:
                    done.append((held, n, previous))
                    n, previous = 0, "0" * 64
                held, n, previous = k, n + 1, new(f"{previous}{p}".encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((column.type, pa.int64(), pa.string()))], names=out.names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([held], column.type), pa.array([n], pa.int64()), pa.array([previous], pa.string())], names=out.names)

    rows = df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.coalesce(payload, F.lit("")).alias("_payload"))
    return dealt(rows, "_key").sortWithinPartitions("_key", "_order", "_payload").select("_key", "_payload").mapInArrow(fold, out)


def with_predecessor(ledger: DataFrame, columns: list[str], key: str = KEY, seq: str = SEQ, prefix: str = "prev_") -> DataFrame:
    """Each row with columns of the row whose sequence is one less in the same key; null where there is none."""
    before = ledger.select(F.col(key).alias("_k"), (F.col(seq) + 1).alias("_s"), *[F.col(c).alias(prefix + c) for c in columns])
    return ledger.join(before, (F.col(key) == F.col("_k")) & (F.col(seq) == F.col("_s")), "left").drop("_k", "_s")


def sequence_gaps(ledger: DataFrame, key: str = KEY, seq: str = SEQ) -> DataFrame:
    """(key, seq) of events whose predecessor is missing, but for sequence 1."""
    before = ledger.select(F.col(key).alias("_k"), (F.col(seq) + 1).alias("_s"))
    return ledger.filter(F.col(seq) != 1).join(before, (F.col(key) == F.col("_k")) & (F.col(seq) == F.col("_s")), "left_anti").select(key, seq)


def ledger_summary(ledger: DataFrame, key: str = KEY, seq: str = SEQ, head: str = "event_hash", time: str = "occurred_at") -> DataFrame:
    """(key, event_count, chain_head, last_event_at)."""
    return ledger.groupBy(key).agg(F.count("*").alias("event_count"), F.max_by(head, seq).alias("chain_head"), F.max_by(time, seq).alias("last_event_at"))


def verify_chain(ledger: DataFrame, schema: str = "audit-event/v3", algorithm: str = "sha256", key: str = KEY) -> DataFrame:
    """Findings: sequences that are doubled or have gaps, links that do not match, hashes that do not.

    Each hash is computed again from the stored predecessor, and each stored predecessor is compared with the hash of
    the event before it, so a whole chain is checked in parallel.
    """
    before = ledger.select(F.col(key).alias("_k"), (F.col(SEQ) + 1).alias("_s"), F.col("event_hash").alias("_before"), F.lit(True).alias("_has"))
    linked = ledger.join(before, (F.col(key) == F.col("_k")) & (F.col(SEQ) == F.col("_s")), "left")
    first = F.col(SEQ) == 1
    hashed = linked.withColumns({"_expected_link": F.when(first, genesis(algorithm)).otherwise(F.col("_before")), "_expected_hash": event_hash(F.col("previous_hash"), schema, algorithm)})
    where = F.col(SEQ).cast("string")
    found = row_findings(hashed, F.col(key), where, [
        ("sequence-gap", ~first & F.col("_has").isNull(), None, None, None),
        ("broken-link", (first | F.col("_has")) & ~F.col("_expected_link").eqNullSafe(F.col("previous_hash")), "previous_hash", F.col("_expected_link"), F.col("previous_hash")),
        ("wrong-hash", ~F.col("_expected_hash").eqNullSafe(F.col("event_hash")), "event_hash", F.col("_expected_hash"), F.col("event_hash")),
    ])
    doubled = ledger.groupBy(key, SEQ).count().filter("count > 1")
    return found.unionByName(finding(doubled, F.col(key), "doubled-sequence", where, SEQ, F.lit("1"), F.col("count").cast("string")))


def anchor_check(manifests: DataFrame, ledger: DataFrame, key: str = KEY) -> DataFrame:
    """manifests (key, event_count, chain_head) with anchored: the ledger has that hash at that count; at 0 it is 64 zeroes."""
    at = ledger.select(F.col(key).alias("_k"), F.col(SEQ).alias("_s"), F.col("event_hash").alias("_hash"))
    n = tasks(ledger.sparkSession)
    joined = manifests.repartition(n, key, "event_count").join(at.repartition(n, "_k", "_s"), (F.col(key) == F.col("_k")) & (F.col("event_count") == F.col("_s")), "left")
    expected = F.when(F.col("event_count") == 0, F.lit("0" * 64)).otherwise(F.col("_hash"))
    return joined.withColumn("anchored", F.coalesce(F.col("chain_head") == expected, F.lit(False))).drop("_k", "_s", "_hash")


def checkpoint_status(checkpoints: DataFrame, now: DataFrame, key: str = KEY) -> DataFrame:
    """(key, status) for each key of `now`: current, stale or absent, by comparison with its last checkpoint.

    Both have event_count, chain_head and state_digest.
    """
    fields = ["event_count", "chain_head", "state_digest"]
    last = checkpoints.groupBy(key).agg(F.max_by(F.struct(*fields), "event_count").alias("_last"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"_last.{f}").eqNullSafe(F.col(f))
    joined = now.join(last, key, "left")
    return joined.select(key, F.when(F.col("_last").isNull(), "absent").when(same, "current").otherwise("stale").alias("status"))


def assign_sequences(batch: DataFrame, heads: DataFrame, order: list[str], key: str = KEY) -> DataFrame:
    """A batch of events with event_sequence going on after each key's event_count in heads."""
    row = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return batch.join(heads.select(key, "event_count"), key, "left").withColumn(SEQ, (F.coalesce("event_count", F.lit(0)) + row).cast("long")).drop("event_count")


def append_guard(batch: DataFrame, heads: DataFrame, key: str = KEY) -> DataFrame:
    """Findings for batches (key, expected_count, expected_head) that were built on another head than the ledger's."""
    joined = batch.join(heads.select(key, "event_count", "chain_head"), key, "left")
    count = F.coalesce("event_count", F.lit(0))
    moved = joined.filter((F.col("expected_count") != count) | ((count > 0) & ~F.col("expected_head").eqNullSafe(F.col("chain_head"))))
    return finding(moved, F.col(key), "moved-head", F.col("expected_count").cast("string"), "chain_head", F.col("expected_head"), F.col("chain_head"))
