"""Ledgers as streams: chains built and verified event by event, state kept up to date, guarded check-in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.chain import append_guard, ledger_summary
from ..operators.sets import latest
from ..sources.shared import written

GENESIS = "0" * 64
# Events of a key that may wait for one that has not come.
MOST_WAITING = 100_000
# Events ahead of their turn that are held at hand, before they are put in state.
AT_HAND = 50_000
# Sequence numbers to a block of waiting events in state.
BLOCK = 64


def link(previous: str, payload: str | None) -> str:
    return hashlib.sha256((previous + (payload or "")).encode()).hexdigest()


class ChainBuilder(StatefulProcessor):
    """Appends events to their key's chain: state is the head and the count. Events of a batch are taken by `position`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "sequence bigint, hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sequence, previous = self.head.get() if self.head.exists() else (0, GENESIS)
        events = [e for batch in rows for e in zip(batch["position"].tolist(), batch["payload"].tolist(), strict=True)]
        out = []
        for position, payload in sorted(events, key=lambda e: e[0]):
            sequence, before, previous = sequence + 1, previous, link(previous, payload)
            out.append((key[0], position, sequence, before, previous))
        self.head.update((sequence, previous))
        yield pd.DataFrame(out, columns=["key", "position", "sequence", "previous_hash", "event_hash"])

    def close(self) -> None:
        pass


class Waiting:
    """Events of a key that are ahead of their turn, by sequence. State holds them in blocks of sequence numbers, as each call
    to it takes longer than many events do: a block is read when it is asked for, and written back by save."""

    def __init__(self, state, n: int):
        self.state, self.n, self.stored = state, n, n > 0
        self.held: dict[int, dict[int, tuple]] = {}
        self.changed: set[int] = set()

    def block(self, number: int) -> dict[int, tuple]:
        if number not in self.held:
            there = self.stored and self.state.containsKey((number,))
            self.held[number] = {e[0]: tuple(e[1:]) for e in self.state.getValue((number,))[0]} if there else {}
        return self.held[number]

    def has(self, sequence: int) -> bool:
        return self.n > 0 and sequence in self.block(sequence // BLOCK)

    def put(self, events: dict[int, tuple]) -> None:
        for sequence, event in events.items():
            self.block(sequence // BLOCK)[sequence] = event
            self.changed.add(sequence // BLOCK)
        self.n += len(events)
        events.clear()

    def take(self, sequence: int) -> tuple | None:
        if not self.has(sequence):
            return None
        self.changed.add(sequence // BLOCK)
        self.n -= 1
        return self.held[sequence // BLOCK].pop(sequence)

    def numbers(self) -> list[int]:
        """The numbers of all blocks, ascending."""
        return sorted({*self.held, *(k[0] for k in self.state.keys())} if self.stored else self.held)

    def save(self) -> None:
        for number in self.changed:
            if self.held[number]:
                self.state.updateValue((number,), ([(s, *e) for s, e in sorted(self.held[number].items())],))
                self.stored = True
            elif self.stored:
                self.state.removeKey((number,))
        self.held.clear()
        self.changed.clear()


class ChainVerifier(StatefulProcessor):
    """Checks events of a chain as they come. Events ahead of their turn wait in state; those behind it are reported.

    An event that does not come is reported as a gap, at the first sequence that lacks: once patience_ms have passed since
    others began to wait for it, or as soon as more than most_waiting wait. The check goes on with the next that is there.
    """

    def __init__(self, patience_ms: int | None = None, most_waiting: int = MOST_WAITING):
        self.patience_ms, self.most_waiting = patience_ms, most_waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "sequence bigint, hash string, waiting bigint")
        self.early = handle.getMapState("early", "block bigint", "events array<struct<sequence:bigint,previous_hash:string,event_hash:string,payload:string>>")
        self.timer = handle.getValueState("timer", "sequence bigint, at bigint")

    def _go_on(self, key, sequence: int, head: str, early: Waiting, found: list, new: dict) -> tuple[int, str]:
        """Check what has its turn now, of the new events at hand and of those that wait."""
        while True:
            event = new.pop(sequence + 1, None) or early.take(sequence + 1)
            if event is None:
                return sequence, head
            before, own, payload = event
            sequence += 1
            if before != head:
                found.append((key[0], sequence, "broken-link"))
            if own != link(before, payload):
                found.append((key[0], sequence, "wrong-hash"))
            head = own

    def _give_up(self, key, sequence: int, head: str, early: Waiting, found: list, most: int) -> tuple[int, str]:
        """While more than `most` wait, give up on the next event: report it, and go on with the first that waits."""
        if early.n <= most:
            return sequence, head
        for number in early.numbers():
            for first in sorted(early.block(number)):
                if early.n <= most:
                    return sequence, head
                if first > sequence:
                    found.append((key[0], sequence + 1, "gap"))
                    sequence, head = self._go_on(key, first - 1, early.block(number)[first][0], early, found, {})
        return sequence, head

    def _keep(self, sequence: int, head: str, early: Waiting, timerValues) -> None:
        early.save()
        self.head.update((sequence, head, early.n))
        if self.patience_ms is None:
            return
        set_for, at = self.timer.get() if self.timer.exists() else (None, None)
        if set_for == sequence and early.n:
            return
        if at is not None:
            self.handle.deleteTimer(at)
            self.timer.clear()
        if early.n:
            at = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
            self.handle.registerTimer(at)
            self.timer.update((sequence, at))

    def _state(self) -> tuple[int, str, Waiting]:
        sequence, head, waiting = self.head.get() if self.head.exists() else (0, GENESIS, 0)
        return sequence, head, Waiting(self.early, waiting)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sequence, head, early = self._state()
        found, new = [], {}
        for batch in rows:
            for s, *event in zip(*[batch[c].tolist() for c in ("sequence", "previous_hash", "event_hash", "payload")], strict=True):
                if s <= sequence or s in new or early.has(s):
                    found.append((key[0], s, "late-or-doubled"))
                    continue
                new[s] = tuple(event)
            # Chunks of a batch come in any order: no gap is given up before all of them are there.
            sequence, head = self._go_on(key, sequence, head, early, found, new)
            if len(new) > AT_HAND:
                early.put(new)
                early.save()
        early.put(new)
        sequence, head = self._give_up(key, sequence, head, early, found, self.most_waiting)
        self._keep(sequence, head, early, timerValues)
        if found:
            yield pd.DataFrame(found, columns=["key", "sequence", "rule"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sequence, head, early = self._state()
        found = []
        set_for, at = self.timer.get() if self.timer.exists() else (None, None)
        self.timer.clear()
        if early.n and set_for == sequence and at is not None and at <= expiredTimerInfo.getExpiryTimeInMs():
            sequence, head = self._give_up(key, sequence, head, early, found, early.n - 1)
        self._keep(sequence, head, early, timerValues)
        if found:
            yield pd.DataFrame(found, columns=["key", "sequence", "rule"])

    def close(self) -> None:
        pass


def stream_chain(stream: DataFrame) -> DataFrame:
    """A stream (key string, position bigint, payload string) as (key, position, sequence, previous_hash, event_hash)."""
    return stream.groupBy("key").transformWithStateInPandas(ChainBuilder(), "key string, position bigint, sequence bigint, previous_hash string, event_hash string", "Append", "none")


def stream_verify(stream: DataFrame, patience_ms: int | None = None, most_waiting: int = MOST_WAITING) -> DataFrame:
    """A stream (key, sequence, previous_hash, event_hash, payload) as findings (key, sequence, rule).

    State is the head of each key and at most most_waiting events ahead of their turn. With patience_ms, time is that of
    processing: a gap is also reported when it has stood that long.
    """
    mode = "none" if patience_ms is None else "processingTime"
    return stream.groupBy("key").transformWithStateInPandas(ChainVerifier(patience_ms, most_waiting), "key string, sequence bigint, rule string", "Append", mode)


def versioned(path: str, batch: int) -> str:
    return f"{path}/v{batch:08d}"


BUCKETS = 64


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The newest version of each bucket of a table under path, or the newest before a batch: one number a bucket."""
    try:
        index = spark.read.schema("_bucket int, _version int").parquet(f"{path}/index/*")
    except AnalysisException:  # nothing is written yet
        return {}
    rows = index if before is None else index.filter(F.col("_version") < before)
    return {r["_bucket"]: r["_version"] for r in rows.groupBy("_bucket").agg(F.max("_version").alias("_version")).collect()}


def read_buckets(spark: SparkSession, path: str, versions: dict[int, int], buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of buckets in the given versions; partition pruning leaves all others unread."""
    wanted = {b: v for b, v in versions.items() if buckets is None or b in buckets}
    if not wanted:
        return None
    parts = [f"{path}/data/_version={v}/_bucket={b}" for b, v in sorted(wanted.items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*parts).drop("_version", "_bucket")


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that stream_state keeps at path: every bucket in its newest version; None before the first batch."""
    return read_buckets(spark, path, bucket_versions(spark, path))


def stream_state(stream: DataFrame, path: str, checkpoint: str, keys: list[str], seq: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest row of each key at path. The table is cut into buckets by key; a micro-batch reads and writes only
    the buckets that its keys are in, as a new version of them, and then names these in the index.

    A version is a function of the one before it and the batch, so a batch that is run again writes the same rows, and a
    batch that failed before it was named is as if it had never been.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = written(batch.withColumn("_bucket", bucket_of(keys, buckets)), "micro-batch")
        touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]
        if not touched:
            return
        held = read_buckets(spark, path, bucket_versions(spark, path, number), touched)
        both = rows.drop("_bucket") if held is None else held.select(batch.columns).unionByName(rows.drop("_bucket"))
        merged = latest(both, keys, seq).select(batch.columns).withColumn("_bucket", bucket_of(keys, buckets))
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/_version={number}")
        named = spark.createDataFrame([(b, number) for b in touched], "_bucket int, _version int")
        named.coalesce(1).write.mode("overwrite").parquet(f"{path}/index/{versioned('', number)[1:]}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_checkin(stream: DataFrame, path: str, checkpoint: str, commit: Callable[[DataFrame, int], DataFrame]) -> StreamingQuery:
    """Run check-in on each micro-batch and write what it commits below path; a batch that is run again replaces its own rows."""

    def run(batch: DataFrame, number: int) -> None:
        commit(batch, number).write.mode("overwrite").parquet(versioned(path, number))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def guard_append(ledger_path: str) -> Callable[[DataFrame, int], DataFrame]:
    """For stream_checkin: the rows of batches whose expected_count and expected_head are those of the ledger at ledger_path."""

    def commit(batch: DataFrame, number: int) -> DataFrame:
        heads = ledger_summary(batch.sparkSession.read.parquet(ledger_path))
        asked = batch.select("project_id", "expected_count", "expected_head").distinct()
        moved = append_guard(asked, heads).select(F.col("target").alias("project_id")).distinct()
        return batch.join(moved, "project_id", "left_anti")

    return commit
