import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.sets import latest
from ledgerloom.plans.standins import table
from ledgerloom.sources.ledger import LEDGER
from ledgerloom.streaming import ledger as S

from .conftest import SF


@pytest.fixture()
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def run(spark, stream, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()


def batches(df, folder, parts):
    for i, part in enumerate(parts):
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def plain_chain(spark):
    rows = table(spark, SF, "events").filter("event_id < 120").selectExpr("cast(user_id % 3 as string) as key", "event_id as position", "props as payload").collect()
    heads, out = {}, {}
    for r in sorted(rows, key=lambda r: r["position"]):
        n, before = heads.get(r["key"], (0, S.GENESIS))
        heads[r["key"]] = n + 1, S.link(before, r["payload"])
        out[r["position"]] = (r["key"], n + 1, before, heads[r["key"]][1], r["payload"])
    return out


def test_stream_chain_equals_batch(spark, tmp_path, provider):
    df = table(spark, SF, "events").filter("event_id < 120").selectExpr("cast(user_id % 3 as string) as key", "event_id as position", "props as payload")
    got = run(spark, S.stream_chain(batches(df, tmp_path, ["position < 50", "position between 50 and 90", "position > 90"])), tmp_path)
    want = plain_chain(spark)
    assert {r["position"]: (r["key"], r["sequence"], r["previous_hash"], r["event_hash"]) for r in got} == {k: v[:4] for k, v in want.items()}


def test_stream_verify_waits_and_reports(spark, tmp_path, provider):
    rows = [(k, n, before, own, "changed" if (k, n) == ("1", 4) else payload) for k, n, before, own, payload in plain_chain(spark).values()]
    df = spark.createDataFrame(rows, "key string, sequence bigint, previous_hash string, event_hash string, payload string")
    last = max(n for k, n, *_ in rows if k == "0")
    parts = [f"sequence > 5 and not (key = '0' and sequence = {last})", "sequence <= 5", "key = '2' and sequence = 3"]
    got = run(spark, S.stream_verify(batches(df, tmp_path, parts)), tmp_path)
    assert sorted(tuple(r) for r in got) == [("1", 4, "wrong-hash"), ("2", 3, "late-or-doubled")]


def test_stream_state_equals_latest(spark, tmp_path):
    df = table(spark, SF, "events").select("user_id", "event_type", "event_id", "value")
    stream = batches(df, tmp_path, ["event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2"])
    S.stream_state(stream, f"{tmp_path}/state", f"{tmp_path}/marks", ["user_id", "event_type"], "event_id").awaitTermination(120)
    got = S.latest_version(spark, f"{tmp_path}/state")
    want = latest(df, ["user_id", "event_type"], "event_id")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stream_checkin_refuses_moved_heads(spark, tmp_path):
    ledger = spark.createDataFrame([("P", 1, *["x"] * 11, "HEAD")], LEDGER)
    ledger.write.parquet(f"{tmp_path}/ledger")
    df = spark.createDataFrame([("P", 1, "HEAD", "a"), ("P", 0, None, "b"), ("N", 0, None, "c")], "project_id string, expected_count int, expected_head string, event string")
    stream = batches(df, tmp_path, ["event = 'a'", "event = 'b'", "event = 'c'"])
    S.stream_checkin(stream, f"{tmp_path}/out", f"{tmp_path}/marks", S.guard_append(f"{tmp_path}/ledger")).awaitTermination(120)
    assert {r["event"] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").select(F.col("event")).collect()} == {"a", "c"}


def chain_rows(spark, key, n):
    rows, before = [], S.GENESIS
    for i in range(1, n + 1):
        own = S.link(before, f"p{i}")
        rows.append((key, i, before, own, f"p{i}"))
        before = own
    return rows


SHAPE = "key string, sequence bigint, previous_hash string, event_hash string, payload string"


def test_gaps_are_given_up_when_too_many_wait(spark, tmp_path, provider):
    rows = [r for r in chain_rows(spark, "a", 30) if r[1] not in (5, 6, 20)] + [r for r in chain_rows(spark, "b", 9) if r[1] != 2]
    rows += [("a", 25, "x", "y", "z")]  # doubled while it waits or behind
    got = run(spark, S.stream_verify(batches(spark.createDataFrame(rows, SHAPE), tmp_path, ["sequence < 15", "sequence >= 15"]), most_waiting=7), tmp_path)
    assert {tuple(r) for r in got} - {("a", 25, "late-or-doubled")} == {("a", 5, "gap"), ("a", 20, "gap")}


def test_gaps_are_given_up_in_time(spark, tmp_path, provider):
    rows = [r for r in chain_rows(spark, "a", 6) if r[1] != 3] + chain_rows(spark, "b", 3)
    stream = batches(spark.createDataFrame(rows, SHAPE), tmp_path, ["true"])
    query = S.stream_verify(stream, patience_ms=2000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            query.awaitTermination(1)
            assert query.exception() is None
            got = [tuple(r) for r in spark.read.schema("key string, sequence bigint, rule string").parquet(f"{tmp_path}/out").collect()] if (tmp_path / "out").exists() else []
            if got:
                break
    finally:
        query.stop()
    assert got == [("a", 3, "gap")]


class Calls:
    """A map in state that counts what is asked of it."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {"containsKey": self.kept.__contains__, "getValue": self.kept.__getitem__, "updateValue": self.kept.__setitem__, "removeKey": lambda k: self.kept.pop(k, None), "keys": lambda: list(self.kept)}[name]


class One:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def counted(most_waiting, parts):
    """What a verifier finds in batches of rows, fed one after another, and how often it asked for waiting events."""
    import pandas as pd

    v, found = S.ChainVerifier(None, most_waiting), []
    v.head, v.early = One(), Calls()
    for part in parts:
        chunk = pd.DataFrame(part, columns=["key", "sequence", "previous_hash", "event_hash", "payload"])
        for out in v.handleInputRows(("a",), [chunk], None):
            found += list(out.itertuples(index=False, name=None))
    return found, v.early.calls, v.early.kept


def test_waiting_events_take_few_calls_to_state(spark):
    rows = chain_rows(spark, "a", 1000)
    found, calls, kept = counted(S.MOST_WAITING, [rows[500:], rows[:500]])
    assert (found, kept) == ([], {}) and calls < 100  # four calls an event before
    # A gap is given up with the events at hand: those that come after it are never put in state.
    found, calls, kept = counted(5, [rows[:2] + rows[3:], rows[2:3]])
    assert (found, calls, kept) == ([("a", 3, "gap"), ("a", 3, "late-or-doubled")], 0, {})
    # With every second event lost, each is one gap.
    found, calls, kept = counted(5, [rows[1::2]])
    assert [f[1:] for f in found] == [(s, "gap") for s in range(1, 990, 2)] and sum(len(b[0]) for b in kept.values()) == 5
