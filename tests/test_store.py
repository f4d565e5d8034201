import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import chain as C
from ledgerloom.sources import store as S

SHAPE = "project_id string, occurred_at string, event_type string, object_type string, object_id string, actor_kind string, actor_id string, actor_uuid string, credential_fingerprint string, authority_basis string, details_json string"


def batch(spark, rows):
    return spark.createDataFrame([(p, f"t{i:03d}", "E", "o", f"o{i}", "system", None, None, None, "system", json.dumps({"n": i})) for p, i in rows], SHAPE)


def files_read(df):
    return {os.path.dirname(r[0]).split("/")[-1] for r in df.select(F.input_file_name()).distinct().collect()}


def test_appends_go_on_from_the_head(spark, tmp_path):
    store = S.LedgerStore(spark, str(tmp_path / "l"), buckets=8)
    assert store.version() == 0 and store.events().count() == 0 and store.heads().count() == 0
    assert store.append(batch(spark, [("A", 1), ("A", 2), ("B", 1)])) == 3
    assert store.append(batch(spark, [("A", 2), ("A", 3), ("C", 1)])) == 2  # A2 is there already
    assert store.append(batch(spark, [("B", 2)] * 2)) == 2 and store.append(batch(spark, [("B", 2)] * 3)) == 1  # equal events count
    assert store.append(batch(spark, [])) == 0
    ledger = store.events()
    assert C.verify_chain(ledger).count() == 0
    assert {(r["project_id"], r["event_sequence"], r["object_id"]) for r in ledger.collect()} == {("A", 1, "o1"), ("A", 2, "o2"), ("A", 3, "o3"), ("B", 1, "o1"), ("B", 2, "o2"), ("B", 3, "o2"), ("B", 4, "o2"), ("C", 1, "o1")}
    assert sorted(store.heads().collect()) == sorted(C.ledger_summary(ledger).select(store.heads().columns).collect())
    assert store.events(version=1).count() == 3 and {r["project_id"]: r["event_count"] for r in store.heads(version=2).collect()} == {"A": 3, "B": 1, "C": 1}


def test_reads_are_pruned_to_the_batch(spark, tmp_path):
    store = S.LedgerStore(spark, str(tmp_path / "l"), buckets=16)
    store.append(batch(spark, [(f"P{i}", 1) for i in range(60)]))
    asked = spark.createDataFrame([("P7",)], "project_id string")
    own = store._touched(asked)
    attempts = [r["attempt"] for r in store.commits().collect()]
    assert len(own) == 1 and files_read(store._read("events", attempts, S.LEDGER, own)) == {f"_bucket={own[0]}"}
    assert store.events(projects=asked).count() == 1
    store.append(batch(spark, [("P7", 2)]))
    last = store.commits().orderBy(F.desc("version")).first()
    assert last["buckets"] == own and os.listdir(tmp_path / "l/heads" / f"_attempt={last['attempt']}") != []
    assert {x for x in os.listdir(tmp_path / "l/heads" / f"_attempt={last['attempt']}") if x.startswith("_b")} == {f"_bucket={own[0]}"}


def test_of_two_appends_from_one_head_one_is_kept(spark, tmp_path):
    store = S.LedgerStore(spark, str(tmp_path / "l"), buckets=4)
    store.append(batch(spark, [("A", 1)]))
    seen = store.heads().select("project_id", F.col("event_count").alias("expected_count"), F.col("chain_head").alias("expected_head"))
    seen = spark.createDataFrame(seen.collect(), seen.schema)
    assert store.append(batch(spark, [("A", 2)]), expected=seen) == 1
    with pytest.raises(S.MovedHead):
        store.append(batch(spark, [("A", 3)]), expected=seen)
    # At the same time: both read version 2, and one of them commits version 3.
    results, gate, put = [], threading.Barrier(2), S.put_if_absent

    def together(*args):
        gate.wait(120)
        return put(*args)

    def run(n):
        try:
            results.append(store.append(batch(spark, [("A", n)])))
        except S.MovedHead:
            results.append("refused")

    S.put_if_absent = together
    try:
        threads = [threading.Thread(target=run, args=(n,)) for n in (10, 11)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    finally:
        S.put_if_absent = put
    assert sorted(map(str, results)) == ["1", "refused"]
    assert store.version() == 3 and store.events().count() == 3 and C.verify_chain(store.events()).count() == 0


def test_a_batch_is_taken_once(spark, tmp_path):
    store = S.LedgerStore(spark, str(tmp_path / "l"), buckets=4)
    run = S.append_stream(store, "s")
    for number in (0, 1, 1, 0):
        run(batch(spark, [("A", number)] * 2), number)
    assert store.version() == 2 and store.events().count() == 4


def test_put_if_absent(spark, tmp_path):
    at = str(tmp_path / "x/commit")
    assert S.put_if_absent(spark, at, "one") and not S.put_if_absent(spark, at, "two")
    assert open(at).read() == "one" and [f for f in os.listdir(tmp_path / "x") if f.endswith(".tmp")] == []


def test_failed_appends_leave_nothing_to_read(spark, tmp_path, monkeypatch):
    store = S.LedgerStore(spark, str(tmp_path / "l"), buckets=4)
    store.append(batch(spark, [("A", 1)]))

    def broken(*args):
        raise OSError("lost")

    monkeypatch.setattr(S, "put_if_absent", broken)
    with pytest.raises(OSError):
        store.append(batch(spark, [("A", 2)]), batch="b")
    monkeypatch.undo()
    assert store.events().count() == 1
    assert store.append(batch(spark, [("A", 2)]), batch="b") == 1 and store.append(batch(spark, [("A", 2)]), batch="b") == 0
    assert C.verify_chain(store.events()).count() == 0
