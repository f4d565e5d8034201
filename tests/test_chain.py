import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import hashing as H
from ledgerloom.operators import chain as C

FIELDS = "project_id string, event_sequence bigint, occurred_at string, event_type string, object_type string, object_id string, actor_kind string, actor_id string, actor_uuid string, credential_fingerprint string, authority_basis string, details_json string"


def events():
    rows = []
    for p in ("A", "B"):
        for s in range(1, 9):
            who = (None, None, None) if s % 2 else (f"OP-{s}", "uuid", "F0")
            rows.append((p, s, f"2026-01-01T00:00:{s:02}Z", "EXAMPLE", "file", f'FILE-"{s}"é\\', "operator" if who[0] else "system", *who, "basis", json.dumps({"n": s, "message": "café\n"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
    return rows


def plain_hash(row, previous, algorithm):
    p, seq, at, kind, otype, oid, akind, aid, uuid, key, basis, details = row
    material = {
        "schema": "audit-event/v3", "hash_algorithm": algorithm, "event_sequence": seq, "occurred_at": at, "event_type": kind, "object_type": otype, "object_id": oid,
        "actor": {"kind": akind, "operator_id": aid, "operator_uuid": uuid, "credential_fingerprint": key, "authority_basis": basis}, "details": json.loads(details), "previous_hash": previous,
    }
    return plain_digest(algorithm)(json.dumps(material, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def plain_digest(algorithm):
    name, _, bits = algorithm.partition("-")
    return (lambda b: getattr(hashlib, name)(b, digest_size=int(bits) // 8)) if name.startswith("blake") else getattr(hashlib, algorithm.replace("-", "_"))


@pytest.mark.parametrize("algorithm", ["sha256", "sha512", "sha3-512", "blake2b-256"])
def test_build_and_verify(spark, algorithm):
    ledger = C.build_chain(spark.createDataFrame(events()[::-1], FIELDS).repartition(3), algorithm=algorithm)
    got = {(r["project_id"], r["event_sequence"]): (r["previous_hash"], r["event_hash"]) for r in ledger.collect()}
    for p in ("A", "B"):
        previous = "0" * H.WIDTHS[algorithm]
        for row in (r for r in events() if r[0] == p):
            want = plain_hash(row, previous, algorithm)
            assert got[p, row[1]] == (previous, want)
            previous = want
    assert C.verify_chain(ledger, algorithm=algorithm).count() == 0


@pytest.fixture(scope="module")
def ledger(spark):
    return C.build_chain(spark.createDataFrame(events(), FIELDS)).cache()


def found(df):
    return sorted((r["target"], r["rule"], r["key"]) for r in C.verify_chain(df).collect())


def at():
    return (F.col("project_id") == "A") & (F.col("event_sequence") == 4)


@pytest.mark.parametrize("column", ["occurred_at", "event_type", "object_type", "object_id", "actor_kind", "actor_id", "actor_uuid", "credential_fingerprint", "authority_basis"])
def test_every_changed_column_is_found(ledger, column):
    assert found(ledger.withColumn(column, F.when(at(), "x").otherwise(F.col(column)))) == [("A", "wrong-hash", "4")]


def test_other_tampering_is_found(ledger):
    assert found(ledger.withColumn("details_json", F.when(at(), '{"n":0}').otherwise(F.col("details_json")))) == [("A", "wrong-hash", "4")]
    assert found(ledger.filter(~at())) == [("A", "sequence-gap", "5")]
    assert found(ledger.withColumn("previous_hash", F.when(at(), F.repeat(F.lit("1"), F.lit(64))).otherwise(F.col("previous_hash")))) == [("A", "broken-link", "4"), ("A", "wrong-hash", "4")]
    assert found(ledger.withColumn("event_hash", F.when(at(), F.repeat(F.lit("1"), F.lit(64))).otherwise(F.col("event_hash")))) == [("A", "broken-link", "5"), ("A", "wrong-hash", "4")]
    assert ("A", "doubled-sequence", "4") in found(ledger.unionByName(ledger.filter(at())))
    assert found(ledger.limit(0)) == []


def test_heads_checkpoints_and_guard(spark, ledger):
    now = C.ledger_summary(ledger).withColumn("state_digest", F.lit("d"))
    marks = now.withColumn("chain_head", F.when(F.col("project_id") == "B", "old").otherwise(F.col("chain_head")))
    more = now.unionByName(now.limit(1).withColumn("project_id", F.lit("C")))
    assert {tuple(r) for r in C.checkpoint_status(marks, more).collect()} == {("A", "current"), ("B", "stale"), ("C", "absent")}
    head = {r["project_id"]: r["chain_head"] for r in now.collect()}
    batch = spark.createDataFrame([("A", 8, head["A"]), ("B", 8, "other"), ("C", 0, None), ("D", 3, "x")], "project_id string, expected_count int, expected_head string")
    assert {r["target"] for r in C.append_guard(batch, now).collect()} == {"B", "D"}
    new = spark.createDataFrame([("A", "k2"), ("A", "k1"), ("E", "k1")], "project_id string, k string")
    assert {tuple(r) for r in C.assign_sequences(new, now, ["k"]).select("project_id", "k", "event_sequence").collect()} == {("A", "k1", 9), ("A", "k2", 10), ("E", "k1", 1)}


@pytest.mark.parametrize("algorithm", ["sha256", "sha512", "sha3-256", "sha3-512", "blake2b-256", "blake2b-512", "blake2s-256"])
def test_digests(spark, algorithm):
    rows = spark.createDataFrame([("café",), (None,), ("",)], "v string").select("v", H.digest("v", algorithm).alias("d")).collect()
    plain = plain_digest(algorithm)
    assert [r["d"] for r in rows] == [plain("café".encode()).hexdigest(), None, plain(b"").hexdigest()]
    assert len(rows[0]["d"]) == H.WIDTHS[algorithm]


def test_canonical_json(spark):
    texts = ['{"b": 1.0, "a": [1, null, "é"]}', "no json", None, '{"x":1e+30}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(H.canonical_json("t")).collect()]
    assert got == ['{"a":[1,null,"é"],"b":1.0}', None, None, '{"x":1e+30}']


def test_state_digest_ignores_order_and_sees_changes(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 7 as string) as v")
    digest = lambda x: [tuple(r) for r in H.state_digest({"t": x, "empty": x.limit(0)}, 1).orderBy("table").collect()]
    assert digest(df) == digest(df.orderBy(F.desc("id")).repartition(5))
    assert digest(df)[1][2] != digest(df.withColumn("v", F.when(F.col("id") == 77, "x").otherwise(F.col("v"))))[1][2]
    assert digest(df)[0][:2] == ("empty", 0)


def test_ordered_state_digest_of_keys_dealt_by_earlier_shuffles(spark):
    """Tables of different size: tasks of the small one are put together otherwise than those of the large one."""
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in settings}
    large = spark.range(20_000).selectExpr("cast(id % 25 as string) as project_id", "id as a")
    small = spark.range(50).selectExpr("cast(id % 25 as string) as project_id", "id as b")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r["project_id"]: r["state_digest"] for r in H.ordered_state_digest({"x": (large, ["a"]), "y": (small, ["b"])}).collect()}
        n = H.ordered_state_digest({"x": (large, ["a"]), "y": (small, ["b"])}).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = lambda c, k, m: [{c: i} for i in range(k, m, 25)]
    said = {str(k): json.dumps({"x": rows("a", k, 20_000), "y": rows("b", k, 50)}, separators=(",", ":")) for k in range(25)}
    assert n == 25 and got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in said.items()}
