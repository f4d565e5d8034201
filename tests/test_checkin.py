import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import checkin as B
from ledgerloom.operators import decisions as D
from ledgerloom.operators import replay as R
from ledgerloom.sources import ledger as L


def candidates(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [
        ("good", " net\\a.txt", b"one", None, "net"), ("good", "net/b.bin", b"two", sha(b"two"), "net"), ("good", "log", b"one", None, "log"),
        ("unsafe", "../x", b"x", None, "net"), ("unsafe", "fine", b"x", None, "net"), ("twice", "a", b"x", None, "net"), ("twice", "a", b"y", None, "net"), ("copy", "a", b"x", sha(b"y"), "net"),
    ]
    return spark.createDataFrame(rows, "batch_id string, logical_path string, payload binary, copied_digest string, role string")


def test_batches_are_all_or_none(spark):
    prepared, found = B.prepare_batch(candidates(spark))
    assert {(r["target"], r["rule"]) for r in found.collect()} == {("unsafe", "unsafe-path"), ("twice", "doubled-path"), ("copy", "copy-differs")}
    counters = spark.createDataFrame([("file", "FILE", 41), ("artefact", "ART", 1)], "namespace string, prefix string, next_value int")
    done = B.commit_batch(prepared, found, counters)
    rows = sorted((r["logical_path"], r["file_id"], r["storage_path"]) for r in done.collect())
    assert rows == [("log", "FILE-000041", "files/good/FILE-000041/log"), ("net/a.txt", "FILE-000042", "files/good/FILE-000042/a.txt"), ("net/b.bin", "FILE-000043", "files/good/FILE-000043/b.bin")]
    assert {tuple(r) for r in B.batch_summary(prepared, done).collect()} == {("good", 3, "committed"), ("unsafe", 0, "refused"), ("twice", 0, "refused"), ("copy", 0, "refused")}
    edges = spark.createDataFrame([("net/a.txt", "net/b.bin"), ("net/a.txt", "gone")], "parent_path string, child_path string")
    ends, missing = B.relate(done, edges)
    assert {(r["parent_file_id"], r["child_file_id"]) for r in ends.collect()} == {("FILE-000042", "FILE-000043"), ("FILE-000042", None)}
    assert [(r["rule"], r["key"]) for r in missing.collect()] == [("unknown-child", "gone")]
    groups = {(r["role"], r["artefact_id"], tuple(r["file_ids"])) for r in B.group_artefacts(done, counters).collect()}
    assert groups == {("log", "ART-000001", ("FILE-000041",)), ("net", "ART-000002", ("FILE-000042", "FILE-000043"))}
    more = B.commit_batch(prepared, found, counters, extend=lambda df: df.withColumn("extra", F.lit(1)))
    assert "extra" in more.columns


def test_candidates(spark):
    found = spark.createDataFrame([("b", "a"), ("b", "x.part"), ("b", "core.json"), ("b", "left")], "batch_id string, logical_path string")
    kept, left = B.build_candidates(found, spark.createDataFrame([("b", "a")], "batch_id string, logical_path string"), ("core.json",))
    assert {r["logical_path"] for r in kept.collect()} == {"a", "core.json"} and [r["key"] for r in left.collect()] == ["left"]


def test_provenance(spark):
    df = spark.sql("select map('a', '1', 'b', '1') as defaults, map('b', '2', 'c', '2') as source, map('c', '3') as result")
    assert B.provenance_record(df).first()["record"] == {"a": "1", "b": "2", "c": "3"}


def test_ledger_round_trip(spark, tmp_path):
    from ledgerloom.operators.chain import verify_chain

    path = str(tmp_path / "ledger")
    base = [("P", f"2026-01-01T00:00:0{i}Z", "E", "o", f"O-{i}", "system", None, None, None, "b", "{}") for i in range(6)]
    fields = "project_id string, occurred_at string, event_type string, object_type string, object_id string, actor_kind string, actor_id string, actor_uuid string, credential_fingerprint string, authority_basis string, details_json string"
    spark.createDataFrame([], L.LEDGER).write.parquet(path)
    assert L.append_events(path, spark.createDataFrame(base[:4], fields)) == 4
    assert L.append_events(path, spark.createDataFrame(base[2:] + [("Q", *base[0][1:])], fields)) == 3
    ledger = L.read_ledger(spark, path)
    assert verify_chain(ledger).count() == 0
    assert sorted((r[0], r[1]) for r in ledger.select("project_id", "event_sequence").collect()) == [*(("P", i) for i in range(1, 7)), ("Q", 1)]


def test_appends_keep_different_events_of_one_second_and_repeat_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    fields = "project_id string, occurred_at string, event_type string, object_type string, object_id string, actor_kind string, actor_id string, actor_uuid string, credential_fingerprint string, authority_basis string, details_json string"
    event = lambda details, obj="O": ("P", "2026-01-01T00:00:00Z", "E", "o", obj, "system", None, None, None, None, details)
    spark.createDataFrame([], L.LEDGER).write.parquet(path)
    first, second = [event('{"n":1}'), event('{"n":1}'), event("{}", None)], [event('{"n":2}'), event('{"n":1}')]
    assert L.append_events(path, spark.createDataFrame(first, fields)) == 3
    assert L.append_events(path, spark.createDataFrame(first, fields)) == 0
    assert L.append_events(path, spark.createDataFrame(second, fields)) == 1
    head = spark.createDataFrame([("P", 3, "x")], "project_id string, expected_count bigint, expected_head string")
    with pytest.raises(ValueError):
        L.append_events(path, spark.createDataFrame([event('{"n":3}')], fields), expected=head)
    assert L.read_ledger(spark, path).count() == 4


def test_manifests_and_payloads(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for name in ("b", "a"):
        (tmp_path / "files" / name).write_bytes(name.encode() * 9)
    seen = L.scan_payloads(spark, str(tmp_path / "files"))
    assert sorted((r["size_bytes"], r["content_digest"]) for r in seen.collect()) == sorted((9, hashlib.sha256(n * 9).hexdigest()) for n in (b"a", b"b"))
    only = seen.select("path").filter(F.col("path").endswith("/a"))
    assert L.scan_payloads(spark, str(tmp_path / "files"), only=only).count() == 1
    L.write_manifest(seen, str(tmp_path / "manifest"))
    good, bad = L.read_manifest(spark, str(tmp_path / "manifest"))
    assert {tuple(r) for r in good.collect()} == {tuple(r) for r in seen.select("path", "content_digest").collect()} and bad.count() == 0
    (tmp_path / "broken.txt").write_text("zz  x\n" + "0" * 64 + "  fine\n\n  \nlast\r\n")
    good, bad = L.read_manifest(spark, str(tmp_path / "broken.txt"))
    assert good.count() == 1 and [(r["key"], r["actual"]) for r in bad.orderBy("key").collect()] == [("1", "zz  x"), ("5", "last")]


def test_metadata(spark):
    rows = L.promote_metadata(spark.createDataFrame([('{"title":"t","id":"1"}',), ("broken",), (None,)], "j string"), "j").collect()
    assert [(r["title"], r["id"], r["observation"]) for r in rows] == [("t", "1", None), (None, None, "metadata is no JSON object"), (None, None, "no metadata")]


def event(seq, kind, obj, data, signed=True, actor="OP-1", otype="x"):
    import json

    details = {"authority_transaction": {"actor_id": actor, "data": data}} if signed else data
    return ("P", seq, kind, otype, obj, actor, json.dumps(details))


def test_replay(spark):
    rows = [
        event(1, "PROJECT_GENESIS", "PRJ", {"operator_ref": "1", "operator_uuid": "u1", "public_key": "k", "identity": {"operator_id": "OP-1", "name": "n", "operator_key_fingerprint": "F", "operator_signing_subkey_fingerprint": "S"}, "export_policy": {"ordinary_export": "owner", "ciphertext_export": "owner", "confidential_plaintext_export": "owner", "broad_scope_export": "owner"}}),
        event(2, "CONTRIBUTOR_INVITED", "OP-2", {"operator_ref": "2", "operator_uuid": "u2", "public_key": "k2", "identity": {"operator_id": "OP-2", "name": "m", "operator_key_fingerprint": "F2", "operator_signing_subkey_fingerprint": "S2"}}),
        event(3, "CONTRIBUTOR_ACCEPTED", "OP-2", {}, actor="OP-2"),
        event(4, "CASE_OWNERSHIP_ASSIGNED", "CASE-1", {"owner_id": "OP-1"}),
        event(5, "OWNERSHIP_TRANSFER_PROPOSED", "CASE-1", {"transfer_id": "T1", "from_operator_id": "OP-1", "to_operator_id": "OP-2", "reason": "r"}, otype="case"),
        event(6, "OWNERSHIP_TRANSFER_ACCEPTED", "CASE-1", {"transfer_id": "T1"}, actor="OP-2", otype="case"),
        event(7, "CONFIDENTIAL_ACCESS_GRANTED", "N1", {"operator_id": "OP-2", "authority_basis": "explicit-grant", "reason": "a"}, otype="note"),
        event(8, "CONFIDENTIAL_ACCESS_GRANTED", "N1", {"operator_id": "OP-2", "authority_basis": "project-owner", "reason": "b"}, otype="note"),
        event(9, "CONFIDENTIAL_ACCESS_REVOKED", "N1", {"operator_id": "OP-2", "authority_basis": "project-owner", "granted_sequence": 8, "reason": "c"}, otype="note"),
        event(10, "EXPORT_POLICY_CHANGED", "project", {"policy": {"ordinary_export": "members", "ciphertext_export": "owner", "confidential_plaintext_export": "owner", "broad_scope_export": "owner"}}),
        event(11, "ARTEFACT_CREATED", "ART-1", {"file_ids": ["F1", "F2"], "role": "primary"}, signed=False),
        event(12, "IDENTIFIER_ISSUED", "CASE-000001", {"namespace": "case", "sequence": 1}, signed=False),
        event(13, "IDENTIFIER_RETIRED", "CASE-000001", {}, signed=False),
        event(14, "NOTE_CREATED", "N1", {"visibility": "confidential", "author_id": "OP-1", "revision": 1, "package_disclosure": "withheld", "file_id": "F9"}, otype="note"),
        event(15, "NOTE_REVISED", "N1", {"revision": 2, "file_id": "F10"}, otype="note"),
        event(16, "RECORD_REJECTED", "A9", {"reason": "no submission"}, otype="acquisition"),
        event(17, "CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED", "CT1", {"from_operator_id": "OP-1", "to_operator_id": "OP-2", "reason": "r", "scope": [{"object_type": "note", "object_id": "N1"}]}),
        event(18, "CONFIDENTIAL_AUTHORITY_TRANSFER_ACCEPTED", "CT1", {"scope": [{"object_type": "note", "object_id": "N1"}]}),
    ]
    ledger = spark.createDataFrame(rows, "project_id string, event_sequence bigint, event_type string, object_type string, object_id string, actor_id string, details_json string")
    p = R.projections()
    one = lambda name, where: R.project(ledger, p[name]).filter(where).collect()
    assert [(r["operator_id"], r["membership_role"], r["state"], r["resolved_sequence"]) for r in sorted(R.project(ledger, p["project_memberships"]).collect())] == [("OP-1", "owner", "active", "1"), ("OP-2", "contributor", "active", "3")]
    assert {(r["operator_id"], r["signing_fingerprint"]) for r in R.project(ledger, p["operator_keys"]).collect()} == {("OP-1", "S"), ("OP-2", "S2")}
    assert one("ownership_transfers", "transfer_id = 'T1'")[0]["state"] == "accepted"
    assert {(r["scope_id"], r["owner_id"], r["effective_from_sequence"]) for r in R.ownership(ledger).collect()} == {("PRJ", "OP-1", 1), ("CASE-1", "OP-2", 6)}
    assert {(r["authority_basis"], r["revoked_sequence"]) for r in R.project(ledger, p["access_grants"]).collect()} == {("explicit-grant", None), ("project-owner", "9")}
    assert one("export_policy", "true")[0]["ordinary_export"] == "members"
    assert {r["file_id"] for r in R.artefact_files(ledger).collect()} == {"F1", "F2"}
    assert one("identifiers", "true")[0]["state"] == "retired"
    assert R.counters(ledger).first()["next_value"] == 2
    assert [(r["latest_revision"], r["package_disclosure"]) for r in R.project(ledger, p["notes"]).collect()] == [("2", "withheld")]
    assert R.project(ledger, p["note_revisions"]).count() == 2
    assert R.project(ledger, p["record_authority"]).count() == 0
    assert [(r["authority_id"], r["effective_sequence"]) for r in R.confidential_authority(ledger).collect()] == [("OP-2", 18)]
    for each in p.values():
        assert R.project(ledger.limit(0), each).count() == 0


def test_decisions(spark):
    policy = spark.createDataFrame([("P", "members", "owner", "authority", "owner")], "project_id string, ordinary_export string, ciphertext_export string, confidential_plaintext_export string, broad_scope_export string")
    owners = spark.createDataFrame([("P", "O"), ("Q", "O")], "project_id string, owner_id string")
    members = spark.createDataFrame([(p, o, "active") for p in "PQ" for o in "OMA"] + [("P", "R", "removed")], "project_id string, operator_id string, state string")
    asked = spark.createDataFrame([("P", "O", "case", True), ("P", "M", "case", False), ("P", "M", "file", False), ("P", "M", "file", True), ("Q", "O", "file", False)], "project_id string, operator_id string, scope_type string, has_ciphertext boolean")
    assert [(r["rule"].split("_")[0], r["allowed"]) for r in sorted(D.decide_export(asked, policy, owners, members).collect(), key=lambda r: (r["project_id"], r["operator_id"] != "O", r["scope_type"], r["has_ciphertext"]))] == [("broad", True), ("broad", False), ("ordinary", True), ("ciphertext", False), ("ordinary", False)]
    strangers = spark.createDataFrame([("P", w, "file", False) for w in ("R", "X")], "project_id string, operator_id string, scope_type string, has_ciphertext boolean")
    assert [r["allowed"] for r in D.decide_export(strangers, policy, owners, members).collect()] == [False, False]
    authority = spark.createDataFrame([("N1", "A")], "object_id string, authority_id string")
    asked = spark.createDataFrame([("P", w, n) for w in "OAM" for n in ("N1", "N2")], "project_id string, operator_id string, object_id string")
    assert {(r["operator_id"], r["object_id"]) for r in D.decide_plaintext(asked, policy, owners, authority, members).filter("allowed").collect()} == {("O", "N1"), ("A", "N1")}


def test_decisions_ask_who_the_operator_is(spark):
    shape = "project_id string, operator_id string, " + ", ".join(f"{c} string" for c in D.IDENTITY[:4])
    operators = spark.createDataFrame([("P", "O", "n", None, "org", "r"), ("P", "M", "m", "c", None, "r"), ("P", "K", "k", "c", "o", "r"), ("Q", "O", "other", None, "org", "r"), ("P", "T", "t", "c", "o", "r"), ("P", "T", "t", "c", "o", "x")], shape)
    key = "project_id string, operator_id string, primary_fingerprint string, signing_fingerprint string, state string"
    keys = spark.createDataFrame([("P", "O", "F1", "S1", "active"), ("P", "O", "F0", "S0", "retired"), ("P", "M", "F2", "S2", "active"), ("P", "K", "F3", "S3", "retired"), ("Q", "O", "F1", "S1", "active"), ("P", "T", "F4", "S4", "active")], key)
    kept = D.kept_identities(operators, keys)
    members = spark.createDataFrame([("P", o, "active") for o in "OMKT"] + [("Q", "O", "removed")], "project_id string, operator_id string, state string")
    asked = [
        ("good", "P", "O", "n", None, "org", "r", "F1", "S1"), ("old key", "P", "O", "n", None, "org", "r", "F0", "S0"), ("role", "P", "O", "n", None, "org", "x", "F1", "S1"), ("null", "P", "M", "m", None, None, "r", "F2", "S2"),
        ("member", "P", "M", "m", "c", None, "r", "F2", "S2"), ("retired key", "P", "K", "k", "c", "o", "r", "F3", "S3"), ("removed", "Q", "O", "other", None, "org", "r", "F1", "S1"), ("twice", "P", "T", "t", "c", "o", "r", "F4", "S4"), ("stranger", "P", "X", "n", None, "org", "r", "F1", "S1"),
    ]
    requests = spark.createDataFrame(asked, "request_id string, project_id string, operator_id string, " + ", ".join(f"{c} string" for c in D.IDENTITY)).withColumns({"scope_type": F.lit("file"), "has_ciphertext": F.lit(False), "decrypt": F.lit(True)})
    policy = spark.createDataFrame([(p, "members", "members", "owner", "members") for p in "PQ"], "project_id string, ordinary_export string, ciphertext_export string, confidential_plaintext_export string, broad_scope_export string")
    owners = spark.createDataFrame([("P", "O"), ("Q", "O")], "project_id string, owner_id string")
    out = D.decide_export(requests, policy, owners, members, kept)
    assert {r["request_id"] for r in out.filter("allowed").collect()} == {"good", "member"} and out.count() == len(asked)
    items = requests.select("request_id", F.lit("F").alias("file_id"), F.lit("confidential-note-revision").alias("classification"), F.lit("N").alias("note_id"))
    authority = spark.createDataFrame([("N", "Z")], "object_id string, authority_id string")
    full = {r["request_id"]: r["reasons"] for r in D.decide_export_full(requests, items, policy, owners, authority, members, kept).collect()}
    assert full == {a[0]: [] if a[0] == "good" else ["plaintext"] if a[0] == "member" else ["ordinary", "plaintext"] for a in asked}
