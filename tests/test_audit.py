import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit as A
from ledgerloom.operators import replay as R
from ledgerloom.operators import scopes as Q
from ledgerloom.operators import verify as V

FIELDS = "project_id string, event_sequence bigint, occurred_at string, event_type string, object_type string, object_id string, actor_kind string, actor_id string, actor_uuid string, credential_fingerprint string, details_json string, previous_hash string"
POLICY = {"ordinary_export": "owner", "ciphertext_export": "owner", "confidential_plaintext_export": "owner", "broad_scope_export": "owner"}
SIGNED = {"FILE_COMMITTED", "FILE_RELATIONSHIP_ADDED", "ARTEFACT_CREATED", "IDENTIFIER_ISSUED", "IDENTIFIER_RETIRED", "FILE_PRESENTATION_CHANGED"}


def identity(n):
    return {"operator_id": f"OP-{n}", "name": f"n{n}", "operator_key_fingerprint": f"F{n}", "operator_signing_subkey_fingerprint": f"S{n}"}


def clean():
    """(type, object type, object id, actor, data) of a ledger that breaks no rule."""
    scope = [{"object_type": "note", "object_id": "N1"}]
    file = lambda n, path: ("FILE_COMMITTED", "file", f"FILE-{n}", 1, {"case_id": "CASE-000001", "acquisition_id": "A1", "logical_path": path, "classification": "confidential-note-revision", "content_digest": f"d{n}", "size_bytes": n, "storage_path": f"s/{n}"})
    return [
        ("PROJECT_GENESIS", "project", "P", 1, {"operator_ref": "1", "operator_uuid": "u1", "public_key": "k", "identity": identity(1), "export_policy": POLICY}),
        ("CONTRIBUTOR_INVITED", "operator", "OP-2", 1, {"operator_ref": "2", "operator_uuid": "u2", "public_key": "k", "identity": identity(2)}),
        ("CONTRIBUTOR_ACCEPTED", "operator", "OP-2", 2, {}),
        ("IDENTIFIER_ISSUED", "identifier", "CASE-000001", 1, {"namespace": "case", "sequence": 1}),
        ("CASE_OWNERSHIP_ASSIGNED", "case", "CASE-000001", 1, {"owner_id": "OP-1"}),
        file(1, "a/b"), file(2, "a/c"),
        ("FILE_RELATIONSHIP_ADDED", "file", "FILE-1", 1, {"parent_file_id": "FILE-1", "child_file_id": "FILE-2", "relationship": "describes"}),
        ("ARTEFACT_CREATED", "artefact", "ART-1", 1, {"case_id": "CASE-000001", "acquisition_id": "A1", "file_ids": ["FILE-1"], "role": "primary"}),
        ("ACQUISITION_RECORDED", "acquisition", "A1", 2, {"case_id": "CASE-000001", "status": "pending", "file_ids": ["FILE-1", "FILE-2"]}),
        ("RECORD_REJECTED", "acquisition", "A1", 1, {"reason": "blurred"}),
        ("FILE_PRESENTATION_CHANGED", "file", "FILE-2", 1, {"to": "retracted", "reason": "private"}),
        ("OWNERSHIP_TRANSFER_PROPOSED", "case", "CASE-000001", 1, {"transfer_id": "T1", "from_operator_id": "OP-1", "to_operator_id": "OP-2", "reason": "leave"}),
        ("OWNERSHIP_TRANSFER_ACCEPTED", "case", "CASE-000001", 2, {"transfer_id": "T1"}),
        ("EXPORT_POLICY_CHANGED", "project", "P", 1, {"previous": POLICY, "policy": POLICY | {"ordinary_export": "members"}}),
        ("NOTE_CREATED", "note", "N1", 1, {"visibility": "confidential", "author_id": "OP-1", "revision": 1, "package_disclosure": "withheld", "file_id": "FILE-1", "payload_digest": "d1"}),
        ("NOTE_REVISED", "note", "N1", 1, {"revision": 2, "reason": "typo", "file_id": "FILE-2", "payload_digest": "d2"}),
        ("NOTE_DISCLOSURE_CHANGED", "note", "N1", 1, {"package_disclosure": "include"}),
        ("CONFIDENTIAL_ACCESS_GRANTED", "note", "N1", 1, {"operator_id": "OP-2", "authority_basis": "explicit-grant", "reason": "help"}),
        ("CONFIDENTIAL_ACCESS_REVOKED", "note", "N1", 1, {"operator_id": "OP-2", "authority_basis": "explicit-grant", "granted_sequence": 19, "reason": "done"}),
        ("CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED", "transfer", "CT1", 1, {"from_operator_id": "OP-1", "to_operator_id": "OP-2", "reason": "leave", "scope": scope}),
        ("CONFIDENTIAL_AUTHORITY_TRANSFER_ACCEPTED", "transfer", "CT1", 2, {"scope": scope}),
        ("EXPORT_STARTED", "export", "E1", 1, {"scope_type": "case", "view_mode": "full", "representation": "native", "output_format": "tar", "policy_sequence": 15}),
        ("EXPORT_COMPLETED", "export", "E1", 1, {"manifest_digest": "m", "output_digest": "o", "items": [{"file_id": "FILE-1", "output_path": "x", "source_digest": "d1", "output_digest": "d1", "mode": "native"}]}),
        ("IDENTIFIER_RETIRED", "identifier", "CASE-000001", 1, {}),
    ]


def frame(spark, events):
    rows = []
    for n, (kind, otype, oid, actor, data) in enumerate(events, 1):
        at, before = f"t{n}", f"h{n - 1}"
        if kind in SIGNED:
            details = data
        else:
            transaction = {"schema": "authority-transaction/v2", "event_sequence": n, "occurred_at": at, "event_type": kind, "object_type": otype, "object_id": oid, "previous_hash": before, "actor_id": f"OP-{actor}", "actor_uuid": f"u{actor}", "actor_key_fingerprint": f"S{actor}", "data": data}
            details = {"authority_transaction": transaction, "authority_signature": "sig"}
        rows.append(("P", n, at, kind, otype, oid, "operator", f"OP-{actor}", f"u{actor}", f"S{actor}", json.dumps(details), before))
    return spark.createDataFrame(rows, FIELDS)


def test_clean_ledger_breaks_no_rule(spark):
    events = frame(spark, clean()).cache()
    assert A.audit(events).collect() == []
    assert A.audit(events.limit(0)).count() == 0


def change(events, kind, actor=None, data=None, oid=None):
    return [(k, t, oid if oid and k == kind else o, actor if actor and k == kind else a, {**d, **(data or {})} if k == kind else d) for k, t, o, a, d in events]


MORE = [
    ("R1", lambda e: change(e, "IDENTIFIER_ISSUED", data={"sequence": 2})), ("R9", lambda e: change(e, "ACQUISITION_RECORDED", data={"file_ids": ["FILE-2", "FILE-1"]})), ("R9", lambda e: change(e, "ACQUISITION_RECORDED", data={"file_ids": ["FILE-1"]})),
    ("R9", lambda e: [("IDENTIFIER_ISSUED", "identifier", "A7", 1, {"namespace": "acquisition", "sequence": 7}) if x[0] == "EXPORT_STARTED" else x for x in e]), ("R12", lambda e: [*e, ("FILE_COMMITTED", "file", "FILE-3", 1, {"case_id": "CASE-000001", "logical_path": "z"})]),
    ("R16", lambda e: change(e, "NOTE_CREATED", data={"author_id": "OP-2"})), ("R16", lambda e: change(e, "NOTE_REVISED", actor=2)), ("R16", lambda e: change(e, "NOTE_CREATED", data={"case_id": "C2", "subject_file_id": "FILE-1"})),
    ("R20", lambda e: change(e, "CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED", data={"from_operator_id": "OP-2"})), ("R20", lambda e: [*e[:21], ("CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED", "transfer", "CT2", 1, e[20][4]), *e[21:]]),
    ("R21", lambda e: change(e, "CONFIDENTIAL_AUTHORITY_TRANSFER_ACCEPTED", data={"scope": [{"object_type": "box", "object_id": "N1"}]})),
]


@pytest.mark.parametrize("rule, tamper", MORE)
def test_further_conditions_are_found(spark, rule, tamper):
    found = A.audit(frame(spark, tamper(clean())), rule).collect()
    assert found and all(r["rule"] == rule for r in found)


CASES = [
    ("R1", lambda e: [*e, ("IDENTIFIER_FAILED", "identifier", "CASE-000001", 1, {})]), ("R2", lambda e: [*e, e[0]]), ("R3", lambda e: change(e, "CONTRIBUTOR_INVITED", actor=2)), ("R4", lambda e: [*e, e[2]]),
    ("R5", lambda e: [*e, ("CONTRIBUTOR_REMOVED", "operator", "OP-2", 1, {"reason": " "})]), ("R6", lambda e: change(e, "OWNERSHIP_TRANSFER_PROPOSED", data={"to_operator_id": "OP-9"})),
    ("R7", lambda e: change(e, "OWNERSHIP_TRANSFER_ACCEPTED", actor=1)), ("R7", lambda e: [*e, ("OWNERSHIP_TRANSFER_CANCELLED", "case", "CASE-000001", 1, {"transfer_id": "T1"})]), ("R8", lambda e: change(e, "CASE_OWNERSHIP_ASSIGNED", actor=2)),
    ("R9", lambda e: change(e, "ACQUISITION_RECORDED", data={"status": "approved"})), ("R10", lambda e: change(e, "RECORD_REJECTED", data={"reason": ""})), ("R10", lambda e: change(e, "RECORD_REJECTED", actor=2)),
    ("R11", lambda e: change(e, "EXPORT_POLICY_CHANGED", data={"policy": POLICY | {"ordinary_export": "all"}})), ("R12", lambda e: change(e, "FILE_COMMITTED", data={"logical_path": "../x"})), ("R13", lambda e: change(e, "FILE_PRESENTATION_CHANGED", data={"reason": None})),
    ("R14", lambda e: change(e, "FILE_RELATIONSHIP_ADDED", data={"child_file_id": "FILE-9"})), ("R15", lambda e: change(e, "ARTEFACT_CREATED", data={"case_id": "C2"})), ("R16", lambda e: change(e, "NOTE_REVISED", data={"revision": 3})),
    ("R17", lambda e: change(e, "NOTE_DISCLOSURE_CHANGED", actor=2)), ("R18", lambda e: [*e[:19], e[18], *e[19:]]), ("R19", lambda e: change(e, "CONFIDENTIAL_ACCESS_REVOKED", data={"authority_basis": "project-owner"})),
    ("R20", lambda e: change(e, "CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED", data={"scope": []})), ("R21", lambda e: change(e, "CONFIDENTIAL_AUTHORITY_TRANSFER_ACCEPTED", actor=1)),
    ("R22", lambda e: [*e, ("CONFIDENTIAL_AUTHORITY_TRANSFER_REJECTED", "transfer", "CT1", 2, {})]), ("R23", lambda e: [*e, ("EXPORT_FAILED", "export", "E1", 1, {})]), ("R24", lambda e: change(e, "EXPORT_STARTED", data={"output_format": "zip"})),
]


@pytest.mark.parametrize("rule, tamper", CASES)
def test_broken_rules_are_found(spark, rule, tamper):
    found = A.audit(frame(spark, tamper(clean())), rule).collect()
    assert found and all(r["rule"] == rule and r["target"] == "P" for r in found)


@pytest.fixture(scope="module")
def state(spark):
    ledger = frame(spark, clean()).cache()
    return ledger, {n: R.project(ledger, p).cache() for n, p in R.projections().items()}


def names(df):
    return {(r["target"], r["rule"], r["key"]) for r in df.collect()}


def test_state_verifiers(spark, state):
    ledger, live = state
    assert names(V.verify_state(ledger, live)) == set()
    changed = live["files"].withColumn("content_digest", F.when(F.col("file_id") == "FILE-2", "x").otherwise(F.col("content_digest")))
    assert [(r["rule"], r["column"], r["expected"], r["actual"]) for r in V.verify_state(ledger, {"files": changed}).collect()] == [("changed", "content_digest", "d2", "x")]
    assert names(V.verify_state(ledger, {"exports": live["exports"].limit(0)})) == {("exports", "missing", "P/E1")}
    payloads = spark.createDataFrame([("s/1", "d1", 1, False), ("s/2", "x", 3, True)], "storage_path string, content_digest string, size_bytes bigint, writable boolean")
    none = spark.createDataFrame([], "storage_path string")
    assert names(V.verify_files(ledger, live["files"], payloads, none)) == {("files", r, "FILE-2") for r in ("payload-digest", "payload-size", "writable-payload")}
    assert names(V.verify_files(ledger, live["files"], payloads.limit(0), none, live["files"].limit(1).select("file_id")))
    assert names(V.verify_notes(ledger, live["notes"], live["note_revisions"], live["files"])) == set()
    other = live["files"].withColumn("classification", F.when(F.col("file_id") == "FILE-1", "note-revision").otherwise(F.col("classification"))).withColumn("content_digest", F.when(F.col("file_id") == "FILE-2", "x").otherwise(F.col("content_digest")))
    assert names(V.verify_notes(ledger, live["notes"], live["note_revisions"], other)) == {("note_revisions", "revision-class", "N1/1"), ("note_revisions", "revision-digest", "N1/2")}
    rebuilt = {n: f(ledger) for n, (f, _) in V.REBUILT.items()}
    assert names(V.verify_state(ledger, rebuilt)) == set()
    assert names(V.verify_state(ledger, {"ownership": rebuilt["ownership"].withColumn("owner_id", F.lit("OP-3"))})) == {("ownership", "changed", "P/project/P"), ("ownership", "changed", "P/case/CASE-000001")}
    assert ("notes", "latest-pointer", "N1") in names(V.verify_notes(ledger, live["notes"].withColumn("latest_revision", F.lit("3")), live["note_revisions"], live["files"]))
    assert names(V.verify_acquisitions(ledger, live["files"])) == set()
    assert names(V.verify_acquisitions(ledger, live["files"].filter("file_id = 'FILE-1'"))) == {("P", "membership", "A1")}


def test_event_verifiers(spark, state):
    ledger, live = state
    assert names(V.verify_envelopes(ledger)) == set()
    assert names(V.verify_envelopes(ledger.withColumn("object_id", F.when(F.col("event_sequence") == 3, "x").otherwise(F.col("object_id"))))) == {("P", "envelope", "3")}
    assert names(V.verify_signers(ledger, live["operator_keys"])) == set()
    assert {k for _, _, k in names(V.verify_signers(ledger, live["operator_keys"].filter("operator_id = 'OP-1'")))} == {"3", "10", "14", "22"}
    assert names(V.verify_order(ledger, ["NOTE_CREATED"], ["NOTE_REVISED"])) == set()
    assert names(V.verify_order(ledger.filter("event_type <> 'NOTE_CREATED'"), ["NOTE_CREATED"], ["NOTE_REVISED"])) == {("P", "precedes-creation", "N1")}
    assert names(V.verify_policy_history(ledger)) == set()
    bad = frame(spark, change(clean(), "EXPORT_POLICY_CHANGED", data={"previous": POLICY | {"broad_scope_export": "members"}}))
    assert names(V.verify_policy_history(bad)) == {("P", "policy-history", "15")}
    assert names(V.verify_transfer_source(ledger)) == set()
    assert names(V.verify_transfer_source(frame(spark, change(clean(), "CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED", data={"from_operator_id": "OP-7"})))) == {("P", "transfer-source", "N1")}


def test_scopes(spark, state):
    ledger, live = state
    held = {"files": live["files"], "artefact_files": R.artefact_files(ledger), "note_revisions": live["note_revisions"], "export_items": R.export_items(ledger), "file_relationships": live["file_relationships"]}
    targets = spark.createDataFrame([("project", "P"), ("case", "CASE-000001"), ("acquisition", "A1"), ("artefact", "ART-1"), ("note", "N1"), ("export", "E1"), ("file", "FILE-2"), ("file", "FILE-9"), ("box", "B")], "scope_type string, scope_id string")
    found, missing = Q.resolve_scopes(targets, held)
    got = {}
    for r in found.collect():
        got.setdefault(r["scope_type"], set()).add(r["file_id"])
    both = {"FILE-1", "FILE-2"}
    assert got == {"project": both, "case": both, "acquisition": both, "artefact": both, "note": both, "export": {"FILE-1"}, "file": {"FILE-2"}}
    assert names(missing) == {("file", "empty-scope", "FILE-9"), ("box", "unknown-scope", "B")}
    asked = spark.createDataFrame([("r1", ["ART-1", "FILE-2"]), ("r2", ["what"])], "request_id string, ids array<string>")
    rows, found = Q.expand_selection(asked, held)
    assert {tuple(r) for r in rows.collect()} == {("r1", "FILE-1"), ("r1", "FILE-2")} and names(found) == {("r2", "unsupported-id", "what")}
    revisions = spark.createDataFrame([("N1", 0), ("N1", 1)], "note_id string, revision int")
    notes = live["notes"].withColumn("latest_revision", F.col("latest_revision").cast("int"))
    assert {r["file_id"] for r in Q.note_revision(notes, live["note_revisions"].withColumn("revision", F.col("revision").cast("int")), revisions).collect()} == both
    assert Q.apply_view(live["files"], "presented").count() == 1


def test_reviews_and_packages(spark):
    layers = spark.createDataFrame([("0" * 64, 10, 10, "redaction", "a", "box", "why", {"x": 0.1, "y": 0.2, "width": 0.3, "height": 0.4}), ("0" * 64, 10, 0, "redaction", "b", "box", " ", {"x": 0.8, "y": 0.8, "width": 0.3, "height": 0.1}), ("zz", 1, 1, "annotation", "c", "point", None, {"x": 0.5, "y": 1.5}), ("1" * 64, 1, 1, "annotation", "d", "marker", None, {"x": 0.5, "y": 0.5})], "original_sha256 string, original_width int, original_height int, layer string, id string, kind string, reason string, geometry map<string,double>")
    assert names(V.verify_reviews(layers)) == {("0" * 64, "review-dimensions", "b"), ("0" * 64, "review-geometry", "b"), ("0" * 64, "review-reason", "b"), ("zz", "review-digest", "c"), ("zz", "review-geometry", "c"), ("zz", "review-kind", "c")}
    manifest = spark.createDataFrame([("a", "1"), ("../b", "2"), ("c", "3")], "path string, content_digest string")
    observed = spark.createDataFrame([("a", "1"), ("../b", "2"), ("d", "4")], "path string, content_digest string")
    assert names(V.verify_package(manifest, observed)) == {("package", "unsafe-path", "../b"), ("package", "missing", "c"), ("package", "extra", "d")}
    kinds = spark.createDataFrame([("a", "1", "file"), ("c", "3", "symlink"), ("d", None, "directory"), ("e", None, "fifo"), ("/x", None, "hardlink"), ("f", None, None)], "path string, content_digest string, kind string")
    assert names(V.verify_package(manifest.filter("path <> '../b'"), kinds)) == {("package", "unexpected-link", "c"), ("package", "missing", "c"), ("package", "special-member", "e"), ("package", "special-member", "f"), ("package", "unexpected-link", "/x"), ("package", "unsafe-member", "/x")}


def test_access_rules_share_a_pass(spark):
    """Grants and revocations are laid in order once for both rules, and what is found is what each finds alone."""
    said = lambda **d: json.dumps({"authority_transaction": {"data": {"operator_id": "o", "authority_basis": "explicit-grant", "reason": "r"} | d}})
    given, taken = "CONFIDENTIAL_ACCESS_GRANTED", "CONFIDENTIAL_ACCESS_REVOKED"
    rows = [("P", 1, given, "file", "f", said()), ("P", 2, given, "file", "f", said()), ("P", 3, taken, "file", "f", said()), ("P", 4, taken, "file", "f", said()), ("P", 5, given, "box", "f", said()), ("P", 6, given, "file", "g", said(reason=" ")), ("P", 7, taken, "file", "g", said(authority_basis=None))]
    ledger = spark.createDataFrame(rows, "project_id string, event_sequence bigint, event_type string, object_type string, object_id string, details_json string")
    both = A.audit(ledger, "R18", "R19")
    found = {(r["rule"], r["key"]) for r in both.collect()}
    assert found == {("R18", "2"), ("R19", "4"), ("R18", "5"), ("R18", "6"), ("R19", "7")}
    assert found == {(r["rule"], r["key"]) for one in ("R18", "R19") for r in A.audit(ledger, one).collect()}
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("try_parse_json") + plan.count("parse_json") <= 2
