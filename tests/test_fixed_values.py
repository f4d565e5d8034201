"""What the columns of a ledger may hold, and what they may not."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import hashing as H
from ledgerloom.functions import text as X
from ledgerloom.operators import audit as A
from ledgerloom.operators import decisions as D
from ledgerloom.operators import verify as V
from ledgerloom.sources import ledger as L

WANTED = {
    "identifiers.state": {"active", "retired", "failed"}, "audit_events.actor_kind": {"system", "operator"}, "operators.state": {"active", "retired"}, "operator_keys.state": {"active", "retired", "revoked"},
    "project_memberships.membership_role": {"owner", "contributor"}, "project_memberships.state": {"pending", "active", "rejected", "removed"},
    "ownership.scope_type": {"project", "case"}, "ownership_transfers.scope_type": {"project", "case"}, "ownership_transfers.state": {"pending", "accepted", "rejected", "cancelled"},
    "record_authority.scope_type": {"project", "case"}, "record_authority.status": {"pending", "approved", "rejected"},
    "files.presentation_state": {"presented", "retracted", "superseded"}, "artefacts.presentation_state": {"presented", "retracted", "superseded"},
    "notes.visibility": {"project", "confidential"}, "notes.package_disclosure": {"withheld", "include"}, "note_revisions.revision_type": {"content", "cryptographic"},
    "export_policy.ordinary_export": {"owner", "members"}, "export_policy.ciphertext_export": {"owner", "members"}, "export_policy.confidential_plaintext_export": {"owner", "authority"}, "export_policy.broad_scope_export": {"owner", "members"},
    "confidential_authority.object_type": {"file", "note", "artefact"}, "access_grants.object_type": {"file", "note", "artefact"},
    "access_grants.authority_basis": {"object-owner", "explicit-grant", "project-owner", "case-role", "recovery-authority", "system-policy"}, "confidential_authority_transfers.state": {"pending", "accepted", "rejected", "cancelled"},
    "exports.scope_type": {"file", "artefact", "acquisition", "case", "project", "selection"}, "exports.view_mode": {"full", "presented"}, "exports.representation": {"native"}, "exports.output_format": {"directory", "tar"},
    "exports.state": {"preparing", "completed", "failed", "cancelled"}, "export_items.mode": {"native", "derived"},
    "annotations.kind": {"rectangle", "ellipse", "arrow", "line", "freehand", "marker", "text", "highlight"},
    "acquired_files.role": {"primary", "supporting", "metadata", "transcript", "derived", "annotation", "redaction_request", "preview", "source_metadata", "network", "inspection"},
}


def test_enums(spark):
    assert {k: set(v) for k, v in X.ENUMS.items()} == WANTED
    pool = sorted(set().union(*WANTED.values()) | {"exact", "withhold", "removed ", ""}) + [None]
    rows = spark.createDataFrame([(v,) for v in pool], "v string").select("v", *[X.enum_rule(k, "v").alias(k.replace(".", "_")) for k in WANTED]).collect()
    for r in rows:
        for k, held in WANTED.items():
            assert r[k.replace(".", "_")] == (r["v"] in held), (k, r["v"])


def test_identifiers_of_all_namespaces(spark):
    named = {"CASE-1": "case", "ACQ-1": "acquisition", "NOTE-1": "note", "FILE-1": "file", "ART-1": "artefact", "EXPORT-000001": "export", "TRANSFER-000001": "authority_transfer", "EXP-1": None, "OP-1": None, "REL-1": None, None: None}
    got = spark.createDataFrame([(k,) for k in named], "i string").select("i", X.id_type("i").alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == named


def test_hash_profiles():
    assert H.WIDTHS == {"sha256": 64, "sha512": 128, "sha3-256": 64, "sha3-512": 128, "blake2b-256": 64, "blake2b-512": 128, "blake2s-256": 64, "blake3-256": 64}
    for name in ("blake2b", "md5", "sha3-384"):
        with pytest.raises(ValueError):
            H.digest("x", name)


def ledger(spark, rows):
    full = [("P", n, kind, otype, oid, "operator", "A", json.dumps(data)) for n, (kind, otype, oid, data) in enumerate(rows, 1)]
    return spark.createDataFrame(full, "project_id string, event_sequence long, event_type string, object_type string, object_id string, actor_kind string, actor_id string, details_json string")


def broken(spark, rule, rows):
    return {int(r["key"]) for r in A.audit(ledger(spark, rows), rule).collect()}


def test_namespaces_have_their_own_prefix(spark):
    rows = [("case", "CASE-000001", 1), ("case", "XX-000002", 2), ("export", "EXPORT-000001", 1), ("export", "EXP-000002", 2), ("authority_transfer", "TRANSFER-1234567", 1234567), ("operator", "OP-000001", 1), ("note", "NOTE-1", 1), (None, "FILE-000001", 1)]
    assert broken(spark, "R1", [("IDENTIFIER_ISSUED", "identifier", i, {"namespace": s, "sequence": n}) for s, i, n in rows]) == {2, 4, 6, 7, 8}


def test_presentation_states(spark):
    states = ["presented", "retracted", "superseded", "withheld", "gone", None]
    assert broken(spark, "R13", [("FILE_PRESENTATION_CHANGED", "file", "F", {"to": s, "reason": "r"}) for s in states]) == {4, 5, 6}


def test_withheld_notes_are_held_back(spark):
    notes = spark.createDataFrame([("N1", "withheld"), ("N2", "include"), ("N3", "withhold"), ("N4", None)], "note_id string, package_disclosure string")
    revisions = spark.createDataFrame([(f"N{i}", 1, f"F{i}") for i in (1, 2, 3, 4)], "note_id string, revision int, file_id string")
    assert [r["file_id"] for r in D.withheld_payloads(notes, revisions, revisions.select("file_id")).collect()] == ["F1"]


def test_export_modes(spark):
    items = [("E", "p1", "F", "s", "s", "native"), ("E", "p2", "F", "s", "t", "derived"), ("D", "p", "F", "s", "s", "derived"), ("C", "p", "F", "s", "t", "native"), ("B", "p", "F", "s", "s", "exact"), ("A", "p", "F", None, "t", "native")]
    items = spark.createDataFrame(items, "export_id string, output_path string, file_id string, source_digest string, output_digest string, mode string")
    seen = items.select("export_id", "output_path", F.col("output_digest").alias("content_digest"))
    history = spark.createDataFrame([("P", 1, "h")], "project_id string, event_sequence long, event_hash string")
    heads = items.select("export_id").distinct().select("export_id", F.lit("P").alias("project_id"), F.lit(1).alias("event_count"), F.lit("h").alias("chain_head"))
    found = {(r["key"], r["rule"]) for r in V.verify_exports(heads, items, items, seen, history).collect()}
    assert found == {("D", "derived-but-equal"), ("C", "native-but-changed"), ("A", "native-but-changed"), ("B", "unknown-mode")}


def test_review_layers_of_real_files(spark, tmp_path):
    layer = {
        "original_sha256": "ab" * 32, "original_width": 640, "original_height": 480, "created_utc": "2024-01-01T00:00:00Z", "schema": "image-review/v1",
        "annotations": [{"annotation_id": "a1", "kind": "rectangle", "geometry": {"x": 0.1, "y": 0.1, "width": 0.2, "height": 0.2}, "note": "n", "label": None}, {"annotation_id": "a2", "kind": "freehand", "geometry": {"points": [{"x": 0.1, "y": 2}], "x": 0.5, "y": 0.5}, "note": None, "label": "l"}, {"annotation_id": "a3", "kind": "blob", "geometry": {"x": 0.1, "y": 0.1}}],
        "proposed_redactions": [{"redaction_id": "r1", "box": {"x": 0.9, "y": 0.1, "width": 0.2, "height": 0.2}, "reason": "face", "category": "person"}, {"redaction_id": "r2", "box": {"x": 0.1, "y": 0.1, "width": 0.2, "height": 0.2}, "reason": " "}],
    }
    (tmp_path / "a.json").write_text(json.dumps(layer, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(layer | {"schema": "other/v1"}))
    rows, strange = L.read_review_layers(spark, str(tmp_path), "image-review/v1")
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {"a1", "a2", "a3", "r1", "r2"} and strange.count() == 1
    assert {(r["original_sha256"], r["original_width"], r["original_height"]) for r in got.values()} == {("ab" * 32, 640, 480)}
    assert got["a1"]["geometry"] == {"x": 0.1, "y": 0.1, "width": 0.2, "height": 0.2} and json.loads(got["a2"]["geometry_json"])["points"] == [{"x": 0.1, "y": 2}]
    assert (got["r1"]["category"], got["r2"]["reason"], got["a2"]["label"]) == ("person", " ", "l")
    assert {(r["rule"], r["key"]) for r in V.verify_reviews(rows).collect()} == {("review-geometry", "r1"), ("review-reason", "r2"), ("review-kind", "a3")}


def test_policy_history_starts_with_the_first_event(spark):
    """A change with the number of the first event comes after it, in whatever order they are read."""
    policy = lambda v: {f: v for f in ("ordinary_export", "ciphertext_export", "confidential_plaintext_export", "broad_scope_export")}
    said = lambda **data: json.dumps({"authority_transaction": {"data": data}})
    first, second, third = ("P", 1, "PROJECT_GENESIS", said(export_policy=policy("a"))), ("P", 1, "EXPORT_POLICY_CHANGED", said(policy=policy("b"), previous=policy("a"))), ("P", 2, "EXPORT_POLICY_CHANGED", said(policy=policy("c"), previous=policy("b")))
    shape = "project_id string, event_sequence bigint, event_type string, details_json string"
    for rows in ([first, second, third], [third, second, first]):
        assert V.verify_policy_history(spark.createDataFrame(rows, shape).coalesce(1)).collect() == []
