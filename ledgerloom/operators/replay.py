"""State from history: tables rebuilt from a ledger by the last event that set each column.

A projection says which events write a key's row and which columns each of them sets. The whole table is one filter and
one aggregation: for each key and column the value of the greatest sequence among the events that set it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import tasks

SEQ = "event_sequence"


def data(path: str) -> Column:
    """A value of the event's details, where the event is not signed."""
    return F.get_json_object("details_json", f"$.{path}")


def signed(path: str) -> Column:
    """A value of the data of the signed transaction in the event's details."""
    return F.get_json_object("details_json", f"$.authority_transaction.data.{path}")


def parsed(ledger: DataFrame) -> DataFrame:
    """ledger with _details, its details parsed once for all the values that are taken from them; null for what is no JSON."""
    return ledger.withColumn("_details", F.try_parse_json("details_json"))


def once(path: str) -> Column:
    """data(path), of details that `parsed` has parsed."""
    return F.try_variant_get("_details", f"$.{path}", "string")


def once_signed(path: str) -> Column:
    return once(f"authority_transaction.data.{path}")


@dataclass(frozen=True)
class Projection:
    """key: the row's key, as columns over an event. sets: for each event type, the columns that it sets. creates: the
    event types that make a row; keys with none of them are left out."""

    key: dict[str, Column]
    sets: dict[str, dict[str, Column]]
    creates: tuple[str, ...] = field(default=())

    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for own in self.sets.values() for c in own))


def project(ledger: DataFrame, p: Projection, by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """The rows of a projection: by, key and all columns that its events set; null where none did."""
    rows = parsed(ledger.filter(F.col("event_type").isin(*p.sets)))
    value = lambda c: reduce(lambda out, t: F.when(F.col("event_type") == t, p.sets[t][c].cast("string")).otherwise(out), [t for t in p.sets if c in p.sets[t]], F.lit(None).cast("string"))
    rows = rows.select(*by, *[e.alias(k) for k, e in p.key.items()], SEQ, "event_type", *[value(c).alias(f"_v_{c}") for c in p.columns()])
    # Columns that the same events set have their last values from one event. Rows are dealt as they are: there are seldom
    # many of a key, so that putting them together before would be a sort more.
    groups: dict[tuple[str, ...], list[str]] = {}
    for c in p.columns():
        groups.setdefault(tuple(t for t in p.sets if c in p.sets[t]), []).append(c)
    last = [F.max_by(F.struct(*[f"_v_{c}" for c in own]), F.when(F.col("event_type").isin(*types), F.col(SEQ))).alias(f"_last_{i}") for i, (types, own) in enumerate(groups.items())]
    made = F.max(F.col("event_type").isin(*(p.creates or tuple(p.sets)))).alias("_made")
    out = rows.repartition(tasks(ledger.sparkSession), *by, *p.key).groupBy(*by, *p.key).agg(*last, made).filter("_made")
    at = {c: f"_last_{i}._v_{c}" for i, own in enumerate(groups.values()) for c in own}
    return out.select(*by, *p.key, *[F.col(at[c]).alias(c) for c in p.columns()])


def decision(states: dict[str, str], at: str = "resolved_sequence") -> dict[str, dict[str, Column]]:
    return {t: {"state": F.lit(s), at: F.col(SEQ)} for t, s in states.items()}


def projections() -> dict[str, Projection]:
    """The projections of a ledger whose rows depend on their own key's events alone. Their columns are over `parsed` events."""
    data, signed = once, once_signed
    seq, obj, actor = F.col(SEQ), F.col("object_id"), F.col("actor_id")
    null, identity = F.lit(None), lambda f: signed(f"identity.{f}")
    operator = {
        "operator_ref": signed("operator_ref"), "operator_uuid": signed("operator_uuid"), "name": identity("name"), "public_contact": identity("public_contact"),
        "organisation": identity("organisation"), "role_label": identity("role"), "state": F.lit("active"), "created_sequence": seq,
    }
    key = {
        "primary_fingerprint": identity("operator_key_fingerprint"), "public_key": signed("public_key"), "state": F.lit("active"),
        "valid_from_sequence": seq, "valid_until_sequence": null,
    }
    invited = F.when(F.col("event_type").isin("CONTRIBUTOR_ACCEPTED", "CONTRIBUTOR_REJECTED"), actor).when(F.col("event_type") == "CONTRIBUTOR_REMOVED", obj).otherwise(identity("operator_id"))
    proposal = {"from_operator_id": signed("from_operator_id"), "to_operator_id": signed("to_operator_id"), "state": F.lit("pending"), "reason": signed("reason"), "proposed_sequence": seq, "resolved_sequence": null}
    approved = data("authority_transaction.data.status") == "approved"
    revision = {"latest_revision": signed("revision")}
    grant_seq = F.when(F.col("event_type") == "CONFIDENTIAL_ACCESS_GRANTED", seq).otherwise(signed("granted_sequence").cast("long"))
    note = {c: signed(c) for c in ("visibility", "author_id", "case_id", "subject_file_id", "package_disclosure")}
    policy = lambda root: {c: signed(f"{root}.{c}") for c in ("ordinary_export", "ciphertext_export", "confidential_plaintext_export", "broad_scope_export")} | {"updated_sequence": seq}
    one_revision = {"file_id": signed("file_id"), "revision_type": signed("revision_type"), "created_sequence": seq, "revised_by": actor, "reason": signed("reason")}
    return {
        "identifiers": Projection(
            {"identifier": obj},
            {"IDENTIFIER_ISSUED": {"namespace": data("namespace"), "sequence": data("sequence"), "state": F.lit("active")}, "IDENTIFIER_RETIRED": {"state": F.lit("retired")}, "IDENTIFIER_FAILED": {"state": F.lit("failed")}},
            ("IDENTIFIER_ISSUED",),
        ),
        "operators": Projection({"operator_id": identity("operator_id")}, {"PROJECT_GENESIS": operator, "CONTRIBUTOR_INVITED": operator}),
        "operator_keys": Projection({"operator_id": identity("operator_id"), "signing_fingerprint": identity("operator_signing_subkey_fingerprint")}, {"PROJECT_GENESIS": key, "CONTRIBUTOR_INVITED": key}),
        "project_memberships": Projection(
            {"operator_id": invited},
            {
                "PROJECT_GENESIS": {"membership_role": F.lit("owner"), "state": F.lit("active"), "added_sequence": seq, "resolved_sequence": seq},
                "CONTRIBUTOR_INVITED": {"membership_role": F.lit("contributor"), "state": F.lit("pending"), "added_sequence": seq, "resolved_sequence": null},
            }
            | decision({"CONTRIBUTOR_ACCEPTED": "active", "CONTRIBUTOR_REJECTED": "rejected", "CONTRIBUTOR_REMOVED": "removed"}),
            ("PROJECT_GENESIS", "CONTRIBUTOR_INVITED"),
        ),
        "ownership_transfers": Projection(
            {"transfer_id": signed("transfer_id")},
            {"OWNERSHIP_TRANSFER_PROPOSED": proposal | {"scope_type": F.col("object_type"), "scope_id": obj}}
            | decision({f"OWNERSHIP_TRANSFER_{s.upper()}": s for s in ("accepted", "rejected", "cancelled")}),
            ("OWNERSHIP_TRANSFER_PROPOSED",),
        ),
        "record_authority": Projection(
            {"object_type": F.when(F.col("event_type") == "ACQUISITION_RECORDED", "acquisition").otherwise(F.col("object_type")), "object_id": obj},
            {
                "ACQUISITION_RECORDED": {
                    "scope_id": signed("case_id"), "submitted_by": actor, "status": signed("status"), "submitted_sequence": seq,
                    "decided_by": F.when(approved, actor), "decision_sequence": F.when(approved, seq), "decision_reason": null,
                },
                **{t: {"status": F.lit(s), "decided_by": actor, "decision_sequence": seq, "decision_reason": signed("reason")} for t, s in (("RECORD_APPROVED", "approved"), ("RECORD_REJECTED", "rejected"))},
            },
            ("ACQUISITION_RECORDED",),
        ),
        "notes": Projection(
            {"note_id": obj},
            {"NOTE_CREATED": note | revision | {"created_sequence": seq}, "NOTE_REVISED": revision, "NOTE_REENCRYPTED": revision, "NOTE_DISCLOSURE_CHANGED": {"package_disclosure": signed("package_disclosure")}},
            ("NOTE_CREATED",),
        ),
        "note_revisions": Projection({"note_id": obj, "revision": signed("revision")}, {t: one_revision for t in ("NOTE_CREATED", "NOTE_REVISED", "NOTE_REENCRYPTED")}),
        "files": Projection(
            {"file_id": obj},
            {
                "FILE_COMMITTED": {c: data(c) for c in ("case_id", "acquisition_id", "logical_path", "classification", "media_type", "content_digest", "size_bytes", "storage_path")}
                | {"actor_id": actor, "committed_sequence": seq, "presentation_state": F.lit("presented")},
                "FILE_PRESENTATION_CHANGED": {"presentation_state": data("to")},
            },
            ("FILE_COMMITTED",),
        ),
        "file_relationships": Projection({"parent_file_id": data("parent_file_id"), "child_file_id": data("child_file_id"), "relationship": data("relationship")}, {"FILE_RELATIONSHIP_ADDED": {"created_sequence": seq}}),
        "artefacts": Projection({"artefact_id": obj}, {"ARTEFACT_CREATED": {c: data(c) for c in ("case_id", "acquisition_id", "role", "description")} | {"created_sequence": seq, "presentation_state": F.lit("presented")}}),
        "export_policy": Projection({"policy_id": F.lit("project")}, {"PROJECT_GENESIS": policy("export_policy"), "EXPORT_POLICY_CHANGED": policy("policy")}, ("PROJECT_GENESIS",)),
        "confidential_transfers": Projection(
            {"transfer_id": obj},
            {"CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED": proposal | {"scope_json": F.get_json_object("details_json", "$.authority_transaction.data.scope")}}
            | decision({f"CONFIDENTIAL_AUTHORITY_TRANSFER_{s.upper()}": s for s in ("accepted", "rejected", "cancelled")}),
            ("CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED",),
        ),
        "access_grants": Projection(
            {"operator_id": signed("operator_id"), "object_type": F.col("object_type"), "object_id": obj, "authority_basis": signed("authority_basis"), "granted_sequence": grant_seq},
            {"CONFIDENTIAL_ACCESS_GRANTED": {"grant_reason": signed("reason")}, "CONFIDENTIAL_ACCESS_REVOKED": {"revoked_sequence": seq, "revoke_reason": signed("reason")}},
            ("CONFIDENTIAL_ACCESS_GRANTED",),
        ),
        "exports": Projection(
            {"export_id": obj},
            {
                "EXPORT_STARTED": {c: signed(c) for c in ("scope_type", "scope_id", "view_mode", "representation", "output_format", "policy_sequence")}
                | {"actor_id": data("authority_transaction.actor_id"), "state": F.lit("preparing"), "created_sequence": seq},
                "EXPORT_COMPLETED": {"manifest_digest": signed("manifest_digest"), "output_digest": signed("output_digest"), "state": F.lit("completed"), "completed_sequence": seq},
                "EXPORT_FAILED": {"state": F.lit("failed"), "completed_sequence": seq},
            },
            ("EXPORT_STARTED",),
        ),
    }


def members_of(ledger: DataFrame, event_type: str, array_path: str, schema: str, owner: str) -> DataFrame:
    """(project_id, owner, position, member, created_sequence): the items of an array in each event's details."""
    items = F.from_json(F.get_json_object("details_json", f"$.{array_path}"), schema)
    rows = ledger.filter(F.col("event_type") == event_type).select("project_id", F.col("object_id").alias(owner), F.col(SEQ).alias("created_sequence"), F.posexplode(items).alias("position", "member"))
    return rows.select("project_id", owner, "position", "member", "created_sequence")


def artefact_files(ledger: DataFrame) -> DataFrame:
    rows = members_of(ledger, "ARTEFACT_CREATED", "file_ids", "array<string>", "artefact_id")
    return rows.select("project_id", "artefact_id", F.col("member").alias("file_id"), F.lit("primary").alias("member_role"), "created_sequence")


def acquisition_files(ledger: DataFrame) -> DataFrame:
    return members_of(ledger, "ACQUISITION_RECORDED", "authority_transaction.data.file_ids", "array<string>", "acquisition_id").withColumnRenamed("member", "file_id")


def export_items(ledger: DataFrame) -> DataFrame:
    fields = ["file_id", "output_path", "source_digest", "output_digest", "mode"]
    rows = members_of(ledger, "EXPORT_COMPLETED", "authority_transaction.data.items", "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>", "export_id")
    return rows.select("project_id", "export_id", *[f"member.{f}" for f in fields])


def ownership(ledger: DataFrame) -> DataFrame:
    """(project_id, scope_type, scope_id, owner_id, effective_from_sequence): the last assignment or accepted transfer of each scope.

    A transfer's new owner is named by its proposal, which is joined to its acceptance.
    """
    seq = F.col(SEQ).alias("effective_from_sequence")
    first = ledger.filter("event_type = 'PROJECT_GENESIS'").select("project_id", F.lit("project").alias("scope_type"), F.col("object_id").alias("scope_id"), signed("identity.operator_id").alias("owner_id"), seq)
    case = ledger.filter("event_type = 'CASE_OWNERSHIP_ASSIGNED'").select("project_id", F.lit("case").alias("scope_type"), F.col("object_id").alias("scope_id"), signed("owner_id").alias("owner_id"), seq)
    proposed = ledger.filter("event_type = 'OWNERSHIP_TRANSFER_PROPOSED'").select("project_id", signed("transfer_id").alias("t"), F.col("object_type").alias("scope_type"), F.col("object_id").alias("scope_id"), signed("to_operator_id").alias("owner_id"))
    accepted = ledger.filter("event_type = 'OWNERSHIP_TRANSFER_ACCEPTED'").select("project_id", signed("transfer_id").alias("t"), seq)
    moved = proposed.join(accepted, ["project_id", "t"]).drop("t")
    rows = first.unionByName(case).unionByName(moved)
    return rows.groupBy("project_id", "scope_type", "scope_id").agg(F.max_by("owner_id", "effective_from_sequence").alias("owner_id"), F.max("effective_from_sequence").alias("effective_from_sequence"))


def memberships(ledger: DataFrame) -> DataFrame:
    """The memberships with their roles after accepted transfers of the project: the new owner is `owner`, the old one `contributor`."""
    proposed = ledger.filter("event_type = 'OWNERSHIP_TRANSFER_PROPOSED' and object_type = 'project'").select("project_id", signed("transfer_id").alias("t"), signed("from_operator_id").alias("_from"), signed("to_operator_id").alias("_to"))
    accepted = ledger.filter("event_type = 'OWNERSHIP_TRANSFER_ACCEPTED' and object_type = 'project'").select("project_id", signed("transfer_id").alias("t"), F.col(SEQ).alias("_at")).join(proposed, ["project_id", "t"])
    roles = F.array(F.struct(F.col("_from").alias("operator_id"), F.lit("contributor").alias("_role")), F.struct(F.col("_to").alias("operator_id"), F.lit("owner").alias("_role")))
    moved = accepted.select("project_id", "_at", F.explode(roles).alias("x")).select("project_id", "x.operator_id", "_at", "x._role")
    last = moved.groupBy("project_id", "operator_id").agg(F.max_by("_role", "_at").alias("_role"))
    held = project(ledger, projections()["project_memberships"]).join(last, ["project_id", "operator_id"], "left")
    return held.withColumn("membership_role", F.coalesce("_role", "membership_role")).drop("_role")


def confidential_authority(ledger: DataFrame) -> DataFrame:
    """(project_id, object_type, object_id, creator_id, authority_id, effective_sequence) of confidential notes after their accepted transfers."""
    made = ledger.filter("event_type = 'NOTE_CREATED'").filter(signed("visibility") == "confidential")
    first = made.select("project_id", F.lit("note").alias("object_type"), "object_id", signed("author_id").alias("creator_id"), F.coalesce(signed("authority_id"), signed("author_id")).alias("authority_id"), F.col(SEQ).alias("effective_sequence"))
    proposed = ledger.filter("event_type = 'CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED'").select("project_id", F.col("object_id").alias("t"), signed("to_operator_id").alias("authority_id"))
    scope = F.from_json(signed("scope"), "array<struct<object_type:string,object_id:string>>")
    accepted = ledger.filter("event_type = 'CONFIDENTIAL_AUTHORITY_TRANSFER_ACCEPTED'").select("project_id", F.col("object_id").alias("t"), F.col(SEQ).alias("effective_sequence"), F.explode(scope).alias("s"))
    moved = accepted.join(proposed, ["project_id", "t"]).select("project_id", "s.object_type", "s.object_id", F.lit(None).cast("string").alias("creator_id"), "authority_id", "effective_sequence")
    rows = first.unionByName(moved)
    out = rows.groupBy("project_id", "object_type", "object_id").agg(F.max("creator_id").alias("creator_id"), F.max_by("authority_id", "effective_sequence").alias("authority_id"), F.max("effective_sequence").alias("effective_sequence"))
    return out.filter("creator_id is not null")


def counters(ledger: DataFrame) -> DataFrame:
    """(project_id, namespace, next_value) after the identifiers issued."""
    issued = ledger.filter("event_type = 'IDENTIFIER_ISSUED'").select("project_id", data("namespace").alias("namespace"), data("sequence").cast("long").alias("n"))
    return issued.groupBy("project_id", "namespace").agg((F.max("n") + 1).alias("next_value"))
