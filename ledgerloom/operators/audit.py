"""Audit rules: events of a ledger that the state at their time did not allow.

Each rule is a set-based check of all events at once. State as of an event comes from the ledger's own history, by
as-of joins on (project, object) and by the event before it in an object's life.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ENUMS, PREFIXES, format_id, has_reason, is_safe_path
from . import decisions
from . import replay as R
from .findings import finding, row_findings
from .sets import union_all
from .sweeps import SLICE, asof_join

SEQ = "event_sequence"
EDGES = {
    # rule: (key, {event type: event types that may come before it; None where it comes first})
    "R1": ("object_id", {"IDENTIFIER_ISSUED": (None,), "IDENTIFIER_RETIRED": ("IDENTIFIER_ISSUED",), "IDENTIFIER_FAILED": ("IDENTIFIER_ISSUED",)}),
    "R7": ("transfer", {"OWNERSHIP_TRANSFER_PROPOSED": (None,), **{f"OWNERSHIP_TRANSFER_{s}": ("OWNERSHIP_TRANSFER_PROPOSED",) for s in ("ACCEPTED", "REJECTED", "CANCELLED")}}),
    "R10": ("object_id", {"ACQUISITION_RECORDED": (None,), "RECORD_APPROVED": ("ACQUISITION_RECORDED",), "RECORD_REJECTED": ("ACQUISITION_RECORDED",)}),
    "R22": ("object_id", {"CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED": (None,), **{f"CONFIDENTIAL_AUTHORITY_TRANSFER_{s}": ("CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED",) for s in ("ACCEPTED", "REJECTED", "CANCELLED")}}),
    "R23": ("object_id", {"EXPORT_STARTED": (None,), "EXPORT_COMPLETED": ("EXPORT_STARTED",), "EXPORT_FAILED": ("EXPORT_STARTED",)}),
}
VIEWS, FORMATS, PRESENTATION, VISIBILITY = ENUMS["exports.view_mode"], ENUMS["exports.output_format"], ENUMS["files.presentation_state"], ENUMS["notes.visibility"]
GRANT_TYPES, BASES = ENUMS["access_grants.object_type"], ENUMS["access_grants.authority_basis"]


def broken(df: DataFrame, rule: str, where: Column, actual: Column | None = None) -> DataFrame:
    """A finding for each event for which `where` is not surely true."""
    return finding(df.filter(~F.coalesce(where, F.lit(False))), F.col("project_id"), rule, F.col(SEQ), actual=actual if actual is not None else F.col("event_type"))


def of(events: DataFrame, *types: str) -> DataFrame:
    return events.filter(F.col("event_type").isin(*types))


def life_cycle(events: DataFrame, rule: str) -> DataFrame:
    """Events that do not follow the one before in their object's life."""
    key, edges = EDGES[rule]
    rows = of(events, *edges).select("project_id", SEQ, "event_type", (R.signed("transfer_id") if key == "transfer" else F.col(key)).alias("_key"))
    before = F.lag("event_type").over(Window.partitionBy("project_id", "_key").orderBy(SEQ))
    rows = rows.withColumn("_before", before)
    allowed = F.lit(False)
    for kind, previous in edges.items():
        ok = F.col("_before").isNull() if previous == (None,) else F.col("_before").isin(*previous)
        allowed = allowed | ((F.col("event_type") == kind) & F.coalesce(ok, F.lit(False)))
    return broken(rows, rule, allowed, F.col("_before"))


def owners(events: DataFrame) -> DataFrame:
    """(project_id, scope, seq, owner): every change of the owner of a scope."""
    proposed = of(events, "OWNERSHIP_TRANSFER_PROPOSED").select("project_id", R.signed("transfer_id").alias("t"), F.when(F.col("object_type") == "project", "project").otherwise(F.col("object_id")).alias("scope"), R.signed("to_operator_id").alias("owner"))
    moved = of(events, "OWNERSHIP_TRANSFER_ACCEPTED").select("project_id", R.signed("transfer_id").alias("t"), F.col(SEQ).alias("seq")).join(proposed, ["project_id", "t"])
    first = of(events, "PROJECT_GENESIS").select("project_id", F.lit("project").alias("scope"), F.col(SEQ).alias("seq"), R.signed("identity.operator_id").alias("owner"))
    case = of(events, "CASE_OWNERSHIP_ASSIGNED").select("project_id", F.col("object_id").alias("scope"), F.col(SEQ).alias("seq"), R.signed("owner_id").alias("owner"))
    return union_all([first, case, moved.select("project_id", "scope", "seq", "owner")])


def members(events: DataFrame) -> DataFrame:
    """(project_id, member, seq, state): every change of a membership."""
    state = {"PROJECT_GENESIS": "active", "CONTRIBUTOR_INVITED": "pending", "CONTRIBUTOR_ACCEPTED": "active", "CONTRIBUTOR_REJECTED": "rejected", "CONTRIBUTOR_REMOVED": "removed"}
    who = F.when(F.col("event_type").isin("CONTRIBUTOR_ACCEPTED", "CONTRIBUTOR_REJECTED"), F.col("actor_id")).when(F.col("event_type") == "CONTRIBUTOR_REMOVED", F.col("object_id")).otherwise(R.signed("identity.operator_id"))
    name = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in state.items()])
    return of(events, *state).select("project_id", who.alias("member"), F.col(SEQ).alias("seq"), name.alias("state"))


def with_owner(df: DataFrame, events: DataFrame, scope: Column) -> DataFrame:
    """Events with _owner, who owned the scope just before each."""
    rows = df.withColumns({"scope": scope, "_just": F.col(SEQ) - 1})
    return asof_join(rows, owners(events), ["project_id", "scope"], "_just", "seq", ["owner"], width=SLICE).withColumnRenamed("owner", "_owner")


def with_state(df: DataFrame, events: DataFrame, member: Column) -> DataFrame:
    """Events with _state, the membership of someone just before each."""
    rows = df.withColumns({"member": member, "_just": F.col(SEQ) - 1})
    return asof_join(rows, members(events), ["project_id", "member"], "_just", "seq", ["state"], width=SLICE).withColumnRenamed("state", "_state")


PROJECT = "project"


def with_id_state(df: DataFrame, events: DataFrame, namespace: str, identifier: Column) -> DataFrame:
    """Events with _id_ok: the identifier was issued in the namespace and is active just before each. Projects that issue
    no identifiers of the namespace keep them elsewhere: there any will do."""
    state = F.when(F.col("event_type") == "IDENTIFIER_ISSUED", R.data("namespace")).otherwise("closed")
    changes = of(events, *EDGES["R1"][1]).select("project_id", F.col("object_id").alias("identifier"), F.col(SEQ).alias("seq"), state.alias("_now"))
    some = of(events, "IDENTIFIER_ISSUED").filter(R.data("namespace") == namespace).select("project_id").distinct().withColumn("_issues", F.lit(True))
    rows = asof_join(df.withColumns({"identifier": identifier, "_just": F.col(SEQ) - 1}), changes, ["project_id", "identifier"], "_just", "seq", ["_now"], width=SLICE).join(some, "project_id", "left")
    ok = F.col("identifier").isNull() | (F.col("_now").isNull() & F.col("_issues").isNull()) | F.coalesce(F.col("_now") == namespace, F.lit(False))
    return rows.withColumn("_id_ok", ok).drop("identifier", "_just", "_now", "_issues")


def authorities(events: DataFrame) -> DataFrame:
    """(project_id, object, seq, held): every change of the authority over a confidential object."""
    scope = F.from_json(R.signed("scope"), "array<struct<object_type:string,object_id:string>>")
    proposed = of(events, "CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED").select("project_id", F.col("object_id").alias("t"), R.signed("to_operator_id").alias("held"))
    moves = of(events, "CONFIDENTIAL_AUTHORITY_TRANSFER_ACCEPTED").select("project_id", F.col("object_id").alias("t"), F.col(SEQ).alias("seq"), F.explode(scope).alias("s")).join(proposed, ["project_id", "t"])
    made = of(events, "NOTE_CREATED").filter(R.signed("visibility") == "confidential").select("project_id", F.col("object_id").alias("object"), F.col(SEQ).alias("seq"), F.coalesce(R.signed("authority_id"), R.signed("author_id")).alias("held"))
    return made.unionByName(moves.select("project_id", F.col("s.object_id").alias("object"), "seq", "held"))


def r1(events: DataFrame) -> DataFrame:
    """Identifiers are issued once and closed once. Each is of a known namespace: that one's prefix, and its sequence as number."""
    space, named = R.data("namespace"), F.lit(None).cast("string")
    for prefix, namespace in PREFIXES.items():
        named = F.when(space == namespace, format_id(prefix, R.data("sequence"))).otherwise(named)
    return life_cycle(events, "R1").unionByName(broken(of(events, "IDENTIFIER_ISSUED"), "R1", F.col("object_id") == named, F.col("object_id")))


def r2(events: DataFrame) -> DataFrame:
    """The genesis comes once and first."""
    return broken(of(events, "PROJECT_GENESIS"), "R2", F.col(SEQ) == 1)


def r3(events: DataFrame) -> DataFrame:
    """The owner invites, not themselves, and nobody who is known already."""
    rows = with_state(with_owner(of(events, "CONTRIBUTOR_INVITED"), events, F.lit(PROJECT)), events, R.signed("identity.operator_id"))
    return broken(rows, "R3", (F.col("_owner") == F.col("actor_id")) & (F.col("member") != F.col("actor_id")) & F.col("_state").isNull())


def r4(events: DataFrame) -> DataFrame:
    """Only who is invited decides, while it is pending."""
    return broken(with_state(of(events, "CONTRIBUTOR_ACCEPTED", "CONTRIBUTOR_REJECTED"), events, F.col("actor_id")), "R4", F.col("_state") == "pending")


def r5(events: DataFrame) -> DataFrame:
    """The owner removes an active contributor, with a reason."""
    rows = with_state(with_owner(of(events, "CONTRIBUTOR_REMOVED"), events, F.lit(PROJECT)), events, F.col("object_id"))
    return broken(rows, "R5", (F.col("_owner") == F.col("actor_id")) & (F.col("member") != F.col("_owner")) & (F.col("_state") == "active") & has_reason(R.signed("reason")))


def r6(events: DataFrame) -> DataFrame:
    """The owner of a scope proposes its transfer to another active member, with a reason, while none is pending."""
    scope = F.when(F.col("object_type") == "project", PROJECT).otherwise(F.col("object_id"))
    rows = with_state(with_owner(of(events, "OWNERSHIP_TRANSFER_PROPOSED"), events, scope), events, R.signed("to_operator_id"))
    step = F.when(F.col("event_type") == "OWNERSHIP_TRANSFER_PROPOSED", 1).otherwise(-1)
    life = of(events, *EDGES["R7"][1]).withColumn("_open", F.sum(step).over(Window.partitionBy("project_id", "object_type", "object_id").orderBy(SEQ)))
    rows = rows.join(life.select("project_id", SEQ, "_open"), ["project_id", SEQ])
    return broken(rows, "R6", (F.col("_owner") == F.col("actor_id")) & (F.col("member") != F.col("actor_id")) & (F.col("_state") == "active") & has_reason(R.signed("reason")) & (F.col("_open") == 1))


def r7(events: DataFrame) -> DataFrame:
    """A pending transfer is accepted or rejected by its target, cancelled by who proposed it."""
    proposed = of(events, "OWNERSHIP_TRANSFER_PROPOSED").select("project_id", R.signed("transfer_id").alias("_t"), F.col("actor_id").alias("_by"), R.signed("to_operator_id").alias("_to"))
    rows = of(events, *[t for t in EDGES["R7"][1] if not t.endswith("PROPOSED")]).withColumn("_t", R.signed("transfer_id")).join(proposed, ["project_id", "_t"], "left")
    who = F.when(F.col("event_type").endswith("CANCELLED"), F.col("_by")).otherwise(F.col("_to"))
    return life_cycle(events, "R7").unionByName(broken(rows, "R7", who == F.col("actor_id")))


def r8(events: DataFrame) -> DataFrame:
    """The project's owner assigns cases."""
    return broken(with_owner(of(events, "CASE_OWNERSHIP_ASSIGNED"), events, F.lit(PROJECT)), "R8", F.col("_owner") == F.col("actor_id"))


def r9(events: DataFrame) -> DataFrame:
    """An active member submits, under an active identifier, for a case with an owner; it is approved at once if that is
    the owner, else pending; its files are those committed for it before, each once, in their order."""
    recorded = R.parsed(of(events, "ACQUISITION_RECORDED")).select("project_id", SEQ, "event_type", "object_id", "actor_id", *[R.once_signed(c).alias(f"_{c}") for c in ("case_id", "status", "file_ids")])
    recorded = recorded.withColumn("_ids", F.from_json("_file_ids", "array<string>")).withColumn("_size", F.size("_ids")).drop("_file_ids")
    # The lists do not go through the joins for owners and members.
    rows = with_state(with_owner(recorded.drop("_ids"), events, F.col("_case_id")), events, F.col("actor_id"))
    rows = with_id_state(rows, events, "acquisition", F.col("object_id"))
    said = recorded.select("project_id", SEQ, "object_id", F.posexplode_outer("_ids").alias("_place", "_file"))
    own = committed(events).select("project_id", F.col("_acq").alias("object_id"), "_file", "_at")
    both = said.join(own, ["project_id", "object_id", "_file"], "left").withColumn("_rank", F.row_number().over(Window.partitionBy("project_id", SEQ).orderBy("_at", "_place")) - 1)
    good = both.groupBy("project_id", SEQ).agg(F.every((F.col("_at") < F.col(SEQ)) & (F.col("_rank") == F.col("_place"))).alias("_in_order"), F.countDistinct("_file").alias("_said"))
    # As many were said as were committed before: then they are the same.
    before = recorded.select("project_id", SEQ, "object_id").join(own, ["project_id", "object_id"]).filter(F.col("_at") < F.col(SEQ)).groupBy("project_id", SEQ).agg(F.count("*").alias("_own"))
    rows = rows.join(good, ["project_id", SEQ], "left").join(before, ["project_id", SEQ], "left")
    status = F.when(F.col("_owner") == F.col("actor_id"), "approved").otherwise("pending")
    whole = F.col("_in_order") & (F.col("_said") == F.col("_size")) & (F.col("_said") == F.col("_own"))
    return broken(rows, "R9", (F.col("_state") == "active") & F.col("_owner").isNotNull() & (F.col("_status") == status) & F.col("_id_ok") & whole)


def r10(events: DataFrame) -> DataFrame:
    """The case's owner decides what is pending; a rejection has a reason."""
    case = R.parsed(of(events, "ACQUISITION_RECORDED")).select("project_id", "object_id", R.once_signed("case_id").alias("_case"), R.once_signed("status").alias("_status"))
    decided = of(events, "RECORD_APPROVED", "RECORD_REJECTED").select("project_id", SEQ, "event_type", "object_id", "actor_id", R.signed("reason").alias("_reason"))
    rows = with_owner(decided.join(case, ["project_id", "object_id"], "left"), events, F.col("_case"))
    reason = (F.col("event_type") == "RECORD_APPROVED") | has_reason(F.col("_reason"))
    return life_cycle(events, "R10").unionByName(broken(rows, "R10", (F.col("_owner") == F.col("actor_id")) & (F.col("_status") == "pending") & reason))


def r11(events: DataFrame) -> DataFrame:
    """The owner changes known fields of the policy to known values."""
    rows = with_owner(of(events, "EXPORT_POLICY_CHANGED"), events, F.lit(PROJECT))
    known = F.lit(True)
    for name, values in decisions.POLICY_FIELDS.items():
        known = known & R.signed(f"policy.{name}").isin(*values)
    return broken(rows, "R11", (F.col("_owner") == F.col("actor_id")) & known)


def r12(events: DataFrame) -> DataFrame:
    """Files have safe paths, each once in its acquisition, an acquisition only with a case, and these are active."""
    rows = of(events, "FILE_COMMITTED").withColumn("_path", R.data("logical_path"))
    rows = with_id_state(rows, events, "case", R.data("case_id")).withColumnRenamed("_id_ok", "_case_ok")
    rows = with_id_state(rows, events, "acquisition", R.data("acquisition_id"))
    batch = Window.partitionBy("project_id", R.data("acquisition_id"), "_path")
    rows = rows.withColumn("_n", F.when(R.data("acquisition_id").isNotNull(), F.count("*").over(batch)).otherwise(1))
    return broken(rows, "R12", is_safe_path("_path") & (F.col("_n") == 1) & (R.data("acquisition_id").isNull() | R.data("case_id").isNotNull()) & F.col("_case_ok") & F.col("_id_ok"))


def r13(events: DataFrame) -> DataFrame:
    """Presentation changes name a known state and a reason."""
    return broken(of(events, "FILE_PRESENTATION_CHANGED"), "R13", R.data("to").isin(*PRESENTATION) & has_reason(R.data("reason")))


def committed(events: DataFrame) -> DataFrame:
    rows = R.parsed(of(events, "FILE_COMMITTED"))
    return rows.select("project_id", F.col("object_id").alias("_file"), F.col(SEQ).alias("_at"), R.once("case_id").alias("_case"), R.once("acquisition_id").alias("_acq"))


def r14(events: DataFrame) -> DataFrame:
    """Relationships have a label and two different files that were committed before."""
    rows, files = of(events, "FILE_RELATIONSHIP_ADDED"), committed(events)
    for end in ("parent", "child"):
        known = files.select("project_id", F.col("_file").alias(f"_{end}"), F.col("_at").alias(f"_{end}_at"))
        rows = rows.withColumn(f"_{end}", R.data(f"{end}_file_id")).join(known, ["project_id", f"_{end}"], "left")
    return broken(rows, "R14", (F.col("_parent") != F.col("_child")) & (F.col("_parent_at") < F.col(SEQ)) & (F.col("_child_at") < F.col(SEQ)) & has_reason(R.data("relationship")))


def r15(events: DataFrame) -> DataFrame:
    """Artefacts hold files of their own case and acquisition."""
    rows = of(events, "ARTEFACT_CREATED").withColumns({"_case_id": R.data("case_id"), "_acq_id": R.data("acquisition_id"), "_ids": F.from_json(R.data("file_ids"), "array<string>")})
    each = rows.select("project_id", SEQ, "event_type", "_case_id", "_acq_id", F.explode_outer("_ids").alias("_file")).join(committed(events), ["project_id", "_file"], "left")
    bad = broken(each, "R15", (F.col("_at") < F.col(SEQ)) & F.col("_case").eqNullSafe(F.col("_case_id")) & F.col("_acq").eqNullSafe(F.col("_acq_id")))
    return bad.distinct()


def r16(events: DataFrame) -> DataFrame:
    """Notes are created by their author with a known visibility, start at revision 1, and those of a case are on no
    file of another case. Each later revision is one more than the last and has a reason; a note that is not
    confidential is revised by its author, a confidential one by its authority or who has access."""
    rows = of(events, "NOTE_CREATED", "NOTE_REVISED", "NOTE_REENCRYPTED").withColumn("_r", R.signed("revision").cast("long"))
    life = Window.partitionBy("project_id", "object_id").orderBy(SEQ)
    rows = rows.withColumns({"_last": F.lag("_r").over(life), "_author": F.first(R.signed("author_id"), True).over(life), "_visibility": F.first(R.signed("visibility"), True).over(life), "_file": R.signed("subject_file_id"), "object": F.col("object_id"), "_just": F.col(SEQ) - 1})
    rows = asof_join(rows, authorities(events), ["project_id", "object"], "_just", "seq", ["held"], width=SLICE).drop("object")
    grants = grant_life(events).filter("object_type = 'note'")
    open_now = F.sum(F.when(F.col("event_type") == "CONFIDENTIAL_ACCESS_GRANTED", 1).otherwise(-1)).over(Window.partitionBy("project_id", "_who", "object_id").orderBy(SEQ))
    opened = grants.select("project_id", F.col("_who").alias("actor_id"), "object_id", F.col(SEQ).alias("seq"), open_now.alias("_open"))
    rows = asof_join(rows, opened, ["project_id", "actor_id", "object_id"], "_just", "seq", ["_open"], width=SLICE)
    rows = rows.join(committed(events).select("project_id", "_file", F.col("_case").alias("_file_case"), F.col("_at").alias("_file_at")), ["project_id", "_file"], "left")
    subject = F.col("_file").isNull() | ((F.col("_file_at") < F.col(SEQ)) & (R.signed("case_id").isNull() | F.col("_file_case").isNull() | (F.col("_file_case") == R.signed("case_id"))))
    new = (F.col("event_type") == "NOTE_CREATED") & R.signed("visibility").isin(*VISIBILITY) & (F.col("_r") == 1) & F.col("_last").isNull() & (F.col("actor_id") == R.signed("author_id")) & subject
    may = F.when(F.col("_visibility") == "confidential", (F.col("held") == F.col("actor_id")) | (F.coalesce("_open", F.lit(0)) > 0)).otherwise(F.col("_author") == F.col("actor_id"))
    # A change of owners re-encrypts notes in the name of the new owner.
    more = (F.col("event_type") != "NOTE_CREATED") & (F.col("_r") == F.col("_last") + 1) & has_reason(R.signed("reason")) & ((F.col("event_type") == "NOTE_REENCRYPTED") | may)
    return broken(rows, "R16", F.coalesce(new, F.lit(False)) | F.coalesce(more, F.lit(False)))


def r17(events: DataFrame) -> DataFrame:
    """The project's owner changes disclosure."""
    return broken(with_owner(of(events, "NOTE_DISCLOSURE_CHANGED"), events, F.lit(PROJECT)), "R17", F.col("_owner") == F.col("actor_id"))


def grant_life(events: DataFrame) -> DataFrame:
    rows = R.parsed(of(events, "CONFIDENTIAL_ACCESS_GRANTED", "CONFIDENTIAL_ACCESS_REVOKED"))
    rows = rows.select("project_id", SEQ, "event_type", "object_type", "object_id", R.once_signed("operator_id").alias("_who"), R.once_signed("authority_basis").alias("_basis"), R.once_signed("reason").alias("_reason"))
    return rows.withColumn("_before", F.lag("event_type").over(Window.partitionBy("project_id", "_who", "object_type", "object_id", "_basis").orderBy(SEQ)))


def access(events: DataFrame) -> DataFrame:
    """R18 and R19 in one pass. Grants are for known objects and bases, have a reason, and are not open already;
    revocations close an open grant of the same basis, with a reason."""
    kind, before, reason = F.col("event_type"), F.col("_before"), has_reason(F.col("_reason"))
    free = before.isNull() | (before == "CONFIDENTIAL_ACCESS_REVOKED")
    given = F.col("object_type").isin(*GRANT_TYPES) & F.col("_basis").isin(*BASES) & reason & free
    checks = [(rule, (kind == f"CONFIDENTIAL_ACCESS_{what}") & ~F.coalesce(ok, F.lit(False)), None, None, kind) for rule, what, ok in (("R18", "GRANTED", given), ("R19", "REVOKED", (before == "CONFIDENTIAL_ACCESS_GRANTED") & reason))]
    return row_findings(grant_life(events), F.col("project_id"), F.col(SEQ), checks)


def r20(events: DataFrame) -> DataFrame:
    """Confidential transfers are proposed by the project's owner, to an active member, with a scope of objects that the
    source controls, while no other one from that source or to that target is pending."""
    rows = with_state(with_owner(of(events, "CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED"), events, F.lit(PROJECT)), events, R.signed("to_operator_id"))
    rows = rows.withColumns({"_source": R.signed("from_operator_id"), "_scope": F.from_json(R.signed("scope"), "array<struct<object_type:string,object_id:string>>")})
    each = rows.select("project_id", SEQ, "_source", (F.col(SEQ) - 1).alias("_just"), F.explode("_scope").alias("s")).select("*", F.col("s.object_id").alias("object")).drop("s")
    held = asof_join(each, authorities(events), ["project_id", "object"], "_just", "seq", ["held"], width=SLICE)
    controls = held.groupBy("project_id", SEQ).agg(F.every(F.col("held").eqNullSafe(F.col("_source"))).alias("_controls"))
    parties = of(events, "CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED").select("project_id", "object_id", R.signed("from_operator_id").alias("_from"), R.signed("to_operator_id").alias("_to"))
    life = of(events, *EDGES["R22"][1]).join(parties, ["project_id", "object_id"])
    step = F.when(F.col("event_type").endswith("PROPOSED"), 1).otherwise(-1)
    pending = [F.sum(step).over(Window.partitionBy("project_id", c).orderBy(SEQ)).alias(f"_open{c}") for c in ("_from", "_to")]
    free = life.select("project_id", SEQ, "event_type", *pending).filter(F.col("event_type").endswith("PROPOSED")).select("project_id", SEQ, ((F.col("_open_from") <= 1) & (F.col("_open_to") <= 1)).alias("_free"))
    rows = rows.join(controls, ["project_id", SEQ], "left").join(free, ["project_id", SEQ], "left")
    return broken(rows, "R20", (F.col("_owner") == F.col("actor_id")) & (F.col("_state") == "active") & (F.size("_scope") > 0) & F.col("_controls") & F.col("_free"))


def transfer_actors(events: DataFrame, rule: str, kinds: tuple[str, ...]) -> DataFrame:
    proposed = of(events, "CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED").select("project_id", "object_id", F.col("actor_id").alias("_by"), R.signed("to_operator_id").alias("_to"), R.signed("scope").alias("_scope"))
    rows = of(events, *[f"CONFIDENTIAL_AUTHORITY_TRANSFER_{k}" for k in kinds]).join(proposed, ["project_id", "object_id"], "left")
    who = F.when(F.col("event_type").endswith("CANCELLED"), F.col("_by")).otherwise(F.col("_to"))
    same = ~F.col("event_type").endswith("ACCEPTED") | R.signed("scope").eqNullSafe(F.col("_scope"))
    return broken(rows, rule, (who == F.col("actor_id")) & same)


def r21(events: DataFrame) -> DataFrame:
    """A confidential transfer is accepted by its target, with the scope that was proposed, of known types of objects."""
    rows = of(events, "CONFIDENTIAL_AUTHORITY_TRANSFER_ACCEPTED").withColumn("_scope", F.from_json(R.signed("scope"), "array<struct<object_type:string,object_id:string>>"))
    known = F.forall("_scope", lambda x: F.coalesce(x["object_type"].isin(*GRANT_TYPES), F.lit(False)))
    return transfer_actors(events, "R21", ("ACCEPTED",)).unionByName(broken(rows, "R21", known))


def r22(events: DataFrame) -> DataFrame:
    """A confidential transfer is resolved once: rejected by its target, cancelled by who proposed it."""
    return life_cycle(events, "R22").unionByName(transfer_actors(events, "R22", ("REJECTED", "CANCELLED")))


def r24(events: DataFrame) -> DataFrame:
    """Exports name a known view and format in native representation; encryption needs a tar."""
    rows = of(events, "EXPORT_STARTED")
    plain = F.coalesce(R.signed("encrypted"), F.lit("false")) != "true"
    return broken(rows, "R24", R.signed("view_mode").isin(*VIEWS) & (R.signed("representation") == "native") & R.signed("output_format").isin(*FORMATS) & (plain | (R.signed("output_format") == "tar")))


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "R1": r1, "R2": r2, "R3": r3, "R4": r4, "R5": r5, "R6": r6, "R7": r7, "R8": r8, "R9": r9, "R10": r10, "R11": r11, "R12": r12, "R13": r13, "R14": r14,
    "R15": r15, "R16": r16, "R17": r17, "R18": lambda e: access(e).filter("rule = 'R18'"), "R19": lambda e: access(e).filter("rule = 'R19'"), "R20": r20, "R21": r21, "R22": r22, "R23": lambda e: life_cycle(e, "R23"), "R24": r24,
}


# Rules that are checked in one pass.
TOGETHER = {("R18", "R19"): access}


def audit(events: DataFrame, *rules: str) -> DataFrame:
    """Findings of some rules, or of all. (Collector results, R25, are checked by checkin.relate; heads, R26, by chain.append_guard.)"""
    wanted = list(rules or RULES)
    parts = [f for own, f in TOGETHER.items() if all(r in wanted for r in own)]
    alone = [r for r in wanted if not any(r in own and f in parts for own, f in TOGETHER.items())]
    return union_all([f(events) for f in [*parts, *[RULES[r] for r in alone]]])
