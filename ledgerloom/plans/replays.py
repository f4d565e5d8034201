"""State rebuilt from ledgers that the provided tables stand for, each with SQL that reads the tables directly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replay as R
from ..operators import verify as V
from ..operators.sets import union_all
from ..sources.shared import written
from .registry import query
from .standins import event, table, text


def part_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as identifiers of their brands: every fifth is retired, the next after it has failed."""
    p = table(spark, sf_dir, "part")
    key, n = F.concat_ws("-", "p_brand", text("p_partkey")), F.col("p_partkey")
    made = event(p, "IDENTIFIER_ISSUED", "identifier", key, n * 3, {"namespace": F.col("p_brand"), "sequence": n}, signed=False)
    closed = [event(p.filter(n % 5 == k), kind, "identifier", key, n * 3 + 1, {"namespace": F.col("p_brand")}, signed=False) for k, kind in ((0, "IDENTIFIER_RETIRED"), (1, "IDENTIFIER_FAILED"))]
    return union_all([made, *closed])


@query("SELECT p_brand || '-' || p_partkey AS identifier, p_brand AS namespace, CAST(p_partkey AS VARCHAR) AS sequence, CASE p_partkey % 5 WHEN 0 THEN 'retired' WHEN 1 THEN 'failed' ELSE 'active' END AS state FROM part")
def replay_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(part_events(spark, sf_dir), R.projections()["identifiers"]).drop("project_id")


@query("SELECT p_brand AS namespace, max(p_partkey) + 1 AS next_value FROM part GROUP BY p_brand")
def replay_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counters(part_events(spark, sf_dir)).drop("project_id")


def member_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers invited to the projects of their nations: a third accepts, a third rejects; every ninth is removed again.

    Project transfers go from the nation's first owner to the customer with the largest number, accepted in even nations.
    """
    project = F.format_string("P-%03d", "c_nationkey")
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    first = F.format_string("OP-N%d", "n_nationkey")
    identity = lambda who, name, role: F.struct(who.alias("operator_id"), name.alias("name"), role.alias("role"), F.concat(F.lit("F"), who).alias("operator_key_fingerprint"), F.concat(F.lit("S"), who).alias("operator_signing_subkey_fingerprint"))
    who = F.format_string("OP-%d", "c_custkey")
    nation = table(spark, sf_dir, "nation")
    genesis = event(nation, "PROJECT_GENESIS", "project", F.format_string("P-%03d", "n_nationkey"), F.lit(1), {"operator_ref": F.col("n_name"), "identity": identity(first, F.col("n_name"), F.lit("founder"))}, first, F.format_string("P-%03d", "n_nationkey"))
    invited = event(c, "CONTRIBUTOR_INVITED", "operator", who, n * 10, {"operator_ref": F.col("c_name"), "identity": identity(who, F.col("c_name"), F.col("c_mktsegment"))}, F.format_string("OP-N%d", "c_nationkey"), project)
    decided = [event(c.filter(n % 3 == k), kind, "operator", who, n * 10 + 1, {}, who, project) for k, kind in ((0, "CONTRIBUTOR_ACCEPTED"), (1, "CONTRIBUTOR_REJECTED"))]
    removed = event(c.filter(n % 9 == 0), "CONTRIBUTOR_REMOVED", "operator", who, n * 10 + 2, {"reason": F.lit("left")}, F.format_string("OP-N%d", "c_nationkey"), project)
    last = c.groupBy("c_nationkey").agg(F.max("c_custkey").alias("m"))
    to = F.format_string("OP-%d", "m")
    moves = {"transfer_id": F.lit("T"), "from_operator_id": F.format_string("OP-N%d", "c_nationkey"), "to_operator_id": to, "reason": F.lit("moves on")}
    proposed = event(last, "OWNERSHIP_TRANSFER_PROPOSED", "project", project, F.col("m") * 10 + 5, moves, F.format_string("OP-N%d", "c_nationkey"), project)
    done = event(last.filter("c_nationkey % 2 = 0"), "OWNERSHIP_TRANSFER_ACCEPTED", "project", project, F.col("m") * 10 + 6, {"transfer_id": F.lit("T")}, to, project)
    return union_all([genesis, invited, *decided, removed, proposed, done])


MEMBERS = """
own AS (SELECT n_nationkey AS k, printf('P-%03d', n_nationkey) AS project_id, 'OP-N' || n_nationkey AS operator_id, n_name AS name, 'founder' AS role, 1 AS seq, n_name AS ref FROM nation),
inv AS (SELECT c_nationkey AS k, printf('P-%03d', c_nationkey) AS project_id, 'OP-' || c_custkey AS operator_id, c_name AS name, c_mktsegment AS role, c_custkey * 10 AS seq, c_name AS ref, c_custkey AS n FROM customer),
last AS (SELECT c_nationkey AS k, max(c_custkey) AS m FROM customer GROUP BY c_nationkey),
both_kinds AS (SELECT project_id, operator_id, name, role, seq, ref FROM own UNION ALL SELECT project_id, operator_id, name, role, seq, ref FROM inv)
"""


@query(f"WITH {MEMBERS} SELECT project_id, operator_id, ref AS operator_ref, name, role AS role_label, 'active' AS state, CAST(seq AS VARCHAR) AS created_sequence FROM both_kinds")
def replay_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.project(member_events(spark, sf_dir), R.projections()["operators"])
    return out.select("project_id", "operator_id", "operator_ref", "name", "role_label", "state", "created_sequence")


@query(f"WITH {MEMBERS} SELECT project_id, operator_id, 'S' || operator_id AS signing_fingerprint, 'F' || operator_id AS primary_fingerprint, 'active' AS state, CAST(seq AS VARCHAR) AS valid_from_sequence FROM both_kinds")
def replay_operator_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.project(member_events(spark, sf_dir), R.projections()["operator_keys"])
    return out.select("project_id", "operator_id", "signing_fingerprint", "primary_fingerprint", "state", "valid_from_sequence")


@query(f"""
WITH {MEMBERS}
SELECT project_id, operator_id, CASE WHEN k % 2 = 0 AND k IN (SELECT k FROM last) THEN 'contributor' ELSE 'owner' END AS membership_role, 'active' AS state, '1' AS added_sequence, '1' AS resolved_sequence FROM own
UNION ALL SELECT project_id, operator_id, CASE WHEN inv.k % 2 = 0 AND n = m THEN 'owner' ELSE 'contributor' END,
       CASE WHEN n % 9 = 0 THEN 'removed' WHEN n % 3 = 0 THEN 'active' WHEN n % 3 = 1 THEN 'rejected' ELSE 'pending' END, CAST(seq AS VARCHAR),
       CAST(CASE WHEN n % 9 = 0 THEN seq + 2 WHEN n % 3 <> 2 THEN seq + 1 END AS VARCHAR) FROM inv JOIN last USING (k)
""")
def replay_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.memberships(member_events(spark, sf_dir))


@query(f"""
WITH {MEMBERS}
SELECT own.project_id, CASE WHEN own.k % 2 = 0 AND m IS NOT NULL THEN 'OP-' || m ELSE operator_id END AS owner_id, CASE WHEN own.k % 2 = 0 AND m IS NOT NULL THEN m * 10 + 6 ELSE 1 END AS effective_from_sequence, 'project' AS scope_type, own.project_id AS scope_id FROM own LEFT JOIN last USING (k)
UNION ALL SELECT printf('P-%03d', s_nationkey), CASE WHEN s_suppkey % 4 = 0 THEN 'B' ELSE 'A' END || s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 10 + 2 ELSE s_suppkey * 10 END, 'case', 'CASE-' || s_suppkey FROM supplier
""")
def replay_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ownership(member_events(spark, sf_dir).unionByName(case_events(spark, sf_dir)))


def case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cases: every second one's transfer is proposed, of which a half is accepted, the others rejected or cancelled."""
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    project, case = F.format_string("P-%03d", "s_nationkey"), F.format_string("CASE-%d", "s_suppkey")
    a, b = F.format_string("A%d", "s_suppkey"), F.format_string("B%d", "s_suppkey")
    given = event(s, "CASE_OWNERSHIP_ASSIGNED", "case", case, n * 10, {"owner_id": a}, a, project)
    t = F.format_string("T-%d", "s_suppkey")
    proposed = event(s.filter(n % 2 == 0), "OWNERSHIP_TRANSFER_PROPOSED", "case", case, n * 10 + 1, {"transfer_id": t, "from_operator_id": a, "to_operator_id": b, "reason": F.col("s_name")}, a, project)
    ends = {"ACCEPTED": n % 4 == 0, "REJECTED": (n % 4 == 2) & (n % 3 == 0), "CANCELLED": (n % 4 == 2) & (n % 3 == 1)}
    done = [event(s.filter(rule), f"OWNERSHIP_TRANSFER_{kind}", "case", case, n * 10 + 2, {"transfer_id": t}, b, project) for kind, rule in ends.items()]
    return union_all([given, proposed, *done])


@query("""
SELECT printf('P-%03d', s_nationkey) AS project_id, 'T-' || s_suppkey AS transfer_id, 'A' || s_suppkey AS from_operator_id, 'B' || s_suppkey AS to_operator_id, s_name AS reason, 'case' AS scope_type, 'CASE-' || s_suppkey AS scope_id,
       CASE WHEN s_suppkey % 4 = 0 THEN 'accepted' WHEN s_suppkey % 3 = 0 THEN 'rejected' WHEN s_suppkey % 3 = 1 THEN 'cancelled' ELSE 'pending' END AS state, CAST(s_suppkey * 10 + 1 AS VARCHAR) AS proposed_sequence,
       CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 3 <> 2 THEN CAST(s_suppkey * 10 + 2 AS VARCHAR) END AS resolved_sequence FROM supplier WHERE s_suppkey % 2 = 0
""")
def replay_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(case_events(spark, sf_dir), R.projections()["ownership_transfers"])


def record_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as acquisitions of their lines; those of status F are approved at once, O approved later, P rejected."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", text("l_partkey").alias("f")))), lambda x: x["f"]).alias("ids"))
    o = o.join(lines, "o_orderkey", "left")
    at_once = F.col("o_orderstatus") == "F"
    made = event(o, "ACQUISITION_RECORDED", "record", text("o_orderkey"), n * 10, {"case_id": F.col("o_orderpriority"), "status": F.when(at_once, "approved").otherwise("pending"), "file_ids": F.col("ids")}, text("o_custkey"))
    decided = [event(o.filter(F.col("o_orderstatus") == k), kind, "acquisition", text("o_orderkey"), n * 10 + 1, {"reason": F.lit(why)}, F.lit("judge")) for k, kind, why in (("O", "RECORD_APPROVED", None), ("P", "RECORD_REJECTED", "no"))]
    return union_all([made, *decided])


@query("""
SELECT 'acquisition' AS object_type, CAST(o_orderkey AS VARCHAR) AS object_id, o_orderpriority AS scope_id, CAST(o_custkey AS VARCHAR) AS submitted_by, CASE o_orderstatus WHEN 'P' THEN 'rejected' WHEN 'F' THEN 'approved' WHEN 'O' THEN 'approved' ELSE 'pending' END AS status,
       CAST(o_orderkey * 10 AS VARCHAR) AS submitted_sequence, CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS VARCHAR) WHEN 'O' THEN 'judge' WHEN 'P' THEN 'judge' END AS decided_by,
       CAST(CASE o_orderstatus WHEN 'F' THEN o_orderkey * 10 WHEN 'O' THEN o_orderkey * 10 + 1 WHEN 'P' THEN o_orderkey * 10 + 1 END AS VARCHAR) AS decision_sequence, CASE o_orderstatus WHEN 'P' THEN 'no' END AS decision_reason FROM orders
""")
def replay_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(record_events(spark, sf_dir), R.projections()["record_authority"]).drop("project_id")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS acquisition_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) - 1 AS INTEGER) AS position, CAST(l_partkey AS VARCHAR) AS file_id, l_orderkey * 10 AS created_sequence
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
""")
def replay_acquisition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.acquisition_files(record_events(spark, sf_dir)).drop("project_id")


def note_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notes, turns as their revisions; every third note is confidential, every fourth is disclosed later.

    Confidential notes of even numbers are transferred: accepted, but for those whose number ends in 0, which are rejected.
    """
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    n, note = F.col("conv_id") * 1000, F.format_string("NOTE-%d", "conv_id")
    secret = F.col("conv_id") % 3 == 0
    author = F.format_string("A%d", F.col("conv_id") % 7)
    body = {"revision": F.col("turn") + 1, "file_id": F.format_string("FILE-%d-%d", "conv_id", "turn"), "revision_type": F.col("role"), "reason": F.when(F.col("turn") > 0, F.lit("edit"))}
    head = {"visibility": F.when(secret, "confidential").otherwise("project"), "author_id": author, "case_id": F.format_string("C%d", F.col("conv_id") % 5), "package_disclosure": F.lit("withheld")}
    made = event(c.filter("turn = 0"), "NOTE_CREATED", "note", note, n, body | head, author)
    later = [event(c.filter(f"turn > 0 and turn % 2 = {k}"), kind, "note", note, n + F.col("turn"), body, author) for k, kind in ((1, "NOTE_REVISED"), (0, "NOTE_REENCRYPTED"))]
    one = c.filter("turn = 0")
    shown = event(one.filter("conv_id % 4 = 0"), "NOTE_DISCLOSURE_CHANGED", "note", note, n + 900, {"package_disclosure": F.lit("include")})
    moved = one.filter("conv_id % 6 = 0")
    scope = F.array(F.struct(F.lit("note").alias("object_type"), note.alias("object_id")))
    t = F.format_string("CT-%d", "conv_id")
    proposed = event(moved, "CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED", "transfer", t, n + 901, {"from_operator_id": author, "to_operator_id": F.lit("B"), "reason": F.lit("leave"), "scope": scope})
    ended = [event(moved.filter(rule), f"CONFIDENTIAL_AUTHORITY_TRANSFER_{kind}", "transfer", t, n + 902, {"scope": scope}, F.lit("B")) for kind, rule in (("ACCEPTED", "conv_id % 10 <> 0"), ("REJECTED", "conv_id % 10 = 0"))]
    return union_all([made, *later, shown, proposed, *ended])


NOTES = "c AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY conv_id, turn), n AS (SELECT conv_id, max(turn) + 1 AS latest FROM c GROUP BY conv_id HAVING min(turn) = 0)"


@query(f"""
WITH {NOTES} SELECT 'NOTE-' || conv_id AS note_id, CASE WHEN conv_id % 3 = 0 THEN 'confidential' ELSE 'project' END AS visibility, 'A' || conv_id % 7 AS author_id, 'C' || conv_id % 5 AS case_id,
       CAST(latest AS VARCHAR) AS latest_revision, CASE WHEN conv_id % 4 = 0 THEN 'include' ELSE 'withheld' END AS package_disclosure, CAST(conv_id * 1000 AS VARCHAR) AS created_sequence FROM n
""")
def replay_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(note_events(spark, sf_dir), R.projections()["notes"]).drop("project_id", "subject_file_id")


@query(f"""
WITH {NOTES} SELECT 'NOTE-' || conv_id AS note_id, CAST(turn + 1 AS VARCHAR) AS revision, 'FILE-' || conv_id || '-' || turn AS file_id, role AS revision_type, CAST(conv_id * 1000 + turn AS VARCHAR) AS created_sequence,
       'A' || conv_id % 7 AS revised_by, CASE WHEN turn > 0 THEN 'edit' END AS reason FROM c
""")
def replay_note_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(note_events(spark, sf_dir), R.projections()["note_revisions"]).drop("project_id")


@query(f"""
WITH {NOTES} SELECT 'note' AS object_type, 'NOTE-' || conv_id AS object_id, 'A' || conv_id % 7 AS creator_id, CASE WHEN conv_id % 6 = 0 AND conv_id % 10 <> 0 THEN 'B' ELSE 'A' || conv_id % 7 END AS authority_id,
       CASE WHEN conv_id % 6 = 0 AND conv_id % 10 <> 0 THEN conv_id * 1000 + 902 ELSE conv_id * 1000 END AS effective_sequence FROM n WHERE conv_id % 3 = 0
""")
def replay_confidential_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.confidential_authority(note_events(spark, sf_dir)).drop("project_id")


@query(f"""
WITH {NOTES} SELECT 'CT-' || conv_id AS transfer_id, 'A' || conv_id % 7 AS from_operator_id, 'B' AS to_operator_id, CASE WHEN conv_id % 10 = 0 THEN 'rejected' ELSE 'accepted' END AS state, 'leave' AS reason,
       CAST(conv_id * 1000 + 901 AS VARCHAR) AS proposed_sequence, CAST(conv_id * 1000 + 902 AS VARCHAR) AS resolved_sequence, '[{{"object_type":"note","object_id":"NOTE-' || conv_id || '"}}]' AS scope_json FROM n WHERE conv_id % 6 = 0
""")
def replay_confidential_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(note_events(spark, sf_dir), R.projections()["confidential_transfers"]).drop("project_id")


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as committed files: every sixth is retracted, every twelfth presented again; each is related to the file
    of twice its number and has an artefact with it."""
    d, n = table(spark, sf_dir, "documents").filter("doc_id is not null"), F.col("doc_id")
    f = F.format_string("FILE-%d", "doc_id")
    made = {"case_id": F.col("source"), "acquisition_id": F.col("lang"), "logical_path": F.concat_ws("/", "source", text("doc_id")), "classification": F.lit("text"), "media_type": F.lit("text/plain"), "content_digest": F.sha2("text", 256), "size_bytes": F.octet_length("text"), "storage_path": F.concat(F.lit("files/"), f)}
    commits = event(d, "FILE_COMMITTED", "file", f, n * 10, made, F.lit("A"), signed=False)
    seen = [event(d.filter(n % k == 0), "FILE_PRESENTATION_CHANGED", "file", f, n * 10 + at, {"to": F.lit(to), "reason": F.lit("r")}, signed=False) for k, at, to in ((6, 1, "retracted"), (12, 2, "presented"))]
    twice = F.format_string("FILE-%d", n * 2)
    related = event(d, "FILE_RELATIONSHIP_ADDED", "file", f, n * 10 + 3, {"parent_file_id": f, "child_file_id": twice, "relationship": F.lit("describes")}, signed=False)
    art = event(d, "ARTEFACT_CREATED", "artefact", F.format_string("ART-%d", "doc_id"), n * 10 + 4, {"case_id": F.col("source"), "acquisition_id": F.col("lang"), "role": F.lit("primary"), "description": F.lit("d"), "file_ids": F.array(f, twice)}, signed=False)
    return union_all([commits, *seen, related, art])


@query("""
SELECT 'FILE-' || doc_id AS file_id, source AS case_id, lang AS acquisition_id, source || '/' || doc_id AS logical_path, 'text' AS classification, 'text/plain' AS media_type, sha256(text) AS content_digest, CAST(octet_length(encode(text)) AS VARCHAR) AS size_bytes,
       'files/FILE-' || doc_id AS storage_path, 'A' AS actor_id, CAST(doc_id * 10 AS VARCHAR) AS committed_sequence, CASE WHEN doc_id % 6 = 0 AND doc_id % 12 <> 0 THEN 'retracted' ELSE 'presented' END AS presentation_state FROM documents
""")
def replay_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(file_events(spark, sf_dir), R.projections()["files"]).drop("project_id")


@query("SELECT 'FILE-' || doc_id AS parent_file_id, 'FILE-' || doc_id * 2 AS child_file_id, 'describes' AS relationship, CAST(doc_id * 10 + 3 AS VARCHAR) AS created_sequence FROM documents")
def replay_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(file_events(spark, sf_dir), R.projections()["file_relationships"]).drop("project_id")


@query("""
SELECT 'ART-' || doc_id AS artefact_id, source AS case_id, lang AS acquisition_id, 'primary' AS role, 'd' AS description, CAST(doc_id * 10 + 4 AS VARCHAR) AS created_sequence, 'presented' AS presentation_state FROM documents
""")
def replay_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(file_events(spark, sf_dir), R.projections()["artefacts"]).drop("project_id")


@query("SELECT DISTINCT 'ART-' || doc_id AS artefact_id, 'FILE-' || doc_id * k AS file_id, 'primary' AS member_role, doc_id * 10 + 4 AS created_sequence FROM documents, (SELECT unnest([1, 2]) AS k) x WHERE k = 1 OR doc_id <> 0")
def replay_artefact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.artefact_files(file_events(spark, sf_dir)).drop("project_id").distinct()


POLICY = ("ordinary_export", "ciphertext_export", "confidential_plaintext_export", "broad_scope_export")


def policy_events(spark: SparkSession, sf_dir: str, lies: Column | None = None) -> DataFrame:
    """Customers as policy changes of their nations: each sets the ordinary rule by its market segment and names the rule
    before it as `previous`, but for those where lies holds."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer")
    nation = F.format_string("P-%03d", "c_nationkey")
    says = lambda ordinary: F.struct(ordinary.alias("ordinary_export"), *[F.lit("owner").alias(p) for p in POLICY[1:]])
    rows = c.withColumn("before", F.coalesce(F.lag("c_mktsegment").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")), F.lit("owner")))
    if lies is not None:
        rows = rows.withColumn("before", F.when(lies, "lie").otherwise(F.col("before")))
    changes = event(rows, "EXPORT_POLICY_CHANGED", "project", nation, F.col("c_custkey") + 1, {"policy": says(F.col("c_mktsegment")), "previous": says(F.col("before"))}, project=nation)
    n = table(spark, sf_dir, "nation")
    return event(n, "PROJECT_GENESIS", "project", F.format_string("P-%03d", "n_nationkey"), F.lit(1), {"export_policy": says(F.lit("owner"))}, project=F.format_string("P-%03d", "n_nationkey")).unionByName(changes)


@query("""
SELECT printf('P-%03d', n_nationkey) AS project_id, 'project' AS policy_id, coalesce(arg_max(c_mktsegment, c_custkey), 'owner') AS ordinary_export, 'owner' AS ciphertext_export, 'owner' AS confidential_plaintext_export, 'owner' AS broad_scope_export,
       CAST(coalesce(max(c_custkey) + 1, 1) AS VARCHAR) AS updated_sequence FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
""")
def replay_export_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(policy_events(spark, sf_dir), R.projections()["export_policy"])


@query("SELECT printf('P-%03d', c_nationkey) AS target, 'policy-history' AS rule, CAST(c_custkey + 1 AS VARCHAR) AS key FROM customer WHERE c_custkey % 11 = 0")
def verify_policy_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh change names another policy as the one before it."""
    return V.verify_policy_history(policy_events(spark, sf_dir, F.col("c_custkey") % 11 == 0)).select("target", "rule", "key")


def grant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of lines as operators with access to their parts, from the least line on; grants of odd orders are revoked."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("o"))
    who, part, at = text("l_suppkey"), text("l_partkey"), F.col("o") * 2
    said = {"operator_id": who, "authority_basis": F.when(F.col("l_partkey") % 2 == 0, "explicit-grant").otherwise("object-owner"), "reason": F.lit("r")}
    given = event(rows, "CONFIDENTIAL_ACCESS_GRANTED", "file", part, at, said)
    return given.unionByName(event(rows.filter("o % 2 = 1"), "CONFIDENTIAL_ACCESS_REVOKED", "file", part, at + 1, said | {"granted_sequence": at}))


@query("""
WITH g AS (SELECT l_suppkey, l_partkey, min(l_orderkey) AS o FROM lineitem GROUP BY ALL)
SELECT CAST(l_suppkey AS VARCHAR) AS operator_id, 'file' AS object_type, CAST(l_partkey AS VARCHAR) AS object_id, CASE WHEN l_partkey % 2 = 0 THEN 'explicit-grant' ELSE 'object-owner' END AS authority_basis, o * 2 AS granted_sequence, 'r' AS grant_reason,
       CASE WHEN o % 2 = 1 THEN CAST(o * 2 + 1 AS VARCHAR) END AS revoked_sequence, CASE WHEN o % 2 = 1 THEN 'r' END AS revoke_reason FROM g
""")
def replay_access_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.project(grant_events(spark, sf_dir), R.projections()["access_grants"]).drop("project_id")


def export_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as completed exports of their lines."""
    lines = table(spark, sf_dir, "lineitem")
    item = F.struct(text("l_partkey").alias("file_id"), F.concat_ws("/", text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("output_path"), text("l_quantity").alias("source_digest"), F.col("l_returnflag").alias("output_digest"), F.col("l_linestatus").alias("mode"))
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return event(rows, "EXPORT_COMPLETED", "export", text("l_orderkey"), F.col("l_orderkey"), {"items": F.col("items")})


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS export_id, CAST(l_partkey AS VARCHAR) AS file_id, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS output_path, CAST(l_quantity AS VARCHAR) AS source_digest, l_returnflag AS output_digest, l_linestatus AS mode FROM lineitem
""")
def replay_export_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.export_items(export_events(spark, sf_dir)).drop("project_id")


@query("""
WITH c AS (SELECT conv_id, max(turn) + 1 AS latest FROM conversations GROUP BY conv_id HAVING min(turn) = 0),
f AS (SELECT doc_id, source, lang FROM documents),
x AS (
  SELECT 'files' AS target, 'missing' AS rule, 'P/FILE-' || doc_id AS key, NULL AS "column" FROM f WHERE doc_id % 31 = 0
  UNION ALL SELECT 'files', 'changed', 'P/FILE-' || doc_id, 'presentation_state' FROM f WHERE doc_id % 31 <> 0 AND doc_id % 37 = 0
  UNION ALL SELECT 'file_relationships', 'extra', 'P/X/Y/z', NULL
  UNION ALL SELECT 'artefact_files', 'missing', 'P/ART-' || doc_id || '/FILE-' || doc_id * k, NULL FROM (SELECT DISTINCT doc_id, doc_id * k AS m, min(k) AS k FROM f, (SELECT unnest([1, 2]) AS k) s GROUP BY ALL) y WHERE doc_id % 41 = 0
  UNION ALL SELECT 'notes', 'changed', 'P/NOTE-' || conv_id, 'latest_revision' FROM c WHERE conv_id % 5 = 0
  UNION ALL SELECT 'notes', 'changed', 'P/NOTE-' || conv_id, 'author_id' FROM c WHERE conv_id % 5 = 0
  UNION ALL SELECT 'confidential_authority', 'changed', 'P/note/NOTE-' || conv_id, 'authority_id' FROM c WHERE conv_id % 3 = 0 AND conv_id % 9 = 0
  UNION ALL SELECT 'identifiers', 'changed', 'P/' || p_brand || '-' || p_partkey, 'state' FROM part WHERE p_partkey % 35 = 0
  UNION ALL SELECT 'counters', 'changed', 'P/' || p_brand, 'next_value' FROM part GROUP BY p_brand
)
SELECT * FROM x
""")
def verify_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live tables in which rows are lost, added or changed, against the tables of their history."""
    specs, parts = R.projections(), part_events(spark, sf_dir)
    files_led, notes_led = written(file_events(spark, sf_dir), "events"), written(note_events(spark, sf_dir), "events")
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    f = R.project(files_led, specs["files"]).filter(number("file_id") % 31 != 0)
    f = f.withColumn("presentation_state", F.when(number("file_id") % 37 == 0, "lost").otherwise(F.col("presentation_state")))
    rel = R.project(files_led, specs["file_relationships"])
    more = rel.sparkSession.range(1).select(F.lit("P").alias("project_id"), F.lit("X").alias("parent_file_id"), F.lit("Y").alias("child_file_id"), F.lit("z").alias("relationship"), F.lit("1").alias("created_sequence"))
    art = R.artefact_files(files_led).distinct().filter(number("artefact_id") % 41 != 0)
    fifth = number("note_id") % 5 == 0
    notes = R.project(notes_led, specs["notes"]).withColumns({"latest_revision": F.when(fifth, "x").otherwise(F.col("latest_revision")), "author_id": F.when(fifth, None).otherwise(F.col("author_id"))})
    held = R.confidential_authority(notes_led).withColumn("authority_id", F.when(number("object_id") % 9 == 0, "x").otherwise(F.col("authority_id")))
    ids = R.project(parts, specs["identifiers"]).withColumn("state", F.when(number("identifier") % 35 == 0, "active").otherwise(F.col("state")))
    counters = R.counters(parts).withColumn("next_value", F.lit(0))
    found = union_all([
        V.verify_state(files_led.dropDuplicates(), {"files": f, "file_relationships": rel.unionByName(more)}), V.verify_state(notes_led, {"notes": notes, "confidential_authority": held}),
        V.verify_state(parts, {"identifiers": ids, "counters": counters}), V.diff(R.artefact_files(files_led).distinct(), art, ["project_id", "artefact_id", "file_id"], ["member_role", "created_sequence"], "artefact_files"),
    ])
    return found.select("target", "rule", "key", "column")
