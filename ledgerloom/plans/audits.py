"""Audit rules over ledgers with planted faults, each with SQL that names the events at fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators.sets import union_all
from ..sources.shared import written
from .registry import query
from .standins import event, table, text

OWNER, X = "OP-1", "OP-X"


def found(ledger: DataFrame, *rules: str) -> DataFrame:
    """(target, rule, key) of the events that break one of the rules, each once."""
    held = written(ledger, "audited")
    return A.audit(held, *rules).select("target", "rule", "key").distinct()


def identity(who: Column) -> Column:
    return F.struct(who.alias("operator_id"))


def either(fault: Column, bad: str | None, good: Column | str) -> Column:
    return F.when(fault, F.lit(bad)).otherwise(F.lit(good) if isinstance(good, str) else good)


def founded(spark: SparkSession) -> DataFrame:
    """The first event of project P, whose owner is OWNER."""
    return event(spark.range(1), "PROJECT_GENESIS", "project", F.lit("P"), F.lit(1), {"identity": identity(F.lit(OWNER))}, F.lit(OWNER))


def joined(rows: DataFrame, who: Column, seq: Column, project: Column | None = None, by: Column | None = None, accepts: Column | None = None) -> DataFrame:
    """Invitations at seq, and acceptances after them, of those for whom accepts holds."""
    invited = event(rows, "CONTRIBUTOR_INVITED", "operator", who, seq, {"identity": identity(who)}, F.lit(OWNER) if by is None else by, project)
    return invited.unionByName(event(rows if accepts is None else rows.filter(accepts), "CONTRIBUTOR_ACCEPTED", "operator", who, seq + 1, {}, who, project))


@query("""
SELECT 'P' AS target, 'R1' AS rule, CAST(p_partkey * 3 AS VARCHAR) AS key FROM part WHERE p_partkey % 17 <> 0 AND (p_partkey % 19 = 0 OR p_partkey % 23 = 0 OR p_partkey % 8 = 7)
UNION ALL SELECT 'P', 'R1', CAST(p_partkey * 3 + 1 AS VARCHAR) FROM part WHERE p_partkey % 17 = 0
UNION ALL SELECT 'P', 'R1', CAST(p_partkey * 3 + 2 AS VARCHAR) FROM part WHERE p_partkey % 35 = 0
""")
def audit_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of all namespaces: closed without being issued, closed twice, with another number than their sequence, with
    another namespace's prefix throughout, or of no known namespace."""
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    pairs = [("case", "CASE"), ("acquisition", "ACQ"), ("note", "NOTE"), ("file", "FILE"), ("artefact", "ART"), ("export", "EXPORT"), ("authority_transfer", "TRANSFER"), ("relationship", "REL")]
    of = lambda at: F.get(F.array(*[F.lit(pair[at]) for pair in pairs]), n % 8)
    key, space = F.concat(F.when(n % 23 == 0, "XX").otherwise(of(1)), F.format_string("-%06d", n)), of(0)
    made = event(p.filter(n % 17 != 0), "IDENTIFIER_ISSUED", "identifier", key, n * 3, {"namespace": space, "sequence": F.when(n % 19 == 0, n + 1).otherwise(n)}, signed=False)
    retired = event(p.filter((n % 5 == 0) | (n % 17 == 0)), "IDENTIFIER_RETIRED", "identifier", key, n * 3 + 1, {"namespace": space}, signed=False)
    return found(union_all([made, retired, event(p.filter(n % 35 == 0), "IDENTIFIER_FAILED", "identifier", key, n * 3 + 2, {"namespace": space}, signed=False)]), "R1")


@query("""
WITH c AS (SELECT printf('P-%03d', c_nationkey) AS target, c_custkey AS n FROM customer)
SELECT printf('P-%03d', n_nationkey) AS target, 'R2' AS rule, '2' AS key FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT target, 'R3', CAST(n * 10 AS VARCHAR) FROM c WHERE n % 7 = 0
UNION ALL SELECT target, 'R3', CAST(n * 10 + 1 AS VARCHAR) FROM c WHERE n % 11 = 0
UNION ALL SELECT target, 'R4', CAST(n * 10 + 3 AS VARCHAR) FROM c WHERE n % 15 = 0
UNION ALL SELECT target, 'R5', CAST(n * 10 + 4 AS VARCHAR) FROM c WHERE n % 4 = 0 AND (n % 3 <> 0 OR n % 8 = 0)
""")
def audit_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second genesis; invitations by strangers and of known members; acceptances of what is not pending; removals of who is not active or without a reason."""
    c, n, k = table(spark, sf_dir, "customer"), F.col("c_custkey"), table(spark, sf_dir, "nation")
    project, who, owner = F.format_string("P-%03d", "c_nationkey"), F.format_string("OP-%d", "c_custkey"), F.format_string("OP-N%d", "c_nationkey")
    first = F.format_string("OP-N%d", "n_nationkey")
    genesis = [event(rows, "PROJECT_GENESIS", "project", F.format_string("P-%03d", "n_nationkey"), F.lit(at), {"identity": identity(first)}, first, F.format_string("P-%03d", "n_nationkey")) for at, rows in ((1, k), (2, k.filter("n_nationkey % 5 = 0")))]
    invited = event(c, "CONTRIBUTOR_INVITED", "operator", who, n * 10, {"identity": identity(who)}, either(n % 7 == 0, X, owner), project)
    again = event(c.filter(n % 11 == 0), "CONTRIBUTOR_INVITED", "operator", who, n * 10 + 1, {"identity": identity(who)}, owner, project)
    accepted = [event(c.filter(n % m == 0), "CONTRIBUTOR_ACCEPTED", "operator", who, n * 10 + at, {}, who, project) for m, at in ((3, 2), (15, 3))]
    removed = event(c.filter(n % 4 == 0), "CONTRIBUTOR_REMOVED", "operator", who, n * 10 + 4, {"reason": either(n % 8 == 0, " ", "left")}, owner, project)
    return found(union_all([*genesis, invited, again, *accepted, removed]), "R2", "R3", "R4", "R5")


@query("""
WITH s AS (SELECT printf('P-%03d', s_nationkey) AS target, s_suppkey AS n FROM supplier)
SELECT target, 'R8' AS rule, CAST(n * 100 + 2 AS VARCHAR) AS key FROM s WHERE n % 7 = 0
UNION ALL SELECT target, 'R6', CAST(n * 100 + 3 AS VARCHAR) FROM s WHERE n % 5 = 0 OR n % 11 = 0
UNION ALL SELECT target, 'R6', CAST(n * 100 + 4 AS VARCHAR) FROM s WHERE n % 13 = 0
UNION ALL SELECT target, 'R7', CAST(n * 100 + 5 AS VARCHAR) FROM s WHERE n % 6 = 0
UNION ALL SELECT target, 'R7', CAST(n * 100 + 6 AS VARCHAR) FROM s WHERE n % 10 = 0
""")
def audit_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases assigned by strangers; transfers to who is not active, without a reason or beside a pending one; transfers accepted by another or ended twice."""
    s, n, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey"), table(spark, sf_dir, "nation")
    project, case, owner, to = F.format_string("P-%03d", "s_nationkey"), F.format_string("CASE-%d", "s_suppkey"), F.format_string("OP-N%d", "s_nationkey"), F.format_string("B%d", "s_suppkey")
    first = F.format_string("OP-N%d", "n_nationkey")
    genesis = event(k, "PROJECT_GENESIS", "project", F.format_string("P-%03d", "n_nationkey"), F.lit(1), {"identity": identity(first)}, first, F.format_string("P-%03d", "n_nationkey"))
    members = joined(s, to, n * 100, project, owner, n % 5 != 0)
    given = event(s, "CASE_OWNERSHIP_ASSIGNED", "case", case, n * 100 + 2, {"owner_id": owner}, either(n % 7 == 0, X, owner), project)
    ask = lambda rows, name, at, reason: event(rows, "OWNERSHIP_TRANSFER_PROPOSED", "case", case, n * 100 + at, {"transfer_id": F.format_string(name, "s_suppkey"), "from_operator_id": owner, "to_operator_id": to, "reason": reason}, owner, project)
    end = lambda rows, kind, at, actor: event(rows, f"OWNERSHIP_TRANSFER_{kind}", "case", case, n * 100 + at, {"transfer_id": F.format_string("T-%d", "s_suppkey")}, actor, project)
    parts = [ask(s, "T-%d", 3, either(n % 11 == 0, "", "leaves")), ask(s.filter(n % 13 == 0), "U-%d", 4, F.lit("too"))]
    return found(union_all([genesis, members, given, *parts, end(s.filter(n % 2 == 0), "ACCEPTED", 5, either(n % 6 == 0, X, to)), end(s.filter(n % 10 == 0), "CANCELLED", 6, owner)]), "R6", "R7", "R8")


@query("""
WITH f AS (SELECT l_orderkey, count(*) AS n_files, count(DISTINCT num) AS n_at FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS num FROM lineitem GROUP BY ALL) x GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS n, 10000000 + o_orderkey * 20 AS seq, o_custkey, o_orderpriority LIKE '1%' AS lost, coalesce(n_files, 0) AS n_files, n_at FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
SELECT 'P' AS target, 'R9' AS rule, CAST(seq + 10 AS VARCHAR) AS key FROM o WHERE o_custkey % 10 = 0 OR lost OR n % 9 = 0 OR n_files = 0 OR n % 14 = 0 OR (n % 15 = 0 AND n_at > 1)
UNION ALL SELECT 'P', 'R10', CAST(seq + 11 AS VARCHAR) FROM o WHERE (n % 2 = 0 OR n % 4 = 1) AND (lost OR n % 9 = 0 OR n % 22 = 0 OR n % 8 = 1)
UNION ALL SELECT 'P', 'R10', CAST(seq + 12 AS VARCHAR) FROM o WHERE n % 26 = 0
""")
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as acquisitions: submitted by who is not active, for a case without an owner, with a wrong status, without a
    file or with files left out or in another order; decided by strangers, twice, without a reason, or when not pending."""
    c, k, n = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("o_orderkey")
    who = F.format_string("C%d", "o_custkey")
    members = joined(c, F.format_string("C%d", "c_custkey"), 100 + k * 2, accepts=k % 10 != 0)
    cases = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().filter("o_orderpriority not like '1%'")
    given = event(cases, "CASE_OWNERSHIP_ASSIGNED", "case", F.col("o_orderpriority"), F.substring("o_orderpriority", 1, 1).cast("long") + 1, {"owner_id": F.lit(OWNER)}, F.lit(OWNER))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("at"))
    files = event(lines, "FILE_COMMITTED", "file", text("l_partkey"), 10_000_000 + F.col("l_orderkey") * 20 + F.col("at"), {"case_id": F.lit("c"), "acquisition_id": text("l_orderkey"), "logical_path": text("l_partkey")}, signed=False)
    held = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", text("l_partkey").alias("f")))), lambda x: x["f"]).alias("ids"))
    # Lines of one number are committed at once, in any order.
    turned = F.concat(F.slice("ids", F.size("ids"), 1), F.slice("ids", 2, F.greatest(F.size("ids") - 2, F.lit(0))), F.slice("ids", 1, 1))
    ids = F.when(n % 14 == 0, F.slice("ids", 2, 100)).when((n % 15 == 0) & (F.size("ids") > 1), turned).otherwise(F.col("ids"))
    o, seq = table(spark, sf_dir, "orders").join(held, "o_orderkey", "left"), 10_000_000 + n * 20
    made = event(o, "ACQUISITION_RECORDED", "acquisition", text("o_orderkey"), seq + 10, {"case_id": F.col("o_orderpriority"), "status": either(n % 9 == 0, "approved", "pending"), "file_ids": ids}, who)
    judge = either(n % 22 == 0, X, OWNER)
    decided = [event(o.filter(where), kind, "acquisition", text("o_orderkey"), seq + at, {"reason": reason}, by) for where, kind, at, reason, by in (
        (n % 2 == 0, "RECORD_APPROVED", 11, F.lit(None).cast("string"), judge), (n % 4 == 1, "RECORD_REJECTED", 11, either(n % 8 == 1, "", "no"), judge), (n % 26 == 0, "RECORD_APPROVED", 12, F.lit(None).cast("string"), F.lit(OWNER)),
    )]
    return found(union_all([founded(spark), members, given, files, made, *decided]), "R9", "R10")


@query("""
WITH d AS (SELECT doc_id AS n, lang, CASE WHEN doc_id % 22 = 0 THEN 'same' ELSE 'd/' || doc_id END AS path FROM documents),
m AS (SELECT lang, count(*) AS k FROM d WHERE path = 'same' GROUP BY lang)
SELECT 'P' AS target, 'R12' AS rule, CAST(n AS VARCHAR) AS key FROM d LEFT JOIN m USING (lang) WHERE (n % 20 = 0 AND path <> 'same') OR n % 21 = 0 OR (path = 'same' AND k > 1)
UNION ALL SELECT 'P', 'R13', CAST(1000000000 + n AS VARCHAR) FROM d WHERE n % 6 = 0 AND (n % 12 = 0 OR n % 18 = 0)
UNION ALL SELECT 'P', 'R14', CAST(2000000000 + n AS VARCHAR) FROM d WHERE n = 0 OR n * 2 NOT IN (SELECT n FROM d) OR n % 9 = 0
UNION ALL SELECT 'P', 'R15', CAST(3000000000 + n AS VARCHAR) FROM d WHERE n % 10 = 0 OR n % 21 = 0
""")
def audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: unsafe or doubled paths, acquisitions without a case; states without a reason or unknown;
    relationships with lost ends, with themselves or without a label; artefacts of another case."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    f = F.format_string("FILE-%d", "doc_id")
    path = F.when(n % 22 == 0, "same").when(n % 20 == 0, F.concat(F.lit("../"), text("doc_id"))).otherwise(F.concat(F.lit("d/"), text("doc_id")))
    files = event(d, "FILE_COMMITTED", "file", f, n, {"case_id": either(n % 21 == 0, None, F.col("source")), "acquisition_id": F.col("lang"), "logical_path": path}, signed=False)
    seen = event(d.filter(n % 6 == 0), "FILE_PRESENTATION_CHANGED", "file", f, 1_000_000_000 + n, {"to": F.when(n % 18 == 0, "withheld").when(n % 5 == 0, "superseded").otherwise("retracted"), "reason": either(n % 12 == 0, " ", "r")}, signed=False)
    related = event(d, "FILE_RELATIONSHIP_ADDED", "file", f, 2_000_000_000 + n, {"parent_file_id": f, "child_file_id": F.format_string("FILE-%d", n * 2), "relationship": either(n % 9 == 0, "", "describes")}, signed=False)
    art = event(d, "ARTEFACT_CREATED", "artefact", F.format_string("ART-%d", "doc_id"), 3_000_000_000 + n, {"case_id": either(n % 10 == 0, "other", F.col("source")), "acquisition_id": F.col("lang"), "file_ids": F.array(f)}, signed=False)
    return found(union_all([files, seen, related, art]), "R12", "R13", "R14", "R15")


@query("""
WITH c AS (SELECT conv_id AS n, turn, conv_id * 1000 + turn AS seq, CASE WHEN conv_id % 5 = 0 AND turn > 0 AND turn = max(turn) OVER (PARTITION BY conv_id) THEN turn + 5 ELSE turn + 1 END AS rev FROM (SELECT DISTINCT conv_id, turn FROM conversations) t),
l AS (SELECT *, lag(rev) OVER (PARTITION BY n ORDER BY turn) AS last FROM c)
SELECT 'P' AS target, 'R16' AS rule, CAST(seq AS VARCHAR) AS key FROM l WHERE turn = 0 AND (n % 10 = 0 OR n % 11 = 0 OR last IS NOT NULL)
UNION ALL SELECT 'P', 'R16', CAST(seq AS VARCHAR) FROM l WHERE turn > 0 AND (last IS NULL OR rev <> last + 1 OR n % 13 = 0 OR n % 17 = 0)
UNION ALL SELECT DISTINCT 'P', 'R17', CAST(n * 1000 + 900 AS VARCHAR) FROM c WHERE n % 4 = 0
""")
def audit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes created for others or with an unknown visibility, revisions with a wrong number, without a reason or by
    strangers, and disclosure changed by another than the owner."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().withColumn("m", F.max("turn").over(Window.partitionBy("conv_id")))
    n, turn = F.col("conv_id"), F.col("turn")
    note, author, seq = F.format_string("NOTE-%d", "conv_id"), F.format_string("A%d", n % 7), n * 1000 + turn
    revision = F.when((n % 5 == 0) & (turn > 0) & (turn == F.col("m")), turn + 5).otherwise(turn + 1)
    kind = F.when(n % 11 == 0, "hidden").when(n % 3 == 0, "confidential").otherwise("project")
    made = event(c.filter("turn = 0"), "NOTE_CREATED", "note", note, seq, {"visibility": kind, "author_id": author, "revision": revision}, either(n % 10 == 0, X, author))
    more = event(c.filter("turn > 0"), "NOTE_REVISED", "note", note, seq, {"revision": revision, "reason": either(n % 13 == 0, "", "edit")}, either(n % 17 == 0, X, author))
    shown = event(c.select("conv_id").distinct(), "NOTE_DISCLOSURE_CHANGED", "note", note, n * 1000 + 900, {"package_disclosure": F.lit("include")}, either(n % 4 == 0, X, OWNER))
    return found(union_all([founded(spark), made, more, shown]), "R16", "R17")


@query("""
WITH g AS (SELECT l_suppkey AS s, l_partkey AS p, min(l_orderkey) AS o FROM lineitem GROUP BY ALL),
r AS (SELECT s, p, o, (s * 10000000 + p) * 4 AS seq FROM g)
SELECT 'P' AS target, 'R18' AS rule, CAST(seq AS VARCHAR) AS key FROM r WHERE s % 7 = 0 OR p % 11 = 0
UNION ALL SELECT 'P', 'R18', CAST(seq + 1 AS VARCHAR) FROM r WHERE p % 9 = 0
UNION ALL SELECT 'P', 'R19', CAST(seq + 2 AS VARCHAR) FROM r WHERE o % 2 = 1 AND p % 5 = 0
""")
def audit_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants without a reason, for unknown types of objects or open already; revocations of what is not open."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("o")).withColumn("seq", (F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")) * 4)
    who, part, p = text("l_suppkey"), text("l_partkey"), F.col("l_partkey")
    out = []
    for at, where, kind, basis in ((0, F.lit(True), "GRANTED", F.lit("explicit-grant")), (1, p % 9 == 0, "GRANTED", F.lit("explicit-grant")), (2, F.col("o") % 2 == 1, "REVOKED", either(p % 5 == 0, "case-role", "explicit-grant"))):
        reason = either(F.col("l_suppkey") % 7 == 0, "", "r") if at == 0 else F.lit("r")
        for object_type, of_type in (("box", p % 11 == 0), ("file", p % 11 != 0)):
            out.append(event(rows.filter(where & of_type), f"CONFIDENTIAL_ACCESS_{kind}", object_type, part, F.col("seq") + at, {"operator_id": who, "authority_basis": basis, "reason": reason}))
    return found(union_all(out), "R18", "R19")


@query("""
WITH n AS (SELECT DISTINCT conv_id AS n FROM conversations)
SELECT 'P' AS target, 'R20' AS rule, CAST(n * 1000 + 901 AS VARCHAR) AS key FROM n WHERE n % 12 = 0 OR n % 18 = 0 OR n % 24 = 0
UNION ALL SELECT 'P', 'R20', CAST(n * 1000 + 902 AS VARCHAR) FROM n WHERE n % 36 = 0
UNION ALL SELECT 'P', 'R21', CAST(n * 1000 + 903 AS VARCHAR) FROM n WHERE n % 10 <> 0 AND (n % 42 = 0 OR n % 48 = 0)
UNION ALL SELECT 'P', 'R22', CAST(n * 1000 + 903 AS VARCHAR) FROM n WHERE n % 10 = 0 AND n % 20 = 0
UNION ALL SELECT 'P', 'R22', CAST(n * 1000 + 905 AS VARCHAR) FROM n WHERE n % 54 = 0
""")
def audit_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidential transfers proposed by strangers, of what the source does not control, to who is not active, or beside
    a pending one; accepted by another or with another scope; rejected by another; ended twice."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    n, note, to = F.col("conv_id"), F.format_string("NOTE-%d", "conv_id"), F.format_string("B%d", "conv_id")
    author = F.format_string("A%d", n % 7)
    made = event(c, "NOTE_CREATED", "note", note, n * 1000 + 10, {"visibility": F.lit("confidential"), "author_id": author, "revision": F.lit(1)}, author)
    scope = lambda kind: F.array(F.struct(F.lit(kind).alias("object_type"), note.alias("object_id")))
    ask = lambda rows, name, at, source, by: event(rows, "CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED", "transfer", F.format_string(name, "conv_id"), n * 1000 + at, {"from_operator_id": source, "to_operator_id": to, "scope": scope("note")}, by)
    end = lambda rows, name, kind, at, by, what: event(rows, f"CONFIDENTIAL_AUTHORITY_TRANSFER_{kind}", "transfer", F.format_string(name, "conv_id"), n * 1000 + at, {"scope": what}, by)
    parts = [
        ask(c, "CT-%d", 901, either(n % 18 == 0, "Z", author), either(n % 12 == 0, X, OWNER)), ask(c.filter("conv_id % 36 = 0"), "DT-%d", 902, author, F.lit(OWNER)),
        end(c.filter("conv_id % 10 <> 0"), "CT-%d", "ACCEPTED", 903, either(n % 42 == 0, X, to), F.when(n % 48 == 0, scope("file")).otherwise(scope("note"))),
        end(c.filter("conv_id % 10 = 0"), "CT-%d", "REJECTED", 903, either(n % 20 == 0, X, to), scope("note")), end(c.filter("conv_id % 36 = 0"), "DT-%d", "CANCELLED", 904, F.lit(OWNER), scope("note")),
        end(c.filter("conv_id % 54 = 0"), "CT-%d", "CANCELLED", 905, either(n % 12 == 0, X, OWNER), scope("note")),
    ]
    members = joined(c, to, n * 1000 + 20, accepts=n % 24 != 0)
    genesis = event(spark.range(1), "PROJECT_GENESIS", "project", F.lit("P"), F.lit(-1), {"identity": identity(F.lit(OWNER))}, F.lit(OWNER))
    return found(union_all([genesis, members, made, *parts]), "R20", "R21", "R22")


@query("""
SELECT printf('P-%03d', c_nationkey) AS target, 'R11' AS rule, CAST(c_custkey + 1 AS VARCHAR) AS key FROM customer WHERE c_custkey % 6 = 0 OR c_custkey % 10 = 0
UNION ALL SELECT 'P', 'R24', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)
""")
def audit_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies changed by strangers or to unknown values; exports with an unknown view, representation or format, or encrypted without a tar."""
    c, k, n = table(spark, sf_dir, "customer"), F.col("c_custkey"), table(spark, sf_dir, "nation")
    project, owner = F.format_string("P-%03d", "c_nationkey"), F.format_string("OP-N%d", "c_nationkey")
    first, home = F.format_string("OP-N%d", "n_nationkey"), F.format_string("P-%03d", "n_nationkey")
    genesis = event(n, "PROJECT_GENESIS", "project", home, F.lit(1), {"identity": identity(first)}, first, home)
    policy = F.struct(either(k % 10 == 0, "all", "members").alias("ordinary_export"), *[F.lit("owner").alias(p) for p in ("ciphertext_export", "confidential_plaintext_export", "broad_scope_export")])
    changed = event(c, "EXPORT_POLICY_CHANGED", "project", project, k + 1, {"policy": policy}, either(k % 6 == 0, X, owner), project)
    o, m = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    form = F.when(m % 13 == 0, "zip").when(m % 2 == 0, "directory").otherwise("tar")
    started = event(o, "EXPORT_STARTED", "export", text("o_orderkey"), m, {"view_mode": either(m % 7 == 0, "none", "full"), "representation": either(m % 11 == 0, "pdf", "native"), "output_format": form, "encrypted": (m % 3 == 0).cast("string")})
    return found(union_all([genesis, changed, started]), "R11", "R24")
