"""Verifiers, decisions and check-in over the provided tables with planted faults, each with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chain as C
from ..operators import checkin as B
from ..operators import decisions as D
from ..operators import matching as M
from ..operators import replay as R
from ..operators import scopes as Q
from ..operators import verify as V
from ..operators.findings import report, summarise_findings
from ..operators.sets import union_all
from ..sources import ledger as L
from ..sources.shared import written
from .registry import FILES, LEDGER, query
from .replays import file_events, note_events, policy_events
from .standins import files, ledger, scope_tables, table, text

FIELDS = ("occurred_at", "event_type", "object_type", "object_id", "previous_hash", "actor_id", "actor_uuid")


def number(c: str) -> Column:
    return F.regexp_extract(c, "([0-9]+)$", 1).cast("long")


def signed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as signed events of operators: the envelope repeats the row, but for those whose number is divisible by 31,
    that name another object, and by 43, that another key signed; by 47, without a signature."""
    e = ledger(spark, sf_dir).withColumn("n", number("object_id"))
    e = e.withColumns({"actor_kind": F.lit("operator"), "actor_id": F.concat(F.lit("OP-"), F.substring("project_id", 3, 9)), "actor_uuid": F.concat(F.lit("u"), F.substring("project_id", 3, 9)), "previous_hash": F.concat(F.lit("h"), text("event_sequence"))})
    e = e.withColumn("credential_fingerprint", F.concat(F.lit("S"), (F.col("event_sequence") % 5).cast("string")))
    said = {c: F.when(F.col("n") % 31 == 0, "x").otherwise(F.col(c)) if c == "object_id" else F.col(c) for c in FIELDS}
    key = F.when(F.col("n") % 43 == 0, "SX").otherwise(F.col("credential_fingerprint"))
    body = F.struct(F.lit("authority-transaction/v2").alias("schema"), F.col("event_sequence").alias("event_sequence"), *[c.alias(n) for n, c in said.items()], key.alias("actor_key_fingerprint"), F.struct(F.lit(1).alias("v")).alias("data"))
    details = F.struct(body.alias("authority_transaction"), F.when(F.col("n") % 47 != 0, "sig").alias("authority_signature"))
    return e.withColumn("details_json", F.to_json(details)).drop("n")


@query(f"""
WITH {LEDGER}
SELECT project_id AS target, 'envelope' AS rule, CAST(seq AS VARCHAR) AS key, 'object_id' AS "column", object_id AS expected, 'x' AS actual FROM led WHERE event_id % 31 = 0
UNION ALL SELECT project_id, 'envelope', CAST(seq AS VARCHAR), 'actor_key_fingerprint', 'S' || seq % 5, 'SX' FROM led WHERE event_id % 43 = 0
UNION ALL SELECT project_id, 'malformed-envelope', CAST(seq AS VARCHAR), NULL, NULL, NULL FROM led WHERE event_id % 47 = 0
""")
def verify_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.verify_envelopes(signed_ledger(spark, sf_dir))


@query(f"""
WITH {LEDGER}
SELECT project_id AS target, 'unknown-signer' AS rule, CAST(seq AS VARCHAR) AS key FROM led WHERE NOT (seq % 5 = 1 AND seq < 20 OR seq % 5 = 2 AND seq >= 20 OR seq % 5 = 3)
""")
def verify_signers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each operator has a key until event 20, one from there on, and one throughout; key S4 and S0 are not known."""
    led = signed_ledger(spark, sf_dir)
    who = led.select("project_id", F.col("actor_id").alias("operator_id")).distinct()
    keys = union_all([who.select("*", F.lit(f).alias("signing_fingerprint"), F.lit(a).cast("long").alias("valid_from_sequence"), F.lit(b).cast("long").alias("valid_until_sequence")) for f, a, b in (("S1", 1, 20), ("S2", 20, None), ("S3", 1, None))])
    return V.verify_signers(led, keys).select("target", "rule", "key")


@query("""
WITH c AS (SELECT conv_id AS n, turn, min(role) AS role FROM conversations GROUP BY conv_id, turn), m AS (SELECT n, max(turn) + 1 AS latest FROM c GROUP BY n)
SELECT 'notes' AS target, 'changed' AS rule, 'P/NOTE-' || n AS key FROM m WHERE n % 7 = 0
UNION ALL SELECT 'notes', 'latest-pointer', 'NOTE-' || n FROM m WHERE n % 7 = 0
UNION ALL SELECT 'note_revisions', 'missing', 'P/NOTE-' || n || '/1' FROM c WHERE n % 11 = 0 AND turn = 0
UNION ALL SELECT 'notes', 'revision-gap', 'NOTE-' || n FROM m WHERE n % 11 = 0 AND latest > 1
UNION ALL SELECT 'notes', 'latest-pointer', 'NOTE-' || n FROM m WHERE n % 11 = 0 AND n % 7 <> 0 AND latest = 1
UNION ALL SELECT 'note_revisions', 'unknown-file', 'NOTE-' || n || '/' || turn + 1 FROM c WHERE n % 13 = 0 AND NOT (n % 11 = 0 AND turn = 0)
UNION ALL SELECT 'note_revisions', 'revision-digest', 'NOTE-' || n || '/' || turn + 1 FROM c WHERE n % 13 <> 0 AND n % 17 = 0 AND NOT (n % 11 = 0 AND turn = 0)
UNION ALL SELECT 'note_revisions', 'revision-class', 'NOTE-' || n || '/' || turn + 1 FROM c WHERE n % 13 <> 0 AND n % 19 = 0 AND NOT (n % 11 = 0 AND turn = 0)
""")
def verify_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with a wrong pointer, revisions that are lost, and their files lost, changed or of another class."""
    led = note_events(spark, sf_dir)
    # What a revision's payload hashed to is signed with it.
    said = F.sha2(F.get_json_object("details_json", "$.authority_transaction.data.file_id"), 256)
    with_digest = F.regexp_replace("details_json", r'"file_id":', F.concat(F.lit('"payload_digest":"'), said, F.lit('","file_id":')))
    led = led.withColumn("details_json", F.when(said.isNotNull(), with_digest).otherwise(F.col("details_json")))
    specs = R.projections()
    n = number("note_id")
    notes = R.project(led, specs["notes"]).withColumn("latest_revision", F.when(n % 7 == 0, "99").otherwise(F.col("latest_revision")))
    every = R.project(led, specs["note_revisions"])
    revisions = every.filter(~((n % 11 == 0) & (F.col("revision") == "1")))
    kind = F.when(n % 19 == 0, "other").when(n % 3 == 0, "confidential-note-revision").otherwise("note-revision")
    held = every.filter(n % 13 != 0).select("file_id", kind.alias("classification"), F.when(n % 17 == 0, "x").otherwise(F.sha2("file_id", 256)).alias("content_digest"))
    return V.verify_notes(led, notes, revisions, held).select("target", "rule", "key")


def live_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """History, catalogue, payloads and the list of those that may be missing: payloads lost, changed, cut and open to writing."""
    led = file_events(spark, sf_dir)
    held = R.project(led, R.projections()["files"])
    n = number("file_id")
    live = held.withColumn("media_type", F.when(n % 29 == 0, "x").otherwise(F.col("media_type")))
    payloads = held.filter(n % 23 != 0).select("storage_path", F.when(n % 17 == 0, "x").otherwise(F.col("content_digest")).alias("content_digest"), (F.col("size_bytes").cast("long") - F.when(n % 19 == 0, 1).otherwise(0)).alias("size_bytes"), (n % 21 == 0).alias("writable"))
    return led, live, payloads, held.filter(n % 46 == 0).select("storage_path")


LIVE = """
bad AS (
  SELECT doc_id AS n, 'changed' AS rule, 'P/FILE-' || doc_id AS key FROM documents WHERE doc_id % 29 = 0
  UNION ALL SELECT doc_id, 'missing-payload', 'FILE-' || doc_id FROM documents WHERE doc_id % 23 = 0 AND doc_id % 46 <> 0
  UNION ALL SELECT doc_id, 'payload-digest', 'FILE-' || doc_id FROM documents WHERE doc_id % 23 <> 0 AND doc_id % 17 = 0
  UNION ALL SELECT doc_id, 'payload-size', 'FILE-' || doc_id FROM documents WHERE doc_id % 23 <> 0 AND doc_id % 19 = 0
  UNION ALL SELECT doc_id, 'writable-payload', 'FILE-' || doc_id FROM documents WHERE doc_id % 23 <> 0 AND doc_id % 21 = 0
)"""


@query(f"WITH {LIVE} SELECT 'files' AS target, rule, key FROM bad WHERE rule = 'changed' OR n % 2 = 0")
def verify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue against its history, and files of even numbers against their payloads."""
    led, live, payloads, allowed = live_files(spark, sf_dir)
    return V.verify_files(led, live, payloads, allowed, live.filter(number("file_id") % 2 == 0)).select("target", "rule", "key")


@query(f"""
WITH RECURSIVE {LIVE}, own AS (SELECT doc_id, count(rule) AS k FROM documents LEFT JOIN bad ON n = doc_id GROUP BY doc_id),
below AS (SELECT doc_id AS root, doc_id AS n FROM documents WHERE doc_id % 2 = 1 UNION SELECT root, doc_id FROM below JOIN documents ON doc_id = n * 2),
f AS (SELECT 'case' AS scope_type, source AS scope_id, doc_id FROM documents UNION ALL SELECT 'file', 'FILE-' || doc_id, doc_id FROM documents UNION ALL SELECT 'artefact', 'ART-' || root, n FROM below
  UNION ALL SELECT DISTINCT 'note', 'NOTE-' || conv_id, conv_id * 3 + turn FROM conversations UNION ALL SELECT DISTINCT 'export', 'EXPORT-' || l_suppkey, l_partkey FROM lineitem),
s AS (SELECT scope_type, scope_id, doc_id, k FROM f JOIN own USING (doc_id))
SELECT scope_type, scope_id, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(k) AS BIGINT) AS n_findings, CASE WHEN sum(k) = 0 THEN 'verified' ELSE 'failed' END AS status FROM s GROUP BY scope_type, scope_id
""")
def verify_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, files, artefacts with all that is related below their files, notes and exports, each with the findings about its files."""
    led, live, payloads, allowed = live_files(spark, sf_dir)
    state = scope_tables(spark, sf_dir, live, number("file_id"), lambda n: F.concat(F.lit("FILE-"), n.cast("string")))
    scopes = {"case": "files", "file": "files", "artefact": "artefact_files", "note": "note_revisions", "export": "export_items"}
    targets = union_all([state[t].select(F.lit(s).alias("scope_type"), F.col(f"{s}_id").alias("scope_id")).distinct() for s, t in scopes.items()])
    return V.verify_object(targets, led, state, payloads, allowed)[0]


@query(f"""
WITH {FILES}, held AS (SELECT content_digest, size_bytes, count(*) AS k, count(*) FILTER (WHERE doc_id % 23 = 0 OR doc_id % 17 = 0 OR doc_id % 19 = 0) AS bad FROM fil GROUP BY ALL),
p AS (SELECT 'B-' || item_id AS probe_id, sha256(text) AS content_digest, octet_length(encode(text)) AS size_bytes FROM benchmark UNION ALL SELECT 'D-' || doc_id, content_digest, size_bytes FROM fil)
SELECT probe_id, CAST(coalesce(k, 0) AS BIGINT) AS n_matches, CAST(coalesce(bad, 0) AS BIGINT) AS n_broken, CASE WHEN k IS NULL THEN 'unmatched' WHEN bad = 0 THEN 'verified' ELSE 'failed' END AS status FROM p LEFT JOIN held USING (content_digest, size_bytes)
""")
def verify_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and all documents from outside: how many files they equal, and how many of those are no longer what they were."""
    _, live, payloads, _ = live_files(spark, sf_dir)
    live = live.withColumn("size_bytes", F.col("size_bytes").cast("long"))
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("B-"), text("item_id")).alias("probe_id"), F.sha2("text", 256).alias("content_digest"), F.octet_length("text").cast("long").alias("size_bytes"))
    probe = b.unionByName(live.select(F.concat(F.lit("D-"), number("file_id").cast("string")).alias("probe_id"), "content_digest", "size_bytes"))
    return V.verify_external(probe, live, payloads)[0]


@query("""
WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders), x AS (
  SELECT 'exports' AS target, 'incomplete-export' AS rule, CAST(k AS VARCHAR) AS key FROM o WHERE k % 23 = 0
  UNION ALL SELECT 'exports', 'manifest-digest', CAST(k AS VARCHAR) FROM o WHERE k % 23 <> 0 AND k % 29 = 0
  UNION ALL SELECT 'exports', 'output-digest', CAST(k AS VARCHAR) FROM o WHERE k % 23 <> 0 AND k % 31 = 0
  UNION ALL SELECT 'exports', 'unanchored', CAST(k AS VARCHAR) FROM o WHERE k % 37 = 0
  UNION ALL SELECT DISTINCT 'exports', 'derived-but-equal', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 4 AND l_orderkey % 53 = 0 AND l_orderkey % 59 <> 0
  UNION ALL SELECT DISTINCT 'exports', 'native-but-changed', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 4 AND l_orderkey % 59 = 0 AND l_orderkey % 53 <> 0 AND l_orderkey % 61 <> 0
  UNION ALL SELECT DISTINCT 'exports', 'unknown-mode', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 4 AND l_orderkey % 61 = 0 AND l_orderkey % 53 <> 0
  UNION ALL SELECT DISTINCT 'export-items', 'missing', l_orderkey || '/p' || l_linenumber FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 41 = 0
  UNION ALL SELECT DISTINCT 'export-items', 'changed', l_orderkey || '/p' || l_linenumber FROM lineitem WHERE l_linenumber = 2 AND l_orderkey % 43 = 0
  UNION ALL SELECT DISTINCT 'export-bytes', 'missing', l_orderkey || '/p' || l_linenumber FROM lineitem WHERE l_linenumber = 3 AND l_orderkey % 47 = 0
  UNION ALL SELECT DISTINCT 'export-bytes', 'extra', l_orderkey || '/p' || l_linenumber FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 41 = 0
)
SELECT * FROM x
""")
def verify_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as exports of their lines: unfinished ones, wrong digests of manifest or output, anchors that history lacks,
    items left out of the manifest or changed, files lost; derived items that equal their source, native ones that do not, modes
    that are none."""
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select("o_orderkey").distinct().select(text("o_orderkey").alias("export_id"), "o_orderkey", F.lit("P").alias("project_id"), k.alias("event_count"), F.when(k % 37 == 0, "x").otherwise(F.concat(F.lit("h"), text("o_orderkey"))).alias("chain_head"), F.when(k % 29 == 0, "x").otherwise("m").alias("manifest_digest"), F.when(k % 31 == 0, "x").otherwise("o").alias("output_digest"))
    e = written(e, "manifests")
    history = e.select("project_id", F.col("event_count").alias("event_sequence"), F.concat(F.lit("h"), "export_id").alias("event_hash"))
    exports = e.select("export_id", F.when(k % 23 == 0, "failed").otherwise("completed").alias("state"), F.lit("m").alias("manifest_digest"), F.lit("o").alias("output_digest"))
    n, line = F.col("l_orderkey"), F.col("l_linenumber")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().select("l_orderkey", "l_linenumber", text("l_orderkey").alias("export_id"), F.concat(F.lit("p"), text("l_linenumber")).alias("output_path"), F.lit("f").alias("file_id"), F.lit("s").alias("source_digest"), F.when((line == 4) & (n % 59 == 0), "z").otherwise("s").alias("output_digest"), F.when((line == 4) & (n % 53 == 0), "derived").when((line == 4) & (n % 61 == 0), "exact").otherwise("native").alias("mode"))
    items = written(items, "items")
    said = items.filter(~((line == 1) & (n % 41 == 0))).withColumn("file_id", F.when((line == 2) & (n % 43 == 0), "g").otherwise("f"))
    seen = items.filter(~((line == 3) & (n % 47 == 0))).select("export_id", "output_path", F.col("output_digest").alias("content_digest"))
    return V.verify_exports(e, said, items, seen, history, exports).select("target", "rule", "key")


@query(f"""
WITH {LEDGER}, now AS (SELECT project_id, user_id, count(*) AS n FROM led GROUP BY ALL)
SELECT project_id, CASE user_id % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'stale' ELSE 'current' END AS status FROM now
""")
def checkpoint_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects whose last checkpoint is absent, older than the ledger, or current (beside an older one)."""
    now = C.ledger_summary(ledger(spark, sf_dir), head="object_id").withColumn("state_digest", F.sha2("chain_head", 256))
    user = number("project_id")
    old = now.filter(user % 4 != 0).withColumn("event_count", F.col("event_count") - 1)
    return C.checkpoint_status(old.unionByName(now.filter(user % 4 > 1)), now)


@query("""
SELECT 'files' AS target, 'missing' AS rule, CAST(doc_id AS VARCHAR) AS key, NULL AS "column" FROM documents WHERE doc_id % 33 = 0
UNION ALL SELECT 'files', 'changed', CAST(doc_id AS VARCHAR), 'lang' FROM documents WHERE doc_id % 33 <> 0 AND doc_id % 27 = 0
UNION ALL SELECT 'parts', 'changed', CAST(p_partkey AS VARCHAR), 'p_size' FROM part WHERE p_partkey % 50 = 0
""")
def verify_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables and a copy of them in which rows are lost and changed."""
    d, p = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    copy = {"files": d.filter("doc_id % 33 <> 0").withColumn("lang", F.when(F.col("doc_id") % 27 == 0, None).otherwise(F.col("lang"))), "parts": p.withColumn("p_size", F.when(F.col("p_partkey") % 50 == 0, -1).otherwise(F.col("p_size")))}
    return V.verify_snapshot({"files": d, "parts": p}, copy, {"files": ["doc_id"], "parts": ["p_partkey"]}).select("target", "rule", "key", "column")


@query("""
SELECT 'config' AS target, 'changed' AS rule, printf('P-%03d', n_nationkey) AS key, 'content_hash' AS "column" FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'metadata', 'missing', printf('P-%03d', n_nationkey), NULL FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT 'flag', 'authority-flag', printf('P-%03d', n_nationkey), 'authority_state' FROM nation WHERE n_nationkey % 5 = 0
""")
def verify_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash policies that differ from those of the first event, and projects whose flag denies their signed events."""
    nation = table(spark, sf_dir, "nation").withColumn("project_id", F.format_string("P-%03d", "n_nationkey"))
    first = nation.select("project_id", F.lit(1).alias("event_sequence"), F.lit("PROJECT_GENESIS").alias("event_type"), F.lit('{"integrity":{"chain_hash":"sha256","content_hash":"sha512"}}').alias("details_json"))
    said = nation.select("project_id", "n_nationkey", F.lit("sha256").alias("chain_hash"), F.lit("sha512").alias("content_hash"))
    config = said.withColumn("content_hash", F.when(F.col("n_nationkey") % 3 == 0, "sha256").otherwise(F.col("content_hash")))
    flags = nation.select("project_id", F.when(F.col("n_nationkey") % 5 == 0, "absent").otherwise("active").alias("authority_state"))
    found = V.verify_policy(config, said.filter("n_nationkey % 4 <> 0"), first).unionByName(V.verify_authority_flag(flags, policy_events(spark, sf_dir)).withColumn("target", F.lit("flag")))
    return found.select("target", "rule", "key", "column")


@query("""
SELECT 'config' AS target, 'changed' AS rule, CAST(c_custkey AS VARCHAR) AS key, 'content_hash' AS "column", 'sha512' AS expected, 'sha256' AS actual FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'config', 'changed', CAST(c_custkey AS VARCHAR), 'chain_hash', 'sha256', NULL FROM customer WHERE c_custkey % 8 = 0
UNION ALL SELECT 'metadata', 'missing', CAST(c_custkey AS VARCHAR), NULL, NULL, NULL FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'metadata', 'extra', 'X' || s_suppkey, NULL, NULL, NULL FROM supplier
""")
def verify_policy_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each customer: hash policies of the configuration that are others or none, metadata that is lost, and
    metadata of projects that never were."""
    c, n = table(spark, sf_dir, "customer").withColumn("project_id", text("c_custkey")), F.col("c_custkey")
    first = c.select("project_id", F.lit(1).alias("event_sequence"), F.lit("PROJECT_GENESIS").alias("event_type"), F.lit('{"integrity":{"chain_hash":"sha256","content_hash":"sha512"}}').alias("details_json"))
    config = c.select("project_id", F.when(n % 8 != 0, "sha256").alias("chain_hash"), F.when(n % 3 == 0, "sha256").otherwise("sha512").alias("content_hash"))
    policy = [F.lit("sha256").alias("chain_hash"), F.lit("sha512").alias("content_hash")]
    strange = table(spark, sf_dir, "supplier").select(F.concat(F.lit("X"), text("s_suppkey")).alias("project_id"), *policy)
    return V.verify_policy(config, c.filter(n % 4 != 0).select("project_id", *policy).unionByName(strange), first)


@query("""
WITH n AS (SELECT DISTINCT conv_id AS n FROM conversations WHERE conv_id % 6 = 0 AND conv_id % 10 <> 0)
SELECT 'P' AS target, 'transfer-source' AS rule, 'NOTE-' || n AS key, 'A' || n % 7 AS expected, 'Z' AS actual FROM n WHERE n % 9 = 0
""")
def verify_transfer_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted transfers that name a source which had no authority over the note."""
    led = note_events(spark, sf_dir)
    lie = F.col("event_type").endswith("PROPOSED") & (number("object_id") % 9 == 0)
    led = led.withColumn("details_json", F.when(lie, F.regexp_replace("details_json", '"from_operator_id":"A[0-9]"', '"from_operator_id":"Z"')).otherwise(F.col("details_json")))
    return V.verify_transfer_source(led).select("target", "rule", "key", "expected", "actual")


@query("""
SELECT 'identity' AS target, 'changed' AS rule, CAST(c_custkey AS VARCHAR) AS key, 'role_label' AS "column" FROM customer WHERE c_custkey % 9 = 0 AND c_custkey % 10 <> 0
UNION ALL SELECT 'identity', 'changed', CAST(c_custkey AS VARCHAR), 'signing_fingerprint' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 10 <> 0
UNION ALL SELECT 'identity', 'extra', CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE 1 = 0
UNION ALL SELECT 'identity', 'missing', CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE c_custkey % 10 = 0
""")
def verify_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' identities in requests: another role or key than was kept, and customers that were not kept at all."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    own = {"operator_id": k, "name": F.col("c_name"), "public_contact": F.lit(None).cast("string"), "organisation": text("c_nationkey"), "role_label": F.col("c_mktsegment")}
    keys = c.select(k.alias("operator_id"), F.concat(F.lit("F"), text("c_custkey")).alias("primary_fingerprint"), F.concat(F.lit("S"), text("c_custkey")).alias("signing_fingerprint"), F.lit("active").alias("state"))
    asked = c.select(*[e.alias(n) for n, e in own.items()]).join(keys.drop("state"), "operator_id").withColumns({"role_label": F.when(F.col("operator_id") % 9 == 0, "x").otherwise(F.col("role_label")), "signing_fingerprint": F.when(F.col("operator_id") % 7 == 0, "x").otherwise(F.col("signing_fingerprint"))})
    return V.verify_identity(asked, c.filter(k % 10 != 0).select(*[e.alias(n) for n, e in own.items()]), keys).select("target", "rule", "key", "column")


@query("""
WITH e AS (SELECT vec_id AS n, embedding[1] AS x, embedding[2] AS y, embedding[3] AS w, embedding[4] AS h FROM embeddings)
SELECT CAST(n AS VARCHAR) AS key, 'review-geometry' AS rule FROM e WHERE NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w > 0 AND h > 0 AND CAST(x AS DOUBLE) + w <= 1 AND CAST(y AS DOUBLE) + h <= 1)
UNION ALL SELECT CAST(n AS VARCHAR), 'review-dimensions' FROM e WHERE n % 6 = 0
UNION ALL SELECT CAST(n AS VARCHAR), 'review-reason' FROM e WHERE n % 5 = 0
UNION ALL SELECT CAST(n AS VARCHAR), 'review-digest' FROM e WHERE n % 4 = 0
""")
def verify_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four numbers of embeddings as boxes of redactions."""
    e, n, at = table(spark, sf_dir, "embeddings"), F.col("vec_id"), lambda i: F.get("embedding", F.lit(i)).cast("double")
    box = F.create_map(F.lit("x"), at(0), F.lit("y"), at(1), F.lit("width"), at(2), F.lit("height"), at(3))
    layers = e.select(F.when(n % 4 == 0, "zz").otherwise(F.sha2(text("vec_id"), 256)).alias("original_sha256"), F.lit(10).alias("original_width"), F.when(n % 6 == 0, 0).otherwise(10).alias("original_height"), F.lit("redaction").alias("layer"), text("vec_id").alias("id"), F.lit("box").alias("kind"), F.when(n % 5 == 0, " ").otherwise("r").alias("reason"), box.alias("geometry"))
    return V.verify_reviews(layers).select("key", "rule")


# Decisions and check-in


@query("""
WITH req AS (SELECT o_orderkey AS request_id, c_nationkey AS p, o_custkey % 40 AS who, o_orderkey % 3 AS s, o_orderkey % 2 = 0 AS decrypt FROM orders JOIN customer ON o_custkey = c_custkey),
it AS (SELECT DISTINCT l_orderkey AS request_id, l_linenumber % 4 = 0 AS secret, l_linenumber % 8 = 0 AS loose, l_partkey % 50 AS note FROM lineitem),
k AS (SELECT request_id, bool_or(secret) AS secret, bool_or(secret AND loose) AS loose FROM it GROUP BY request_id),
r AS (SELECT req.*, k.secret, k.loose, who % 7 <> 3 AS member,
        who % 7 <> 3 AND (who = p OR CASE WHEN s = 0 THEN p % 2 = 0 ELSE true END) AS ordinary, who % 7 <> 3 AND (who = p OR CASE WHEN s = 0 THEN p % 2 = 0 ELSE p % 3 = 0 END) AS cipher,
        (SELECT bool_and(who % 7 <> 3 AND (who = p OR who = it.note % 40)) FROM it WHERE it.request_id = req.request_id AND it.secret AND NOT it.loose) AS plain FROM req LEFT JOIN k USING (request_id))
SELECT request_id, array_to_string(list_filter([CASE WHEN secret AND NOT decrypt AND NOT cipher THEN 'ciphertext' END, CASE WHEN secret IS NULL THEN 'no-files' END, CASE WHEN loose AND decrypt THEN 'no-note' END,
       CASE WHEN NOT ordinary THEN 'ordinary' END, CASE WHEN decrypt AND NOT coalesce(plain, true) THEN 'plaintext' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r
""")
def decide_export_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as export requests of their lines: some lines are confidential notes, some confidential files of no note."""
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("project_id"))
    k = F.col("o_orderkey")
    requests = table(spark, sf_dir, "orders").join(who, "o_custkey").select(k.alias("request_id"), "project_id", (F.col("o_custkey") % 40).alias("operator_id"), F.when(k % 3 == 0, "case").otherwise("file").alias("scope_type"), (k % 2 == 0).alias("decrypt"))
    secret = F.col("l_linenumber") % 4 == 0
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.concat_ws("-", text("l_partkey"), text("l_linenumber")).alias("file_id"), F.when(secret, "confidential-note-revision").otherwise("text").alias("classification"), F.when(secret & (F.col("l_linenumber") % 8 != 0), F.col("l_partkey") % 50).alias("note_id"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"))
    says = lambda rule: F.when(rule, "members").otherwise("owner")
    policy = nation.select("project_id", F.lit("members").alias("ordinary_export"), says(F.col("project_id") % 3 == 0).alias("ciphertext_export"), says(F.col("project_id") % 2 == 0).alias("broad_scope_export"), F.lit("authority").alias("confidential_plaintext_export"))
    authority = spark.range(50).select(F.col("id").alias("object_id"), (F.col("id") % 40).alias("authority_id"))
    members = requests.select("project_id", "operator_id").distinct().filter("operator_id % 7 <> 3").withColumn("state", F.lit("active"))
    out = D.decide_export_full(requests, items, policy, nation.withColumn("owner_id", F.col("project_id")), authority, members)
    return out.select("request_id", F.array_join("reasons", ",").alias("reasons"))


@query("""
WITH p AS (SELECT c_custkey AS k, c_nationkey AS project_id, c_custkey % 5 <> 4 AS active, NOT (c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0) AS same FROM customer),
r AS (SELECT o_orderkey AS request_id, k, project_id, active AND same AS known, o_orderkey % 3 = 0 AS secret, o_orderkey % 2 = 0 AS decrypt, k % 2 = 0 AS is_owner FROM orders JOIN p ON o_custkey = k)
SELECT request_id, concat_ws(',', CASE WHEN secret AND NOT decrypt AND NOT known THEN 'ciphertext' END, CASE WHEN NOT known THEN 'ordinary' END, CASE WHEN secret AND decrypt AND NOT known THEN 'plaintext' END) AS reasons FROM r
""")
def decide_export_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as export requests by customers, each in a project of its own: some are no longer members, some give another
    role or key than is kept, some have no active key."""
    c, n, k = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("o_orderkey")
    own = {"project_id": text("c_custkey"), "operator_id": text("c_custkey"), "name": F.col("c_name"), "public_contact": F.lit(None).cast("string"), "organisation": text("c_nationkey"), "role_label": F.col("c_mktsegment")}
    operators = c.select(*[e.alias(x) for x, e in own.items()])
    keys = c.select(*[own[x].alias(x) for x in ("project_id", "operator_id")], F.concat(F.lit("F"), text("c_custkey")).alias("primary_fingerprint"), F.concat(F.lit("S"), text("c_custkey")).alias("signing_fingerprint"), F.when(n % 13 == 0, "retired").otherwise("active").alias("state"))
    said = operators.join(keys.drop("state"), ["project_id", "operator_id"]).withColumns({"role_label": F.when(F.col("operator_id").cast("long") % 7 == 0, None).otherwise(F.col("role_label")), "signing_fingerprint": F.when(F.col("operator_id").cast("long") % 11 == 0, "x").otherwise(F.col("signing_fingerprint"))})
    requests = table(spark, sf_dir, "orders").select(k.alias("request_id"), text("o_custkey").alias("operator_id"), F.lit("file").alias("scope_type"), (k % 2 == 0).alias("decrypt")).join(said, "operator_id")
    items = table(spark, sf_dir, "orders").select(k.alias("request_id"), F.format_string("FILE-%d", "o_orderkey").alias("file_id"), F.when(k % 3 == 0, "confidential-note-revision").otherwise("text").alias("classification"), F.when(k % 3 == 0, F.format_string("NOTE-%d", "o_orderkey")).alias("note_id"))
    projects = c.select(text("c_custkey").alias("project_id"))
    policy = projects.select("project_id", F.lit("members").alias("ordinary_export"), F.lit("members").alias("ciphertext_export"), F.lit("members").alias("broad_scope_export"), F.lit("owner").alias("confidential_plaintext_export"))
    authority = items.filter("note_id is not null").select(F.col("note_id").alias("object_id"), F.lit("nobody").alias("authority_id"))
    members = c.select(text("c_custkey").alias("project_id"), text("c_custkey").alias("operator_id"), F.when(n % 5 == 4, "removed").otherwise("active").alias("state"))
    out = D.decide_export_full(requests, items, policy, projects.withColumn("owner_id", F.col("project_id")), authority, members, D.kept_identities(operators, keys))
    return out.select("request_id", F.array_join("reasons", ",").alias("reasons"))


@query("""
WITH c AS (SELECT DISTINCT conv_id AS n FROM conversations)
SELECT 'B' AS operator_id, 'note' AS object_type, 'NOTE-' || n AS object_id, 'authority' AS action FROM c
UNION ALL SELECT 'A' || n % 7, 'note', 'NOTE-' || n, 'revoke' FROM c WHERE n % 4 = 0
UNION ALL SELECT 'B', 'note', 'NOTE-' || n, 'grant' FROM c WHERE n % 18 <> 0
""")
def transfer_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidential transfers of notes to B: old grants of even notes are open, some new ones too."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    note, author = F.format_string("NOTE-%d", "conv_id"), F.format_string("A%d", F.col("conv_id") % 7)
    moved = c.select(author.alias("from_operator_id"), F.lit("B").alias("to_operator_id"), F.array(F.struct(F.lit("note").alias("object_type"), note.alias("object_id"))).alias("scope"))
    shape = [F.lit("note").alias("object_type"), note.alias("object_id"), F.lit("object-owner").alias("authority_basis"), F.lit(1).alias("granted_sequence")]
    held = c.select(author.alias("operator_id"), *shape, F.when(F.col("conv_id") % 4 != 0, 2).alias("revoked_sequence")).unionByName(c.filter("conv_id % 18 = 0").select(F.lit("B").alias("operator_id"), *shape, F.lit(None).cast("int").alias("revoked_sequence")))
    return D.transfer_effects(moved, held)


@query("""
WITH n AS (SELECT conv_id, max(turn) + 1 AS latest FROM (SELECT DISTINCT conv_id, turn FROM conversations) t GROUP BY conv_id)
SELECT 'NOTE-' || conv_id AS note_id, 'FILE-' || conv_id || '-' || latest - 1 AS file_id, 'A' || conv_id % 7 || CASE WHEN conv_id % 7 <> 3 THEN ',A3' ELSE '' END AS recipients, latest + 1 AS next_revision FROM n WHERE conv_id % 3 = 0
""")
def reencrypt_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidential notes at their latest revision, for their authority and for A3, who owns the project."""
    led = note_events(spark, sf_dir).filter("event_type like 'NOTE%'")
    specs = R.projections()
    owners = spark.range(1).select(F.lit("P").alias("project_id"), F.lit("A3").alias("owner_id"))
    authority = R.confidential_authority(led).select(F.col("object_id").alias("note_id"), "authority_id")
    return D.reencrypt_worklist(R.project(led, specs["notes"]), R.project(led, specs["note_revisions"]), authority, owners).withColumn("recipients", F.array_join("recipients", ","))


@query("""
SELECT o_orderkey, CASE WHEN c_nationkey % 5 = o_custkey % 5 THEN 'approved' ELSE 'pending' END AS status FROM orders JOIN customer ON o_custkey = c_custkey
""")
def submission_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders submitted for nations: those of the owner are approved at once."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("scope_id"))
    asked = table(spark, sf_dir, "orders").join(c, "o_custkey").select("o_orderkey", "scope_id", (F.col("o_custkey") % 5).cast("int").alias("submitted_by"))
    owners = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scope_id"), (F.col("n_nationkey") % 5).alias("owner_id"))
    return D.submission_status(asked, owners).select("o_orderkey", "status")


@query("""
WITH n AS (SELECT conv_id, turn FROM (SELECT DISTINCT conv_id, turn FROM conversations) t)
SELECT 'NOTE-' || conv_id AS note_id, CAST(turn + 1 AS VARCHAR) AS revision, 'FILE-' || conv_id || '-' || turn AS file_id FROM n WHERE conv_id % 4 <> 0
""")
def withheld_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision files of notes that are not disclosed."""
    led = note_events(spark, sf_dir)
    specs = R.projections()
    revisions = R.project(led, specs["note_revisions"])
    return D.withheld_payloads(R.project(led, specs["notes"]), revisions, revisions.select("file_id")).select("note_id", "revision", "file_id")


@query("""
WITH g AS (SELECT user_id, event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events WHERE event_type = 'signup')
SELECT e.event_id, g.a AS granted_sequence FROM events e JOIN g ON g.user_id = e.user_id AND g.a <= e.event_id AND (g.b IS NULL OR e.event_id < g.b) WHERE e.event_type = 'view'
UNION ALL SELECT -e.event_id, g.a FROM events e JOIN g ON g.user_id = e.user_id AND g.b IS NULL WHERE e.event_type = 'error'
""")
def grants_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grant (from a signup to the next) that held at each view, and the one that holds now for each error."""
    e = table(spark, sf_dir, "events")
    given = M.intervals(e.filter("event_type = 'signup'").select("user_id", "event_id"), ["user_id"], "event_id").select("user_id", F.col("valid_from").alias("granted_sequence"), F.col("valid_until").alias("revoked_sequence"))
    then = D.grants_at(e.filter("event_type = 'view'").select("event_id", "user_id"), given, ("user_id",), "event_id").select("event_id", "granted_sequence")
    now = D.grants_at(e.filter("event_type = 'error'").select("event_id", "user_id"), given, ("user_id",)).select((-F.col("event_id")).alias("event_id"), "granted_sequence")
    return then.unionByName(now)


@query(f"""
WITH {LEDGER}, h AS (SELECT project_id, user_id, count(*) AS n, arg_max(object_id, seq) AS head FROM led GROUP BY ALL)
SELECT project_id AS target, 'moved-head' AS rule, CAST(CASE WHEN user_id % 3 = 1 THEN n - 1 ELSE n END AS VARCHAR) AS key, CASE WHEN user_id % 3 = 2 THEN 'x' ELSE head END AS expected, head AS actual FROM h WHERE user_id % 3 <> 0
""")
def append_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches made for an older count or for another head than the ledger has."""
    heads = C.ledger_summary(ledger(spark, sf_dir), head="object_id")
    user = number("project_id")
    batch = heads.select("project_id", F.when(user % 3 == 1, F.col("event_count") - 1).otherwise(F.col("event_count")).alias("expected_count"), F.when(user % 3 == 2, "x").otherwise(F.col("chain_head")).alias("expected_head"))
    return C.append_guard(batch, heads).select("target", "rule", "key", "expected", "actual")


@query("""
SELECT 'unknown-child' AS rule, 'd/' || doc_id * 2 AS key FROM documents WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'edge', doc_id || '>' || doc_id * 2 FROM documents WHERE doc_id * 2 IN (SELECT doc_id FROM documents)
""")
def relate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships by path: from each document to that of twice its number, which may not have been committed."""
    d, path = table(spark, sf_dir, "documents"), lambda c: F.concat(F.lit("d/"), c.cast("string"))
    held = d.select(path(F.col("doc_id")).alias("logical_path"), text("doc_id").alias("file_id"))
    ends, found = B.relate(held, d.select(path(F.col("doc_id")).alias("parent_path"), path(F.col("doc_id") * 2).alias("child_path")))
    edges = ends.filter("parent_file_id is not null and child_file_id is not null").select(F.lit("edge").alias("rule"), F.concat_ws(">", "parent_file_id", "child_file_id").alias("key"))
    return found.select("rule", "key").unionByName(edges)


@query("""
WITH d AS (SELECT doc_id, source, CASE doc_id % 7 WHEN 0 THEN '.part' WHEN 1 THEN '.txt.tmp' WHEN 2 THEN '.json' ELSE '.txt' END AS ext FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND ext <> '.json' THEN 'unregistered' ELSE 'kept' END AS status FROM d WHERE ext NOT IN ('.part', '.txt.tmp')
""")
def build_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found in batches: those still being written are skipped; every fifth is not registered, which only JSON may be."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    ext = F.when(n % 7 == 0, ".part").when(n % 7 == 1, ".txt.tmp").when(n % 7 == 2, ".json").otherwise(".txt")
    found = d.select(F.col("source").alias("batch_id"), F.when(ext == ".json", F.lit("core.json")).otherwise(F.concat(text("doc_id"), ext)).alias("logical_path"), "doc_id")
    kept, left = B.build_candidates(found, found.filter("doc_id % 5 <> 0"), ("core.json",))
    return kept.select("doc_id", F.lit("kept").alias("status")).unionByName(left.select(F.regexp_extract("key", "^([0-9]+)", 1).cast("long").alias("doc_id"), F.lit("unregistered").alias("status")))


@query("""
WITH r AS (SELECT source, doc_id, lang FROM documents)
SELECT source AS batch_id, lang AS role, string_agg('F' || printf('%07d', doc_id), ',' ORDER BY doc_id) AS file_ids, 'ARTEFACT-' || printf('%06d', row_number() OVER (ORDER BY source, lang)) AS artefact_id FROM r GROUP BY source, lang
""")
def group_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artefact for each language of a source, with its documents."""
    f = table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id"), F.col("lang").alias("role"), F.format_string("F%07d", "doc_id").alias("file_id"), F.format_string("%07d", "doc_id").alias("logical_path"))
    counters = spark.range(1).select(F.lit("artefact").alias("namespace"), F.lit("ARTEFACT").alias("prefix"), F.lit(1).alias("next_value"))
    return B.group_artefacts(f, counters).withColumn("file_ids", F.array_join("file_ids", ",")).select("batch_id", "role", "file_ids", "artefact_id")


@query("""
SELECT source AS batch_id, string_agg('F' || printf('%07d', doc_id), ',' ORDER BY doc_id) AS file_ids, 'x=' || source || ';y=' || CASE WHEN length(source) % 2 = 0 THEN 'result' ELSE 'default' END AS record FROM documents GROUP BY source
""")
def record_acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents in order, with a record merged from defaults, the source and a result."""
    f = table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id"), F.format_string("F%07d", "doc_id").alias("file_id"))
    b = f.select("batch_id").distinct().select("batch_id", F.create_map(F.lit("x"), F.lit("default"), F.lit("y"), F.lit("default")).alias("defaults"), F.create_map(F.lit("x"), F.col("batch_id")).alias("source"), F.when(F.length("batch_id") % 2 == 0, F.create_map(F.lit("y"), F.lit("result"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("result"))
    out = B.record_acquisition(f, B.provenance_record(b).select("batch_id", "record"))
    return out.select("batch_id", F.array_join("file_ids", ",").alias("file_ids"), F.concat(F.lit("x="), F.col("record")["x"], F.lit(";y="), F.col("record")["y"]).alias("record"))


@query(f"""
WITH {LIVE}, t AS (SELECT doc_id % 9 AS g, doc_id FROM documents), x AS (SELECT g, rule, 'FILE-' || doc_id AS key FROM t JOIN bad ON n = doc_id WHERE rule <> 'changed')
SELECT CAST(g AS VARCHAR) AS target, 'Target: ' || g || chr(10) || 'Status: ' || CASE WHEN count(rule) = 0 THEN 'VERIFIED' ELSE 'FAILED' END || chr(10) || 'Findings: ' || count(rule)
       || coalesce(chr(10) || string_agg('  ' || rule || ' ' || key, chr(10) ORDER BY rule, key), '') AS value FROM (SELECT DISTINCT g FROM t) s LEFT JOIN x USING (g) GROUP BY g
""")
def detailed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text report for each of nine groups of files, with its findings."""
    led, live, payloads, allowed = live_files(spark, sf_dir)
    found = V.verify_files(led, live, payloads, allowed).filter("rule <> 'changed'")
    found = found.withColumns({"target": (number("key") % 9).cast("string"), "column": F.lit(None).cast("string")})
    groups = live.select((number("file_id") % 9).cast("string").alias("g")).distinct()
    return report(summarise_findings(found, groups, "g"), findings=found)


@query(f"""
WITH {LEDGER}, s AS (SELECT project_id, user_id, count(*) AS n, arg_max(object_id, seq) AS head, arg_max(occurred_at, seq) AS t FROM led GROUP BY ALL)
SELECT project_id, '{{"schema":"package/v1","project_id":"' || project_id || '","event_count":' || n || ',"chain_head":"' || head || '","state_digest":"' || sha256(head) || '","state_timestamp":"' || t
       || '","included_roots":["files","cases"],"withheld_file_ids":' || CASE WHEN user_id % 3 = 0 THEN '["A-' || user_id || '","B-' || user_id || '"]' ELSE '[]' END || '}}' AS descriptor FROM s
""")
def package_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = C.ledger_summary(ledger(spark, sf_dir), head="object_id")
    user = number("project_id")
    held = union_all([now.filter(user % 3 == 0).select("project_id", F.concat(F.lit(f"{x}-"), user.cast("string")).alias("file_id")) for x in "BA"])
    return L.package_descriptor(now, now.select("project_id", F.sha2("chain_head", 256).alias("state_digest")), held)


@query(f"WITH {FILES} SELECT file_id, logical_path AS storage_path, content_digest, doc_id % 8 <> 0 AS included FROM fil")
def package_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumnRenamed("logical_path", "storage_path")
    return L.package_inventory(f, f.filter("doc_id % 8 = 0").select("file_id"))


@query("""
WITH t AS (SELECT conv_id, turn, role FROM conversations WHERE turn < 3)
SELECT CAST(conv_id AS VARCHAR) AS request_id, kind AS object_type, id AS object_id FROM (SELECT DISTINCT conv_id, CASE turn WHEN 0 THEN 'note' WHEN 1 THEN 'file' ELSE 'artefact' END AS kind, CASE turn WHEN 0 THEN 'NOTE-' WHEN 1 THEN 'FILE-' ELSE 'ART-' END || conv_id AS id FROM t WHERE conv_id % 4 <> 0) x
UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 'unsupported-object', 'BOX-' || conv_id FROM conversations WHERE conv_id % 4 = 1
UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 'empty-scope', CAST(conv_id AS VARCHAR) FROM conversations WHERE conv_id % 4 = 0
""")
def normalise_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes with doubled tokens, blanks, unknown kinds, and some that are empty."""
    c, n = table(spark, sf_dir, "conversations"), F.col("conv_id")
    token = F.when(F.col("turn") == 0, F.format_string(" NOTE-%d", "conv_id")).when(F.col("turn") == 1, F.format_string("FILE-%d ", "conv_id")).when(F.col("turn") == 2, F.format_string("ART-%d", "conv_id")).otherwise(" ")
    tokens = F.concat(F.collect_list(F.when(n % 4 == 0, " ").otherwise(token)), F.when(n % 4 == 1, F.array(F.format_string("BOX-%d", "conv_id"))).otherwise(F.array(F.lit(""))))
    rows, found = Q.normalise_scope(c.groupBy("conv_id").agg(tokens.alias("tokens")).withColumn("conv_id", text("conv_id")), "conv_id")
    return rows.select(F.col("conv_id").alias("request_id"), "object_type", "object_id").unionByName(found.select(F.col("target").alias("request_id"), F.col("rule").alias("object_type"), F.col("key").alias("object_id")))


@query("""
WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN ' ' ELSE url END AS title, html FROM pages)
SELECT page_id, trim(title) AS title, octet_length(encode(html)) AS n FROM p WHERE page_id % 3 <> 0 AND page_id % 4 <> 0
UNION ALL SELECT page_id, NULL, NULL FROM p WHERE page_id % 3 = 0 OR page_id % 4 = 0
""")
def note_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as note payloads and back; payloads of another schema, or with a number for a title, are no notes."""
    p, n = table(spark, sf_dir, "pages"), F.col("page_id")
    title = F.when(n % 5 == 0, "a").when(n % 5 == 1, " ").otherwise(F.col("url"))
    made = X.note_payload(title, F.col("html"))
    other = X.note_payload(title, F.col("html"), "note-payload/v9")
    payload = F.when(n % 3 == 0, other).when(n % 4 == 0, F.lit('{"body":"b","schema":"note-payload/v1","title":1}')).otherwise(made)
    return p.select("page_id", X.parse_note(payload).alias("x")).select("page_id", F.col("x.title").alias("title"), F.octet_length("x.body").cast("long").alias("n"))


@query("""
WITH n AS (SELECT DISTINCT conv_id AS n FROM conversations)
SELECT 'NOTE-' || n AS key, CASE WHEN n % 5 = 0 THEN 'unknown-subject' ELSE 'other-case' END AS rule FROM n WHERE n % 5 = 0 OR (n % 5 <> 0 AND n % 3 = 1 AND n % 4 <> 0)
UNION ALL SELECT 'FILE-' || n, coalesce(CASE WHEN n % 2 = 0 THEN 'NOTE-' || n END, 'none') FROM n
""")
def note_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on unknown files and on files of another case; and the note of each file that is a revision."""
    c, n = table(spark, sf_dir, "conversations").select("conv_id").distinct(), F.col("conv_id")
    f = c.select(F.format_string("FILE-%d", "conv_id").alias("file_id"), F.when(n % 4 != 0, F.when(n % 3 == 1, "B").otherwise("A")).alias("case_id"))
    notes = c.select(F.format_string("NOTE-%d", "conv_id").alias("note_id"), F.when(n % 5 == 0, "FILE-X").otherwise(F.format_string("FILE-%d", "conv_id")).alias("subject_file_id"), F.lit("A").alias("case_id"))
    revisions = c.filter(n % 2 == 0).select(F.format_string("FILE-%d", "conv_id").alias("file_id"), F.format_string("NOTE-%d", "conv_id").alias("note_id"))
    held = M.file_note(f, revisions).select(F.col("file_id").alias("key"), F.coalesce("note_id", F.lit("none")).alias("rule"))
    return M.cross_scope_subject(notes, f).select("key", "rule").unionByName(held)




@query("""
WITH d AS (SELECT doc_id AS n, source AS b FROM documents)
SELECT b AS target, 'outside-root' AS rule, '../' || n AS key FROM d WHERE n % 15 = 0
UNION ALL SELECT b, 'unknown-parent', 'x' || n || '>' || n FROM d WHERE n % 15 <> 0 AND n % 7 = 0
UNION ALL SELECT b, 'unknown-child', n || '>y' || n FROM d WHERE n % 15 <> 0 AND n % 7 <> 0 AND n % 11 = 0
UNION ALL SELECT b, 'no-label', CASE WHEN n % 7 = 0 THEN 'x' || n ELSE CAST(n AS VARCHAR) END || '>' || CASE WHEN n % 11 = 0 AND n % 7 <> 0 THEN 'y' || n ELSE CAST(n AS VARCHAR) END FROM d WHERE n % 15 <> 0 AND n % 13 = 0
UNION ALL SELECT b, 'label-without-end', n || '>-' FROM d WHERE n % 15 <> 0 AND n % 17 = 0
""")
def complete_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected documents: paths outside the root, relationships with unknown ends or without a label, labels without an end."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    found = d.select(F.col("source").alias("batch_id"), F.when(n % 15 == 0, F.concat(F.lit("../"), text("doc_id"))).otherwise(text("doc_id")).alias("logical_path"))
    rows = d.filter(n % 15 != 0)
    parent = F.when(n % 7 == 0, F.concat(F.lit("x"), text("doc_id"))).otherwise(text("doc_id"))
    child = F.when((n % 11 == 0) & (n % 7 != 0), F.concat(F.lit("y"), text("doc_id"))).otherwise(text("doc_id"))
    edges = rows.select(F.col("source").alias("batch_id"), parent.alias("parent_path"), child.alias("child_path"), F.when(n % 13 == 0, " ").otherwise("r").alias("relationship"))
    loose = rows.filter(n % 17 == 0).select(F.col("source").alias("batch_id"), text("doc_id").alias("parent_path"), F.lit(None).cast("string").alias("child_path"), F.lit("r").alias("relationship"))
    return B.complete_results(found, edges.unionByName(loose)).select("target", "rule", "key")
