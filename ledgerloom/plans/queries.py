"""Registered queries of the ledger operators over the provided tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from ..operators import audit as A
from ..operators import chain as C
from ..operators import checkin as B
from ..operators import decisions as D
from ..operators import matching as M
from ..operators import replay as R
from ..operators import scopes as Q
from ..operators import sets as S
from ..operators import verify as V
from ..operators.findings import summarise_findings
from ..sources import ledger as L
from ..operators.sweeps import SLICE
from ..sources.shared import written
from . import audits, histories, listings, members, payloads, replays, streams, verifiers
from .registry import FILES, LEDGER, ORACLE_SQL, QUERIES, query
from .standins import export_ledger, files, ledger, scope_tables, table

# Chains


@query(f"""
WITH RECURSIVE {LEDGER},
parts AS (
  SELECT project_id, seq, '{{"actor":{{"authority_basis":"system","credential_fingerprint":null,"kind":"system","operator_id":null,"operator_uuid":null}},"details":' || details || ',"event_sequence":' || seq
    || ',"event_type":"' || event_type || '","hash_algorithm":"sha256","object_id":"' || object_id || '","object_type":"event","occurred_at":"' || occurred_at || '","previous_hash":"' AS head FROM led
),
links AS (
  SELECT project_id, seq, sha256(head || repeat('0', 64) || '","schema":"audit-event/v3"}}') AS h FROM parts WHERE seq = 1
  UNION ALL
  SELECT p.project_id, p.seq, sha256(p.head || l.h || '","schema":"audit-event/v3"}}') FROM parts p JOIN links l ON p.project_id = l.project_id AND p.seq = l.seq + 1
)
SELECT project_id, CAST(count(*) AS BIGINT) AS event_count, arg_max(h, seq) AS chain_head FROM links GROUP BY project_id
""")
def chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ledger_summary(C.build_chain(ledger(spark, sf_dir))).drop("last_event_at")


@query("""
WITH RECURSIVE parts AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
links AS (
  SELECT user_id, seq, sha256(repeat('0', 64) || props) AS h FROM parts WHERE seq = 1
  UNION ALL
  SELECT p.user_id, p.seq, sha256(l.h || p.props) FROM parts p JOIN links l ON p.user_id = l.user_id AND p.seq = l.seq + 1
)
SELECT user_id, CAST(count(*) AS BIGINT) AS n, arg_max(h, seq) AS head FROM links GROUP BY user_id
""")
def chain_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fold_chain(table(spark, sf_dir, "events"), "user_id", "event_id", "props")


@query(f"""
WITH {LEDGER},
cut AS (SELECT * FROM led WHERE event_id % 53 <> 0)
SELECT project_id AS target, 'wrong-hash' AS rule, CAST(seq AS VARCHAR) AS key FROM cut WHERE event_id % 97 = 0
UNION ALL
SELECT project_id, 'sequence-gap', CAST(seq AS VARCHAR) FROM cut c WHERE seq > 1 AND NOT EXISTS (SELECT 1 FROM cut d WHERE d.project_id = c.project_id AND d.seq = c.seq - 1)
""")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events removed and details changed in a chained ledger are found, each where it is."""
    chained = C.build_chain(ledger(spark, sf_dir))
    number = F.substring("object_id", 3, 12).cast("long")
    tampered = chained.filter(number % 53 != 0).withColumn("details_json", F.when(number % 97 == 0, '{"k":-1}').otherwise(F.col("details_json")))
    return C.verify_chain(written(tampered, "tampered")).select("target", "rule", "key")


@query(f"""
WITH {LEDGER} SELECT project_id, CAST(count(*) AS BIGINT) AS event_count, arg_max(object_id, seq) AS chain_head, arg_max(occurred_at, seq) AS last_event_at FROM led GROUP BY project_id
""")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ledger_summary(ledger(spark, sf_dir), head="object_id")


@query(f"""
WITH {LEDGER} SELECT project_id, CAST(seq AS BIGINT) AS event_sequence, event_type, lag(event_type) OVER (PARTITION BY project_id ORDER BY seq) AS prev_event_type FROM led
""")
def predecessor_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_predecessor(ledger(spark, sf_dir).select("project_id", "event_sequence", "event_type"), ["event_type"])


@query(f"""
WITH {LEDGER}, cut AS (SELECT project_id, seq FROM led WHERE event_id % 50 <> 0)
SELECT project_id, CAST(seq AS BIGINT) AS event_sequence FROM cut c WHERE seq <> 1 AND NOT EXISTS (SELECT 1 FROM cut d WHERE d.project_id = c.project_id AND d.seq = c.seq - 1)
""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).filter(F.substring("object_id", 3, 12).cast("long") % 50 != 0)
    return C.sequence_gaps(rows.select("project_id", "event_sequence"))


@query(f"""
WITH {LEDGER}, m AS (SELECT project_id, count(*) AS n FROM led GROUP BY project_id),
asked AS (SELECT project_id, n - n % 5 AS event_count FROM m)
SELECT a.project_id, CAST(a.event_count AS BIGINT) AS event_count, CASE WHEN a.event_count = 0 THEN true ELSE a.event_count % 2 = 0 END AS anchored FROM asked a
""")
def anchor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests that name the right hash for even counts, and a wrong one for odd counts."""
    rows = ledger(spark, sf_dir).select("project_id", "event_sequence", F.sha2("object_id", 256).alias("event_hash"))
    n = rows.groupBy("project_id").agg(F.count("*").alias("n")).select("project_id", (F.col("n") - F.col("n") % 5).alias("event_count"))
    at = rows.withColumnRenamed("event_sequence", "event_count")
    named = n.join(at, ["project_id", "event_count"], "left").select("project_id", "event_count", F.when(F.col("event_count") == 0, F.lit("0" * 64)).when(F.col("event_count") % 2 == 0, F.col("event_hash")).otherwise("x").alias("chain_head"))
    return C.anchor_check(named, rows).drop("chain_head")


# Digests and scalar functions


@query(f"WITH {FILES} SELECT file_id, content_digest, CAST(size_bytes AS BIGINT) AS size_bytes FROM fil")
def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(X.format_id("FILE", "doc_id").alias("file_id"), H.digest("text").alias("content_digest"), F.octet_length("text").cast("long").alias("size_bytes"))


@query(f"""
WITH {FILES} SELECT case_id, sha256('[' || string_agg('{{"content_digest":"' || content_digest || '","path":"' || logical_path || '"}}', ',' ORDER BY split(logical_path, '/')) || ']') AS tree_digest FROM fil GROUP BY case_id
""")
def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.tree_digest(files(spark, sf_dir), "case_id", "logical_path", "content_digest")


@query("""
SELECT c_nationkey, sha256(string_agg(c_custkey || ':' || c_name || ':' || c_mktsegment, chr(10) ORDER BY c_mktsegment, c_custkey)) AS lines_digest FROM customer GROUP BY c_nationkey
""")
def lines_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.lines_digest(table(spark, sf_dir, "customer"), "c_nationkey", ["c_mktsegment", "c_custkey"], ["c_custkey", "c_name", "c_mktsegment"])


@query("""
SELECT event_id, '{"k":' || regexp_extract(props, '[0-9]+') || '}' AS canonical, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS occurred_at FROM events
""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", H.native_json("props").alias("canonical"), X.iso_utc("ts").alias("occurred_at"))


@query("""
SELECT page_id, nullif(CASE WHEN lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) LIKE 'm.%' THEN regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1)
       ELSE regexp_extract(split_part(url, '#', 1), '[?&]page=([^&]*)', 1) END, '') AS item_id FROM pages
""")
def url_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the mobile hosts the first part of the path, elsewhere the page parameter."""
    pages = table(spark, sf_dir, "pages")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    mobile = F.get(F.split(F.try_parse_url("url", F.lit("PATH")), "/"), F.lit(1))
    return pages.select("page_id", F.when(host.startswith("m."), F.nullif(mobile, F.lit(""))).otherwise(X.url_item_id("url", ("short.invalid",), "page")).alias("item_id"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN false WHEN doc_id % 4 = 1 THEN false ELSE true END AS safe,
       CASE WHEN doc_id % 4 = 3 THEN 'payload' ELSE CAST(doc_id AS VARCHAR) || '.txt' END AS leaf,
       CASE WHEN doc_id % 4 = 3 THEN 'other' ELSE 'text' END AS class, printf('CASE-%06d', doc_id * 1000) AS case_id FROM documents
""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    which = F.col("doc_id") % 4
    path = F.when(which == 0, F.concat(F.lit("/abs/"), name)).when(which == 1, F.concat(F.lit("a\\..\\"), name)).when(which == 2, F.concat(F.lit(" b/"), name)).otherwise(F.lit("dir/"))
    return d.select("doc_id", path.alias("p")).select("doc_id", X.is_safe_path("p").alias("safe"), X.safe_leaf("p").alias("leaf"), X.classify_suffix("p", {".txt": "text"}, "other").alias("class"), X.format_id("CASE", F.col("doc_id") * 1000).alias("case_id"))


# Joins


@query(f"""
WITH {FILES}, held AS (SELECT content_digest, size_bytes, count(*) AS n FROM fil GROUP BY ALL)
SELECT 'probe' AS kind, file_id AS id, content_digest, n AS n_files, NULL AS artefact_id FROM fil JOIN held USING (content_digest, size_bytes)
UNION ALL SELECT 'probe', 'B-' || item_id, sha256(b.text), coalesce(n, 0), NULL FROM benchmark b LEFT JOIN held h ON h.content_digest = sha256(b.text) AND h.size_bytes = octet_length(encode(b.text))
UNION ALL SELECT 'file', file_id, content_digest, NULL, CASE WHEN doc_id % 2 = 0 THEN 'A-' || doc_id END FROM fil
""")
def content_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and benchmark items against the catalogue: equal bytes are different files, and all of them match. Files of even numbers are in an artefact."""
    known = files(spark, sf_dir)
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("B-"), F.col("item_id").cast("string")).alias("probe_id"), F.sha2("text", 256).alias("content_digest"), F.octet_length("text").cast("long").alias("size_bytes"))
    probe = known.select(F.col("file_id").alias("probe_id"), "content_digest", "size_bytes").unionByName(b)
    members = known.filter("doc_id % 2 = 0").select("file_id", F.concat(F.lit("A-"), F.col("doc_id").cast("string")).alias("artefact_id"))
    found, held = M.match_content(probe, known, members)
    probes = found.select(F.lit("probe").alias("kind"), F.col("probe_id").alias("id"), "content_digest", "n_files", F.lit(None).cast("string").alias("artefact_id"))
    return probes.unionByName(held.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), "content_digest", F.lit(None).cast("long").alias("n_files"), "artefact_id"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def unknown_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.unknown(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), returned, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def known_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.known(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), returned, ["o_orderkey"])


@query(f"""
WITH {FILES}, live AS (SELECT file_id, CASE WHEN doc_id % 11 = 0 THEN upper(lang) ELSE lang END AS lang, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE size_bytes END AS size_bytes FROM fil WHERE doc_id % 17 <> 0
              UNION ALL SELECT 'X-' || item_id, 'en', 1 FROM benchmark),
j AS (SELECT coalesce(a.file_id, b.file_id) AS key, a.file_id AS ak, b.file_id AS bk, a.lang AS al, b.lang AS bl, a.size_bytes AS az, b.size_bytes AS bz FROM fil a FULL JOIN live b ON a.file_id = b.file_id)
SELECT 'files' AS target, 'missing' AS rule, key, NULL AS "column", NULL AS expected, NULL AS actual FROM j WHERE bk IS NULL
UNION ALL SELECT 'files', 'extra', key, NULL, NULL, NULL FROM j WHERE ak IS NULL
UNION ALL SELECT 'files', 'changed', key, 'lang', al, bl FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND al IS DISTINCT FROM bl
UNION ALL SELECT 'files', 'changed', key, 'size_bytes', CAST(az AS VARCHAR), CAST(bz AS VARCHAR) FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND az IS DISTINCT FROM bz
""")
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = files(spark, sf_dir)
    extra = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("X-"), F.col("item_id").cast("string")).alias("file_id"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("size_bytes"))
    live = expected.filter("doc_id % 17 <> 0").select("file_id", F.when(F.col("doc_id") % 11 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 13 != 0, F.col("size_bytes")).alias("size_bytes"))
    return M.diff(expected, live.unionByName(extra), ["file_id"], ["lang", "size_bytes"], "files")


@query("""
SELECT p.event_id, p.user_id, (SELECT arg_max(s.value, s.event_id) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND s.event_id <= p.event_id) AS policy_value
FROM events p WHERE p.event_type = 'purchase'
""")
def asof_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy (a user's last signup) in force at each purchase."""
    e = table(spark, sf_dir, "events")
    policy = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("at"), F.col("value").alias("policy_value"))
    return M.asof_join(e.filter("event_type = 'purchase'").select("event_id", "user_id"), policy, ["user_id"], "event_id", "at", ["policy_value"], width=SLICE)


@query("""
WITH r AS (SELECT user_id, event_id AS valid_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_until, value AS key_value FROM events WHERE event_type = 'signup')
SELECT e.event_id, e.user_id, r.key_value, r.valid_from, r.valid_until FROM events e JOIN r ON e.user_id = r.user_id AND e.event_id >= r.valid_from AND (r.valid_until IS NULL OR e.event_id < r.valid_until)
WHERE e.event_type = 'error'
""")
def interval_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key (from a signup to the user's next) that is valid at each error."""
    e = table(spark, sf_dir, "events")
    keys = M.intervals(e.filter("event_type = 'signup'").select("user_id", "event_id", F.col("value").alias("key_value")), ["user_id"], "event_id").drop("event_id")
    return M.valid_at(e.filter("event_type = 'error'").select("event_id", "user_id"), keys, ["user_id"], "event_id", width=SLICE)


@query("""
SELECT 'R' || n_regionkey AS root, CAST(depth AS INTEGER) AS depth, CAST(count(DISTINCT node) AS BIGINT) AS n_nodes FROM (
  SELECT r_regionkey AS n_regionkey, 0 AS depth, 'R' || r_regionkey AS node FROM region
  UNION ALL SELECT n_regionkey, 1, 'N' || n_nationkey FROM nation
  UNION ALL SELECT n_regionkey, 2, 'C' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 3, 'O' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
) x GROUP BY n_regionkey, depth
""")
def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = lambda n: table(spark, sf_dir, n)
    edges = S.union_all([
        t("nation").select(name("R", "n_regionkey").alias("parent"), name("N", "n_nationkey").alias("child")),
        t("customer").select(name("N", "c_nationkey").alias("parent"), name("C", "c_custkey").alias("child")),
        t("orders").select(name("C", "o_custkey").alias("parent"), name("O", "o_orderkey").alias("child")),
        t("nation").select(name("N", "n_nationkey").alias("parent"), name("R", "n_regionkey").alias("child")),  # a cycle
    ])
    reached = M.descendants(edges, t("region").select(name("R", "r_regionkey").alias("root")))
    return reached.groupBy("root", "depth").agg(F.countDistinct("node").alias("n_nodes"))


# Aggregates and windows


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS members FROM lineitem GROUP BY l_orderkey")
def ordered_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.ordered_members(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("SELECT c_mktsegment, c_nationkey, string_agg(c_name, ',' ORDER BY c_name) AS members FROM (SELECT DISTINCT c_mktsegment, c_nationkey, c_name FROM customer) c GROUP BY ALL")
def concat_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.distinct_in_order(table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_name"), ["c_mktsegment", "c_nationkey", "c_name"], [])
    both = rows.withColumn("g", F.struct("c_mktsegment", "c_nationkey"))
    return S.concat_members(both, "g", "c_name").select("g.*", "members")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""
WITH t AS (SELECT event_id, user_id, event_type AS to_state, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) END AS from_state FROM events)
SELECT * FROM (SELECT *, lag(to_state) OVER (PARTITION BY user_id ORDER BY event_id) AS held FROM t) x WHERE held IS NOT NULL AND held IS DISTINCT FROM from_state
""")
def state_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions that claim another state before them than the one that was."""
    e = C.with_predecessor(ledger(spark, sf_dir), ["event_type"])
    number = F.substring("object_id", 3, 12).cast("long")
    rows = e.select(number.alias("event_id"), F.substring("project_id", 3, 12).cast("long").alias("user_id"), F.lower("event_type").alias("to_state"), F.when(number % 7 == 0, "other").otherwise(F.lower("prev_event_type")).alias("from_state"))
    return S.state_breaks(rows, ["user_id"], "event_id")


@query("""
WITH r AS (SELECT conv_id, turn + 1 AS revision FROM conversations WHERE NOT (conv_id % 9 = 0 AND turn = 1)),
n AS (SELECT conv_id, max(turn) + 1 AS latest FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS key, 'revision-gap' AS rule FROM r GROUP BY conv_id HAVING max(revision) <> count(*) OR min(revision) <> 1
UNION ALL SELECT CAST(n.conv_id AS VARCHAR), 'latest-pointer' FROM n LEFT JOIN (SELECT conv_id, max(revision) AS m FROM r GROUP BY conv_id) x USING (conv_id) WHERE latest IS DISTINCT FROM m
""")
def revision_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    revisions = c.filter("not (conv_id % 9 = 0 and turn = 1)").select(F.col("conv_id").alias("note_id"), (F.col("turn") + 1).alias("revision"))
    notes = c.groupBy(F.col("conv_id").alias("note_id")).agg((F.max("turn") + 1).alias("latest_revision"))
    return S.revision_check(revisions, notes).select("key", "rule")


@query("SELECT p_partkey, p_brand || printf('-%06d', row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 99) AS identifier FROM part")
def assigned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    counters = part.select(F.col("p_brand").alias("namespace"), F.col("p_brand").alias("prefix")).distinct().withColumn("next_value", F.lit(100))
    return S.assign_ids(part, counters, "p_brand", ["p_partkey"]).select("p_partkey", "identifier")


@query("SELECT p_brand AS namespace, max(p_partkey) + 1 AS expected, CASE WHEN p_brand LIKE '%1' THEN 5 ELSE max(p_partkey) + 1 END AS actual FROM part GROUP BY p_brand HAVING p_brand LIKE '%1'")
def counter_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part").select(F.col("p_brand").alias("namespace"), F.col("p_partkey").alias("sequence"))
    counters = ids.groupBy("namespace").agg((F.max("sequence") + 1).alias("n")).select("namespace", F.when(F.col("namespace").endswith("1"), F.lit(5).cast("long")).otherwise(F.col("n")).alias("next_value"))
    return S.counter_check(ids, counters)


@query("SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) <> 1")
def exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.exactly_one(lines, table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events WHERE value > 100 GROUP BY user_id")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_match(table(spark, sf_dir, "events"), "user_id", ["event_id"], F.col("value") > 100, ["event_id", "event_type"])


# Decisions and replay


@query("""
WITH req AS (SELECT o_orderkey AS request_id, o_custkey % 40 AS operator_id, c_nationkey AS project_id, CASE WHEN o_orderkey % 3 = 0 THEN 'case' ELSE 'file' END AS scope_type, o_orderkey % 5 = 0 AS has_ciphertext FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT request_id, CASE WHEN scope_type = 'case' THEN 'broad_scope_export' WHEN has_ciphertext THEN 'ciphertext_export' ELSE 'ordinary_export' END AS rule,
       operator_id % 7 <> 3 AND (operator_id = project_id OR CASE WHEN scope_type = 'case' THEN project_id % 2 = 0 WHEN has_ciphertext THEN project_id % 3 = 0 ELSE true END) AS allowed FROM req
""")
def decide_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as export requests of nations: the policy differs by nation, the owner has the nation's number. Operators whose
    number leaves 3 by 7 are no members, or are removed, and get nothing."""
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("project_id"))
    requests = table(spark, sf_dir, "orders").join(who, "o_custkey").select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 40).alias("operator_id"), "project_id", F.when(F.col("o_orderkey") % 3 == 0, "case").otherwise("file").alias("scope_type"), (F.col("o_orderkey") % 5 == 0).alias("has_ciphertext")
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"))
    says = lambda rule: F.when(rule, "members").otherwise("owner")
    policy = nation.select("project_id", F.lit("members").alias("ordinary_export"), says(F.col("project_id") % 3 == 0).alias("ciphertext_export"), says(F.col("project_id") % 2 == 0).alias("broad_scope_export"))
    operators = requests.select("project_id", "operator_id").distinct().filter("operator_id <> 3")
    members = operators.withColumn("state", F.when(F.col("operator_id") % 7 == 3, "removed").otherwise("active"))
    return D.decide_export(requests, policy, nation.withColumn("owner_id", F.col("project_id")), members).select("request_id", "rule", "allowed")


GRANTS = """
g AS (SELECT user_id AS operator_id, event_id % 20 AS object_id, event_type AS basis, event_id AS granted, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS revoked FROM events WHERE event_type IN ('signup', 'view'))"""


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type in ('signup', 'view')")
    rows = M.intervals(e, ["user_id", "event_type"], "event_id")
    return rows.select(F.col("user_id").alias("operator_id"), (F.col("event_id") % 20).alias("object_id"), F.col("event_type").alias("authority_basis"), F.col("event_id").alias("granted_sequence"), F.col("valid_until").alias("revoked_sequence"))


@query(f"""
WITH {GRANTS}, o AS (SELECT operator_id, object_id, string_agg(basis, ',' ORDER BY granted, basis) AS bases FROM g WHERE revoked IS NULL GROUP BY ALL)
SELECT r.operator_id, r.object_id, coalesce(o.bases, '') AS bases, o.bases IS NOT NULL AS allowed
FROM (SELECT DISTINCT user_id AS operator_id, event_id % 20 AS object_id FROM events) r LEFT JOIN o USING (operator_id, object_id)
""")
def effective_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants of two bases, each open until the next of its kind: access holds as long as one of them does."""
    requests = table(spark, sf_dir, "events").select(F.col("user_id").alias("operator_id"), (F.col("event_id") % 20).alias("object_id")).distinct()
    return D.effective_access(requests, grants(spark, sf_dir), ("operator_id", "object_id")).withColumn("bases", F.array_join("bases", ","))


@query(f"""
WITH {GRANTS}, held AS (SELECT DISTINCT operator_id, object_id FROM g WHERE revoked IS NULL AND basis = 'signup'),
objects AS (SELECT DISTINCT user_id % 4 AS project_id, event_id % 20 AS object_id FROM events),
t AS (SELECT n_nationkey % 4 AS project_id, CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey + 50 AS BIGINT) AS b FROM nation)
SELECT DISTINCT a AS operator_id, object_id, 'revoke' AS action FROM t JOIN objects USING (project_id) JOIN held ON held.operator_id = a AND held.object_id = objects.object_id
UNION ALL SELECT DISTINCT b, object_id, 'grant' FROM t JOIN objects USING (project_id) WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.operator_id = b AND h.object_id = objects.object_id)
""".replace("SELECT DISTINCT a AS operator_id, object_id,", "SELECT DISTINCT a AS operator_id, objects.object_id,"))
def owner_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("project_id"), (F.col("event_id") % 20).alias("object_id"))
    key = F.col("n_nationkey").cast("long")
    transfers = table(spark, sf_dir, "nation").select((key % 4).alias("project_id"), key.alias("from_operator_id"), (key + 50).alias("to_operator_id"))
    return D.owner_transition(transfers, objects, grants(spark, sf_dir), "signup")


@query("""
SELECT doc_id, CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' ELSE 'pending' END AS status FROM documents LEFT JOIN labels USING (doc_id)
""")
def record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions replayed over submissions: documents are submitted, labels decide."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    details = F.lit('{"authority_transaction":{"data":{"status":"pending"}}}')
    base = [F.lit("P").alias("project_id"), F.lit("acquisition").alias("object_type"), F.col("doc_id").cast("string").alias("object_id"), F.lit("A").alias("actor_id")]
    made = d.select(*base, F.lit(1).alias("event_sequence"), F.lit("ACQUISITION_RECORDED").alias("event_type"), details.alias("details_json"))
    done = lab.filter("quality is not null").select(*base, F.lit(2).alias("event_sequence"), F.when(F.col("quality") == 1, "RECORD_APPROVED").otherwise("RECORD_REJECTED").alias("event_type"), F.lit("{}").alias("details_json"))
    return R.project(made.unionByName(done), R.projections()["record_authority"]).select(F.col("object_id").cast("long").alias("doc_id"), "status")


@query("""
WITH x AS (SELECT printf('EXP-%06d', user_id) AS export_id, event_id + 1 AS seq, event_type, printf('%.2f', value) AS v, props, event_id, user_id FROM events WHERE event_type IN ('signup', 'purchase', 'error'))
SELECT export_id, arg_max(CASE event_type WHEN 'signup' THEN 'preparing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END, seq) AS state,
       'OP-' || any_value(user_id) AS actor_id, arg_max(v, seq) FILTER (WHERE event_type = 'signup') AS scope_type, arg_max(props, seq) FILTER (WHERE event_type = 'signup') AS view_mode,
       arg_max(v, seq) FILTER (WHERE event_type = 'purchase') AS manifest_digest, arg_max(CAST(event_id AS VARCHAR), seq) FILTER (WHERE event_type = 'purchase') AS output_digest,
       CAST(max(seq) FILTER (WHERE event_type = 'signup') AS VARCHAR) AS created_sequence, CAST(max(seq) FILTER (WHERE event_type <> 'signup') AS VARCHAR) AS completed_sequence
FROM x GROUP BY export_id HAVING count(*) FILTER (WHERE event_type = 'signup') > 0
""")
def export_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.project(export_ledger(spark, sf_dir), R.projections()["exports"])
    return out.select("export_id", "state", "actor_id", "scope_type", "view_mode", "manifest_digest", "output_digest", "created_sequence", "completed_sequence")


@query(f"""
WITH {LEDGER}, cut AS (SELECT * FROM led WHERE event_id % 53 <> 0),
bad AS (SELECT project_id, 'sequence-gap' AS rule FROM cut c WHERE seq > 1 AND NOT EXISTS (SELECT 1 FROM cut d WHERE d.project_id = c.project_id AND d.seq = c.seq - 1)
        UNION ALL SELECT project_id, 'wrong-hash' FROM cut WHERE event_id % 97 = 0)
SELECT p.project_id AS target, CASE WHEN count(bad.rule) = 0 THEN 'verified' ELSE 'failed' END AS status, CAST(count(bad.rule) AS BIGINT) AS n_findings, coalesce(string_agg(DISTINCT bad.rule, ',' ORDER BY bad.rule), '') AS rules
FROM (SELECT DISTINCT project_id FROM led) p LEFT JOIN bad USING (project_id) GROUP BY p.project_id
""")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chain_verify(spark, sf_dir)
    out = summarise_findings(found, ledger(spark, sf_dir).select("project_id"), "project_id")
    return out.withColumn("rules", F.array_join("rules", ","))


# Audits, verifiers, check-in, scopes


@query("""
WITH x AS (SELECT user_id, event_id + 1 AS seq, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type IN ('signup', 'purchase', 'error'))
SELECT 'P' AS target, CAST(seq AS VARCHAR) AS key, CASE before WHEN 'signup' THEN 'EXPORT_STARTED' WHEN 'purchase' THEN 'EXPORT_COMPLETED' WHEN 'error' THEN 'EXPORT_FAILED' END AS actual
FROM x WHERE CASE WHEN event_type = 'signup' THEN before IS NOT NULL ELSE before IS DISTINCT FROM 'signup' END
""")
def audit_life_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule R23: exports start once and are completed or failed once."""
    return A.audit(export_ledger(spark, sf_dir), "R23").select("target", "key", "actual")


@query("""
WITH x AS (SELECT user_id, event_id + 1 AS seq, event_type FROM events), m AS (SELECT user_id, min(seq) AS made, count(*) AS n FROM x WHERE event_type = 'signup' GROUP BY user_id)
SELECT 'created-twice' AS rule, printf('EXP-%06d', user_id) AS key, CAST(n AS VARCHAR) AS actual FROM m WHERE n > 1
UNION ALL SELECT 'precedes-creation', printf('EXP-%06d', x.user_id), CAST(seq AS VARCHAR) FROM x LEFT JOIN m USING (user_id) WHERE event_type IN ('purchase', 'error') AND (made IS NULL OR seq < made)
""")
def verify_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.verify_order(export_ledger(spark, sf_dir), ["EXPORT_STARTED"], ["EXPORT_COMPLETED", "EXPORT_FAILED"]).select("rule", "key", "actual")


@query("""
WITH own AS (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS ids FROM lineitem GROUP BY l_orderkey),
rec AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN coalesce(ids, [])[2:] ELSE coalesce(ids, []) END AS said, coalesce(ids, []) AS ids FROM orders LEFT JOIN own ON l_orderkey = o_orderkey)
SELECT 'no-files' AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM rec WHERE len(said) = 0
UNION ALL SELECT 'doubled-file', CAST(o_orderkey AS VARCHAR) FROM rec WHERE len(said) <> len(list_distinct(said))
UNION ALL SELECT 'membership', CAST(o_orderkey AS VARCHAR) FROM rec WHERE said <> ids
""")
def verify_acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as acquisitions of their lines; every tenth order leaves its first line out."""
    lines = table(spark, sf_dir, "lineitem").select(F.lit("P").alias("project_id"), F.col("l_orderkey").cast("string").alias("acquisition_id"), F.col("l_partkey").cast("string").alias("file_id"), F.col("l_linenumber").alias("committed_sequence"))
    ids = S.ordered_members(lines, "acquisition_id", "committed_sequence", "file_id", "ids")
    said = F.coalesce("ids", F.array().cast("array<string>"))
    said = F.when(F.col("o_orderkey") % 10 == 0, F.slice(said, 2, 1_000_000)).otherwise(said)
    joined = table(spark, sf_dir, "orders").join(ids, F.col("o_orderkey").cast("string") == F.col("acquisition_id"), "left")
    details = F.to_json(F.struct(F.struct(F.struct(said.alias("file_ids")).alias("data")).alias("authority_transaction")))
    events = joined.select(F.lit("P").alias("project_id"), F.col("o_orderkey").alias("event_sequence"), F.lit("ACQUISITION_RECORDED").alias("event_type"), F.col("o_orderkey").cast("string").alias("object_id"), details.alias("details_json"))
    return V.verify_acquisitions(events, lines).select("rule", "key")


CLEAN = """
c AS (SELECT 'b' || doc_id % 50 AS batch_id, substr(sha256(text), 1, 16) AS logical_path, doc_id FROM documents),
bad AS (SELECT DISTINCT batch_id FROM (SELECT batch_id FROM c GROUP BY batch_id, logical_path HAVING count(*) > 1) x)"""


def checked_in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("b"), (F.col("doc_id") % 50).cast("string")).alias("batch_id"), F.substring(F.sha2("text", 256), 1, 16).alias("logical_path"), F.col("text").cast("binary").alias("payload"), F.lit(None).cast("string").alias("copied_digest"), "doc_id")
    prepared, found = B.prepare_batch(rows)
    counters = spark.range(1).select(F.lit("file").alias("namespace"), F.lit("FILE").alias("prefix"), F.lit(1).alias("next_value"))
    return prepared, B.commit_batch(prepared, found, counters)


@query(f"""
WITH {CLEAN}
SELECT doc_id, printf('FILE-%06d', row_number() OVER (ORDER BY batch_id, logical_path)) AS file_id,
       'files/' || batch_id || '/' || printf('FILE-%06d', row_number() OVER (ORDER BY batch_id, logical_path)) || '/' || logical_path AS storage_path
FROM c WHERE batch_id NOT IN (SELECT batch_id FROM bad)
""")
def checkin_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents checked in by batches: a batch that holds a path twice is refused as a whole."""
    return checked_in(spark, sf_dir)[1].select("doc_id", "file_id", "storage_path")


@query(f"""
WITH {CLEAN} SELECT batch_id, CAST(CASE WHEN batch_id IN (SELECT batch_id FROM bad) THEN 0 ELSE count(*) END AS BIGINT) AS n_files, CASE WHEN batch_id IN (SELECT batch_id FROM bad) THEN 'refused' ELSE 'committed' END AS status
FROM c GROUP BY batch_id
""")
def checkin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.batch_summary(*checked_in(spark, sf_dir))


@query(f"""
WITH {FILES}
SELECT 'unsafe-path' AS rule, '../' || logical_path AS key FROM fil WHERE doc_id % 40 = 0
UNION ALL SELECT 'missing', CASE WHEN doc_id % 40 = 0 THEN '../' ELSE '' END || logical_path FROM fil WHERE doc_id % 19 = 0
UNION ALL SELECT 'changed', CASE WHEN doc_id % 40 = 0 THEN '../' ELSE '' END || logical_path FROM fil WHERE doc_id % 19 <> 0 AND doc_id % 23 = 0
""")
def verify_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("path", F.when(F.col("doc_id") % 40 == 0, F.concat(F.lit("../"), "logical_path")).otherwise(F.col("logical_path")))
    seen = f.filter("doc_id % 19 <> 0").withColumn("content_digest", F.when(F.col("doc_id") % 23 == 0, "0").otherwise(F.col("content_digest")))
    return V.verify_package(f.select("path", "content_digest"), seen.select("path", "content_digest")).select("rule", "key")


@query(f"""
WITH RECURSIVE {FILES},
below AS (SELECT doc_id AS root, doc_id AS n FROM documents WHERE doc_id % 2 = 1 UNION SELECT root, doc_id FROM below JOIN documents ON doc_id = n * 2)
SELECT 'case' AS scope_type, case_id AS scope_id, CAST(count(*) AS BIGINT) AS n_files, max(doc_id) AS last_sequence FROM fil GROUP BY case_id
UNION ALL SELECT 'project', 'P', count(*), max(doc_id) FROM fil
UNION ALL SELECT 'acquisition', lang, count(*), max(doc_id) FROM fil GROUP BY lang
UNION ALL SELECT 'artefact', 'ART-' || root, count(*), max(n) FROM below GROUP BY root
UNION ALL SELECT 'note', 'NOTE-' || conv_id, count(DISTINCT doc_id), max(doc_id) FROM conversations JOIN documents ON doc_id = conv_id * 3 + turn GROUP BY conv_id
UNION ALL SELECT 'export', 'EXPORT-' || l_suppkey, count(DISTINCT doc_id), max(doc_id) FROM lineitem JOIN documents ON doc_id = l_partkey GROUP BY l_suppkey
""")
def resolve_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as cases, languages as acquisitions; artefacts of each odd file and all that is related below it (twice the
    number, and so on); conversations as notes and suppliers as exports of files."""
    f = files(spark, sf_dir).select("file_id", "case_id", F.col("lang").alias("acquisition_id"), F.lit("P").alias("project_id"), F.col("doc_id").alias("committed_sequence"))
    n, name = F.col("committed_sequence"), lambda c: X.format_id("FILE", c)
    state = scope_tables(spark, sf_dir, f, n, name)
    artefacts, notes, exports = (state[t] for t in ("artefact_files", "note_revisions", "export_items"))
    scopes = {"case": (f, "case_id"), "acquisition": (f, "acquisition_id"), "project": (f, "project_id"), "artefact": (artefacts, "artefact_id"), "note": (notes, "note_id"), "export": (exports, "export_id")}
    asked = S.union_all([df.select(F.lit(t).alias("scope_type"), F.col(c).alias("scope_id")).distinct() for t, (df, c) in scopes.items()])
    found, _ = Q.resolve_scopes(asked, state)
    return found.groupBy("scope_type", "scope_id").agg(F.count("*").alias("n_files"), F.max("committed_sequence").alias("last_sequence"))


@query("""
SELECT c_name AS value, CASE WHEN count(DISTINCT n) = 1 THEN 'found' ELSE 'ambiguous' END AS status FROM (SELECT c_mktsegment AS c_name, c_nationkey AS n FROM customer UNION ALL SELECT c_name, c_nationkey FROM customer) x GROUP BY c_name
UNION ALL SELECT s_name, 'unknown' FROM supplier
""")
def resolve_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    dimension = c.select(F.col("c_mktsegment").alias("value"), "c_nationkey").unionByName(c.select(F.col("c_name").alias("value"), "c_nationkey"))
    asked = dimension.select("value").distinct().unionByName(s.select(F.col("s_name").alias("value")))
    return Q.resolve_unique(asked, dimension, "value", "c_nationkey").select("value", "status")


@query("""
SELECT 'found' AS matched, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'u' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS value, CAST(c_custkey AS VARCHAR) AS operator_id FROM customer
UNION ALL SELECT 'member', c_name, CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 0
""")
def member_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as operators, found by name, uuid or id, and those that are members with an active key."""
    c = table(spark, sf_dir, "customer")
    ops = c.select(F.col("c_custkey").alias("operator_id"), F.col("c_name").alias("operator_ref"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("operator_uuid"))
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    asked = c.select(F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.concat(F.lit("u"), key)).otherwise(key).alias("value"))
    found = Q.find_operator(ops.withColumn("operator_id", F.col("operator_id").cast("string")), asked)
    keys = c.select(F.col("c_custkey").alias("operator_id"), F.when(F.col("c_custkey") % 2 == 0, "active").otherwise("old").alias("state"), F.col("c_name").alias("signing_fingerprint"))
    held = M.members_with_keys(ops, c.filter(k % 5 != 0).select(k.alias("operator_id"), F.lit("owner").alias("membership_role")), keys)
    return found.select(F.lit("found").alias("matched"), "value", "operator_id").unionByName(held.select(F.lit("member").alias("matched"), F.col("signing_fingerprint").alias("value"), F.col("operator_id").cast("string").alias("operator_id")))


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS VARCHAR) AS k, CASE WHEN event_id % 9 = 0 THEN 'metadata is no JSON object' END AS observation FROM events WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, NULL, 'metadata is no JSON object' FROM events WHERE event_id % 9 = 0")
def promote_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit("broken {")).otherwise(F.col("props")).alias("props"))
    return L.promote_metadata(e, "props", ("k",)).drop("props")

# Their queries register themselves.
__all__ = ["ORACLE_SQL", "QUERIES", "audits", "histories", "listings", "members", "payloads", "replays", "streams", "verifiers"]
