"""Listings, lookups, text rules, aggregates and sources over the provided tables, each with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from ..operators import decisions as D
from ..operators import matching as M
from ..operators import replay as R
from ..operators import scopes as Q
from ..operators import sets as S
from ..sources import ledger as L
from ..sources.shared import shared_dir, written
from .registry import FILES, LEDGER, query
from .replays import export_events, file_events, member_events, note_events, part_events, record_events
from .standins import export_ledger, files, ledger, scope_tables, table, text


def ranked(df: DataFrame, by: list, group: str | None = None, name: str = "place") -> DataFrame:
    """df with the place of each row in its order, within its group."""
    window = Window.partitionBy(group) if group else Window
    return df.withColumn(name, F.row_number().over(window.orderBy(*by)))


@query("""
SELECT source AS case_id, 'FILE-' || doc_id AS file_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id * 10, 'FILE-' || doc_id) AS INTEGER) AS place FROM documents
""")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each case in their order."""
    held = R.project(file_events(spark, sf_dir), R.projections()["files"])
    return ranked(Q.list_files(held).select("case_id", "file_id", F.col("committed_sequence").cast("long").alias("s")), ["s", "file_id"], "case_id").drop("s")


@query("""
WITH m AS (SELECT DISTINCT doc_id, doc_id * k AS f FROM documents, (SELECT unnest([1, 2]) AS k) x)
SELECT 'ART-' || m.doc_id AS artefact_id, 'FILE-' || f AS file_id, d.lang AS acquisition_id FROM m JOIN documents d ON d.doc_id = f
""")
def artefact_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artefacts' direct members that are in the catalogue, with the acquisition of each."""
    led = file_events(spark, sf_dir)
    members = R.artefact_files(led).select("artefact_id", "file_id", "created_sequence").distinct()
    return Q.artefact_members(members, R.project(led, R.projections()["files"]).select("file_id", "acquisition_id")).select("artefact_id", "file_id", "acquisition_id")


@query("""
WITH m AS (SELECT doc_id, string_agg(DISTINCT 'FILE-' || doc_id * k, ',' ORDER BY 'FILE-' || doc_id * k) AS f FROM documents, (SELECT unnest([1, 2]) AS k) x GROUP BY doc_id)
SELECT 'ART-' || doc_id AS artefact_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE f END AS file_ids FROM m
""")
def list_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artefacts with their files; the members of every tenth are lost."""
    led = file_events(spark, sf_dir)
    members = R.artefact_files(led).select("artefact_id", "file_id", "created_sequence").distinct().filter(F.regexp_extract("artefact_id", "([0-9]+)$", 1).cast("long") % 10 != 0)
    out = Q.list_artefacts(R.project(led, R.projections()["artefacts"]).select("artefact_id"), members)
    return out.withColumn("file_ids", F.array_join("file_ids", ","))


@query("SELECT p_brand AS namespace, p_brand || '-' || p_partkey AS identifier, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS place FROM part")
def list_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = R.project(part_events(spark, sf_dir), R.projections()["identifiers"]).withColumn("sequence", F.col("sequence").cast("long"))
    return ranked(Q.list_identifiers(held).select("namespace", "identifier", "sequence"), ["sequence"], "namespace").drop("sequence")


@query("SELECT o_custkey % 50 AS g, CAST(o_orderkey AS VARCHAR) AS object_id, CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey * 10) AS INTEGER) AS place FROM orders")
def list_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = Q.list_records(R.project(record_events(spark, sf_dir), R.projections()["record_authority"]))
    rows = held.select((F.col("submitted_by").cast("long") % 50).alias("g"), "object_id", F.col("submitted_sequence").cast("long").alias("s"))
    return ranked(rows, ["s"], "g").drop("s")


@query("""
WITH x AS (SELECT user_id, max(event_id + 1) AS s FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT printf('EXP-%06d', user_id) AS export_id, CAST(row_number() OVER (PARTITION BY user_id % 7 ORDER BY s) AS INTEGER) AS place FROM x
""")
def list_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = Q.list_exports(R.project(export_ledger(spark, sf_dir), R.projections()["exports"]))
    rows = held.select("export_id", F.col("created_sequence").cast("long").alias("s"), (F.substring("export_id", 5, 9).cast("long") % 7).alias("g"))
    return ranked(rows, ["s"], "g").select("export_id", "place")


@query("""
WITH n AS (SELECT conv_id, max(turn) + 1 AS latest FROM conversations GROUP BY conv_id)
SELECT 'NOTE-' || conv_id AS note_id, 'A' || conv_id % 7 AS author_id, CAST(latest AS VARCHAR) AS latest_revision FROM n
""")
def list_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.list_notes(R.project(note_events(spark, sf_dir), R.projections()["notes"])).select("note_id", "author_id", "latest_revision")


@query("""
WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), n AS (SELECT conv_id, max(turn) + 1 AS latest FROM c GROUP BY conv_id)
SELECT 'NOTE-' || conv_id AS note_id, CASE conv_id % 3 WHEN 1 THEN 1 ELSE latest END AS revision, 'FILE-' || conv_id || '-' || CASE conv_id % 3 WHEN 1 THEN 0 ELSE latest - 1 END AS file_id FROM n
""")
def note_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first revision of every third note, the latest (0 or null) of the others."""
    led, specs = note_events(spark, sf_dir), R.projections()
    long = lambda df, c: df.withColumn(c, F.col(c).cast("long"))
    notes = long(R.project(led, specs["notes"]), "latest_revision")
    n = F.regexp_extract("note_id", "([0-9]+)$", 1).cast("long")
    asked = notes.select("note_id", F.when(n % 3 == 1, 1).when(n % 3 == 0, 0).cast("long").alias("revision"))
    return Q.note_revision(notes, long(R.project(led, specs["note_revisions"]), "revision"), asked).select("note_id", "revision", "file_id")


@query("""
SELECT 'CT-' || conv_id AS transfer_id, 'note:NOTE-' || conv_id AS objects FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 6 = 0) x
""")
def list_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.list_transfers(R.project(note_events(spark, sf_dir), R.projections()["confidential_transfers"]))
    return out.select("transfer_id", F.array_join(F.transform("scope", lambda s: F.concat_ws(":", s["object_type"], s["object_id"])), ",").alias("objects"))


@query("""
WITH last AS (SELECT c_nationkey, max(c_custkey) AS m FROM customer GROUP BY c_nationkey)
SELECT printf('P-%03d', n_nationkey) AS scope_id, CASE WHEN n_nationkey % 2 = 0 AND m IS NOT NULL THEN 'OP-' || m ELSE 'OP-N' || n_nationkey END AS owner_id, CASE WHEN n_nationkey % 2 = 0 AND m IS NOT NULL THEN (SELECT c_name FROM customer WHERE c_custkey = m) ELSE n_name END AS name
FROM nation LEFT JOIN last ON c_nationkey = n_nationkey
""")
def current_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of each project after its transfers, with their name."""
    led = member_events(spark, sf_dir)
    return Q.current_owner(R.ownership(led), R.project(led, R.projections()["operators"])).select("scope_id", "owner_id", "name")


@query("""
SELECT 'OP-' || c_custkey AS operator_id, c_name AS name, c_mktsegment AS role, 'FOP-' || c_custkey AS operator_key_fingerprint, 'SOP-' || c_custkey AS operator_signing_subkey_fingerprint FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 9 <> 0
UNION ALL SELECT 'OP-N' || n_nationkey, n_name, 'founder', 'FOP-N' || n_nationkey, 'SOP-N' || n_nationkey FROM nation
""")
def operator_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identities of active members."""
    led, specs = member_events(spark, sf_dir), R.projections()
    return Q.operator_identity(R.project(led, specs["operators"]), R.project(led, specs["operator_keys"]), R.memberships(led)).drop("public_contact", "organisation")


@query("""
WITH e AS (SELECT event_id, user_id FROM events)
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'S' || user_id END AS signing_fingerprint, CASE user_id % 3 WHEN 0 THEN 1 ELSE 0 END AS n_active FROM e
""")
def active_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the active key of their actor, who has one retired key too, and how many active keys the actor has."""
    e = table(spark, sf_dir, "events").select("event_id", text("user_id").alias("actor_id"))
    who = e.select("actor_id").distinct()
    keys = who.select(F.col("actor_id").alias("operator_id"), F.concat(F.lit("S"), "actor_id").alias("signing_fingerprint"), F.when(F.col("actor_id").cast("long") % 3 == 0, "active").otherwise("retired").alias("state"))
    held = M.active_key(keys, keys).groupBy(F.col("operator_id").alias("actor_id")).agg(F.count("*").cast("int").alias("n"))
    return M.with_active_key(e, keys).join(held, "actor_id", "left").select("event_id", "signing_fingerprint", F.coalesce("n", F.lit(0)).alias("n_active"))


@query("SELECT 'CASE-' || s_suppkey AS identifier, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS title FROM supplier WHERE s_suppkey % 5 <> 0")
def active_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cases: every fifth is retired; those of even numbers have a title."""
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    ids = s.select(F.format_string("CASE-%d", "s_suppkey").alias("identifier"), F.lit("case").alias("namespace"), F.when(n % 5 == 0, "retired").otherwise("active").alias("state"))
    cases = s.filter(n % 2 == 0).select(F.format_string("CASE-%d", "s_suppkey").alias("identifier"), F.col("s_name").alias("title"))
    return Q.active_cases(ids, cases).select("identifier", "title")


@query("""
WITH RECURSIVE d AS (SELECT doc_id AS n, source, lang FROM documents),
below AS (SELECT n AS root, n FROM d WHERE n % 2 = 1 UNION SELECT root, d.n FROM below JOIN d ON d.n = below.n * 2),
s AS (SELECT 'artefact' AS kind, 'ART-' || root AS id, n FROM below UNION ALL SELECT 'acquisition', 'ACQ-' || lang, n FROM d
  UNION ALL SELECT DISTINCT 'note', 'NOTE-' || conv_id, conv_id * 3 + turn FROM conversations UNION ALL SELECT DISTINCT 'export', 'EXPORT-' || l_suppkey, l_partkey FROM lineitem),
k AS (SELECT kind, id, count(d.n) AS c FROM s LEFT JOIN d USING (n) GROUP BY ALL)
SELECT id AS identifier, kind AS found, c AS n_files FROM k
UNION ALL SELECT id, 'empty-scope', NULL FROM k WHERE c = 0
UNION ALL SELECT 'FILE-' || n AS identifier, CASE WHEN n % 5 = 0 THEN 'unknown-id' WHEN n % 5 = 1 THEN 'unsupported-namespace' ELSE 'file' END AS found, CASE WHEN n % 5 > 1 THEN 1 END AS n_files FROM d
UNION ALL SELECT 'CASE-' || source, 'case', count(*) FROM d GROUP BY source
UNION ALL SELECT 'P', 'project', count(*) FROM d
UNION ALL SELECT 'CASE-none', 'empty-scope', NULL
UNION ALL SELECT 'CASE-none', 'case', 0
""")
def verify_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of files, cases, acquisitions, artefacts, notes, exports and the project: some never issued, some of a
    namespace without files, and some that stand for none."""
    n = F.col("doc_id")
    f = files(spark, sf_dir).select(F.format_string("FILE-%d", "doc_id").alias("file_id"), F.concat(F.lit("CASE-"), "case_id").alias("case_id"), F.concat(F.lit("ACQ-"), "lang").alias("acquisition_id"), F.lit("P").alias("project_id"), n.alias("committed_sequence"), "doc_id")
    state = scope_tables(spark, sf_dir, f, n, lambda c: F.format_string("FILE-%d", c))
    tables = {"acquisition": "files", "artefact": "artefact_files", "note": "note_revisions", "export": "export_items"}
    others = S.union_all([state[t].select(F.col(f"{k}_id").alias("identifier"), F.lit(k).alias("namespace"), F.lit("active").alias("state")).distinct() for k, t in tables.items()]).filter("identifier is not null")
    cases = f.select(F.col("case_id").alias("identifier")).distinct().unionByName(spark.range(1).select(F.lit("CASE-none").alias("identifier")))
    ids = f.filter(n % 5 != 0).select(F.col("file_id").alias("identifier"), F.when(n % 5 == 1, "box").otherwise("file").alias("namespace"), F.lit("active").alias("state")).unionByName(cases.select("identifier", F.lit("case").alias("namespace"), F.lit("active").alias("state"))).unionByName(others)
    state["identifiers"] = ids
    asked = f.select(F.col("file_id").alias("identifier")).unionByName(cases).unionByName(others.select("identifier")).unionByName(spark.range(1).select(F.lit("P").alias("identifier")))
    rows, found = Q.verify_id(asked, ids, state)
    return rows.select("identifier", F.col("scope_type").alias("found"), F.col("n_files").cast("long").alias("n_files")).unionByName(found.select(F.col("key").alias("identifier"), F.col("rule").alias("found"), F.lit(None).cast("long").alias("n_files")))


@query("""
WITH RECURSIVE o AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS k FROM orders), d AS (SELECT doc_id FROM documents),
below AS (SELECT doc_id AS root, doc_id AS n FROM d WHERE doc_id % 2 = 1 UNION SELECT root, doc_id FROM below JOIN d ON doc_id = n * 2),
s AS (SELECT 0 AS kind, root AS id, n FROM below UNION ALL SELECT 1, conv_id, conv_id * 3 + turn FROM conversations UNION ALL SELECT 2, l_suppkey, l_partkey FROM lineitem UNION ALL SELECT 3, doc_id, doc_id FROM d)
SELECT DISTINCT CAST(c AS VARCHAR) AS request_id, 'FILE-' || doc_id AS file_id FROM o JOIN s ON id = k AND kind = k % 4 JOIN d ON doc_id = n WHERE c % 4 <> 0
UNION ALL SELECT CAST(c AS VARCHAR), 'unsupported-id' FROM o WHERE c % 4 = 0 GROUP BY c
""")
def expand_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' selections of files, artefacts, notes and exports named by their orders; those of every fourth name a thing of an unknown kind."""
    f = files(spark, sf_dir).select(F.format_string("FILE-%d", "doc_id").alias("file_id"), "case_id", F.col("lang").alias("acquisition_id"), F.lit("P").alias("project_id"), F.col("doc_id").alias("committed_sequence"))
    state = scope_tables(spark, sf_dir, f, F.col("committed_sequence"), lambda c: F.format_string("FILE-%d", c))
    kind = F.get(F.array(*map(F.lit, ("ART-", "NOTE-", "EXPORT-", "FILE-"))), (F.col("o_orderkey") % 4).cast("int"))
    name = F.when(F.col("o_custkey") % 4 == 0, "what").otherwise(F.concat(kind, text("o_orderkey")))
    asked = table(spark, sf_dir, "orders").groupBy(text("o_custkey").alias("request_id")).agg(F.collect_list(name).alias("ids"))
    rows, found = Q.expand_selection(asked, state)
    return rows.unionByName(found.filter("rule = 'unsupported-id'").select(F.col("target").alias("request_id"), F.col("rule").alias("file_id")))


@query("SELECT 'FILE-' || doc_id AS file_id, CASE WHEN doc_id % 6 = 0 AND doc_id % 12 <> 0 THEN 1 ELSE 2 END AS n_views FROM documents")
def apply_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many of the two views each file is."""
    held = R.project(file_events(spark, sf_dir), R.projections()["files"])
    return Q.apply_view(held).unionByName(Q.apply_view(held, "presented")).groupBy("file_id").agg(F.count("*").alias("n_views"))


# Text rules


@query(r"""
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'x' || doc_id END AS trimmed, 'files/' || source || '/' || doc_id || '/n.txt' AS path, doc_id % 4 = 0 AS valid_id, CASE WHEN doc_id % 5 = 0 THEN upper(repeat('ab', 20)) ELSE 'ZZ' END AS fingerprint, doc_id % 5 = 0 AS fingerprint_ok,
       doc_id % 2 = 0 AS transient, substr(text, 1, 20) AS bounded, 'end ' || doc_id AS last_line, doc_id % 6 < 2 AS consistent, CASE WHEN doc_id % 6 = 0 THEN 'system' WHEN doc_id % 6 < 3 THEN 'b' END AS basis, doc_id % 7 = 0 AS secret, doc_id % 3 = 1 AS known_state
FROM documents
""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over single values, with values that keep and break them."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    kind = F.when(n % 2 == 0, "system").otherwise("operator")
    ids = F.when((n % 6 == 1) | (n % 6 == 2) | (n % 6 == 4), "x")
    rows = d.select(
        "doc_id", "text", F.when(n % 3 == 0, "  ").otherwise(F.concat(F.lit(" x"), text("doc_id"), F.lit(" "))).alias("blank"), F.col("source").alias("scope"), F.when(n % 4 == 0, F.format_string("FILE-%06d", "doc_id")).otherwise(F.format_string("file-%d", "doc_id")).alias("id"),
        F.when(n % 5 == 0, F.repeat(F.lit("ab "), 20)).otherwise("zz").alias("fp"), F.when(n % 2 == 0, F.when(n % 4 == 0, "a/b.PART").otherwise("c.mp4.part-Frag3")).otherwise("d.txt").alias("leaf"), F.concat(F.lit("a\nend "), text("doc_id"), F.lit("\n")).alias("lines"),
        kind.alias("kind"), ids.alias("actor"), F.when(n % 6 == 4, None).otherwise(ids).alias("uuid"), F.when((n % 6 == 1) | (n % 6 == 2), "b").alias("basis"), F.when(n % 7 == 0, "confidential-x").otherwise("text").alias("class"),
        F.when(n % 3 == 1, "active").when(n % 3 == 2, "gone").alias("state"),
    )
    return rows.select(
        "doc_id", X.blank_to_null("blank").alias("trimmed"), X.storage_path(F.lit("files"), "scope", text("doc_id"), F.lit("n.txt")).alias("path"), X.valid_id("id").alias("valid_id"), X.normalise_fingerprint("fp").alias("fingerprint"), X.valid_fingerprint("fp").alias("fingerprint_ok"),
        X.is_transient("leaf").alias("transient"), X.bounded("text", 20).alias("bounded"), X.last_line("lines").alias("last_line"), X.actor_consistent("kind", "actor", "uuid").alias("consistent"),
        X.system_defaults(F.when(n % 6 == 0, "system").otherwise("operator"), "basis").alias("basis"), X.is_confidential("class").alias("secret"), X.enum_rule("identifiers.state", "state").alias("known_state"),
    )


# Fixed values, as SQL: what the columns of a ledger's tables may hold.
ALLOWED = """
allowed AS (SELECT col0 AS place, col1 AS name, unnest(string_split(col2, ' ')) AS value FROM (VALUES
  (0, 'identifiers.state', 'active retired failed'), (1, 'operators.state', 'active retired'), (2, 'operator_keys.state', 'active retired revoked'), (3, 'project_memberships.state', 'pending active rejected removed'),
  (4, 'ownership_transfers.state', 'pending accepted rejected cancelled'), (5, 'record_authority.status', 'pending approved rejected'), (6, 'files.presentation_state', 'presented retracted superseded'),
  (7, 'notes.visibility', 'project confidential'), (8, 'notes.package_disclosure', 'withheld include'), (9, 'note_revisions.revision_type', 'content cryptographic'),
  (10, 'export_policy.confidential_plaintext_export', 'owner authority'), (11, 'access_grants.object_type', 'file note artefact'), (12, 'exports.scope_type', 'file artefact acquisition case project selection'),
  (13, 'exports.state', 'preparing completed failed cancelled'), (14, 'export_items.mode', 'native derived'), (15, 'annotations.kind', 'rectangle ellipse arrow line freehand marker text highlight'),
  (16, 'access_grants.authority_basis', 'object-owner explicit-grant project-owner case-role recovery-authority system-policy'), (17, 'project_memberships.membership_role', 'owner contributor'),
  (18, 'acquired_files.role', 'primary supporting metadata transcript derived annotation redaction_request preview source_metadata network inspection')))"""


@query(f"""
WITH {ALLOWED}, pool AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k FROM (SELECT DISTINCT value FROM allowed UNION SELECT 'exact' UNION SELECT 'withhold') x),
asked AS (SELECT doc_id, (SELECT DISTINCT name FROM allowed WHERE place = doc_id % 19) AS name, (SELECT value FROM pool WHERE pool.k = (doc_id // 19) % (SELECT count(*) FROM pool)) AS value FROM documents)
SELECT doc_id, name, value, EXISTS (SELECT 1 FROM allowed a WHERE a.name = asked.name AND a.value = asked.value) AS known FROM asked
""")
def enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of any column tried on every column, each by some document."""
    names = (
        "identifiers.state", "operators.state", "operator_keys.state", "project_memberships.state", "ownership_transfers.state", "record_authority.status", "files.presentation_state", "notes.visibility", "notes.package_disclosure", "note_revisions.revision_type",
        "export_policy.confidential_plaintext_export", "access_grants.object_type", "exports.scope_type", "exports.state", "export_items.mode", "annotations.kind", "access_grants.authority_basis", "project_memberships.membership_role", "acquired_files.role",
    )
    pool = sorted({v for n in names for v in X.ENUMS[n]} | {"exact", "withhold"})
    n, pick = F.col("doc_id"), lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    asked = table(spark, sf_dir, "documents").select("doc_id", pick(names, n % len(names)).alias("name"), pick(pool, F.floor(n / len(names)) % len(pool)).alias("value"))
    known = F.lit(False)
    for name in names:
        known = F.when(F.col("name") == name, X.enum_rule(name, "value")).otherwise(known)
    return asked.withColumn("known", known)


@query("""
WITH e AS (SELECT vec_id AS n, sha256(CAST(vec_id AS VARCHAR)) AS original_sha256 FROM embeddings WHERE vec_id % 11 <> 0)
SELECT original_sha256, 'annotation' AS layer, 'a' || n AS id, CASE WHEN n % 3 = 0 THEN 'marker' ELSE 'freehand' END AS kind, 'n' || n AS note, NULL AS reason, CAST(n % 7 AS DOUBLE) AS x, NULL AS width, n + 1 AS original_width FROM e
UNION ALL SELECT original_sha256, 'redaction', 'r' || n, 'box', NULL, CASE WHEN n % 5 <> 0 THEN 'face' END, CAST(n % 4 AS DOUBLE), 0.5, n + 1 FROM e
""")
def review_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as review layers, written as JSON files and read back: a mark or a line of points and a redaction each;
    those of every eleventh have another schema."""
    n, path = F.col("vec_id"), f"{shared_dir(spark)}/layers-{uuid.uuid4().hex}"
    point = F.format_string('{"x":%d,"y":0.5%s}', n % 7, F.when(n % 3 == 0, "").otherwise(',"points":[{"x":0.1,"y":0.2}]'))
    mark = F.format_string('{"annotation_id":"a%d","kind":"%s","geometry":%s,"note":"n%d"}', n, F.when(n % 3 == 0, "marker").otherwise("freehand"), point, n)
    cut = F.format_string('{"redaction_id":"r%d","box":{"x":%d,"y":0.5,"width":0.5,"height":0.5}%s}', n, n % 4, F.when(n % 5 == 0, "").otherwise(',"reason":"face"'))
    body = F.format_string('{"schema":"%s","original_sha256":"%s","original_width":%d,"original_height":%d,"annotations":[%s],"proposed_redactions":[%s]}', F.when(n % 11 == 0, "other/v1").otherwise("image-review/v1"), F.sha2(text("vec_id"), 256), n + 1, n + 1, mark, cut)
    table(spark, sf_dir, "embeddings").select(body).write.text(path)
    rows, _ = L.read_review_layers(spark, path, "image-review/v1", lines=True)
    return rows.select("original_sha256", "layer", "id", "kind", "note", "reason", F.col("geometry")["x"].alias("x"), F.col("geometry")["width"].alias("width"), "original_width")


# Endings of collected files, with role, media type, description and relationship to the primary file.
KINDS = [
    ((".mkv", ".mp4", ".webm"), "primary", None, "media", None), ((".info.json",), "source-metadata", "application/json", "metadata", "describes"),
    ((".vtt",), "supporting", "text/vtt", "subtitle", "supports"), ((".jpg", ".jpeg", ".png", ".webp"), "supporting", "image/*", "image", "supports"),
]


@query("""
WITH d AS (SELECT doc_id, ['a.MP4', 'a.info.json', 'b.vtt', 'c.jpg', 'c.png', 'd.bin'][doc_id % 6 + 1] AS path FROM documents)
SELECT doc_id, ['primary', 'source-metadata', 'supporting', 'supporting', 'supporting', 'supporting'][doc_id % 6 + 1] AS role, [NULL, 'application/json', 'text/vtt', 'image/jpeg', 'image/png', NULL][doc_id % 6 + 1] AS media_type,
       ['media', 'metadata', 'subtitle', 'image', 'image', 'output'][doc_id % 6 + 1] AS description, [NULL, 'describes', 'supports', 'supports', 'supports', NULL][doc_id % 6 + 1] AS relationship FROM d
""")
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.get(F.array(*map(F.lit, ("a.MP4", "a.info.json", "b.vtt", "c.jpg", "c.png", "d.bin"))), (F.col("doc_id") % 6).cast("int"))
    return d.select("doc_id", X.classify_file(path, KINDS, ("supporting", None, "output", None)).alias("x")).select("doc_id", "x.*")


@query("""
WITH d AS (SELECT doc_id % 4 AS k, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)
SELECT ['image/png', 'image/jpeg', 'image/webp', 'unknown'][k + 1] AS media_type, CAST(count(*) AS BIGINT) AS n_payloads, CAST(sum(n + [24, 3, 12, 0][k + 1]) AS BIGINT) AS n_bytes FROM d GROUP BY k
""")
def payload_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the first bytes of images before them."""
    d, k = table(spark, sf_dir, "documents").filter("text is not null"), (F.col("doc_id") % 4).cast("int")
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("89504E470D0A1A0A0000000D494844520000007B000001C8", "FFD8FF", "524946460000000057454250", "")])
    return S.payload_types(d.select(F.concat(F.get(heads, k), F.col("text").cast("binary")).alias("content")))


# Joins and aggregates


@query("SELECT l_linenumber % 50 AS digest_id, min(l_orderkey) AS export_id FROM lineitem GROUP BY ALL UNION ALL SELECT -1, NULL")
def first_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests with the first export that recorded them; one that none did."""
    done = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 50).cast("long").alias("output_digest"), F.col("l_orderkey").alias("export_id"), F.col("l_orderkey").alias("event_sequence"))
    probe = done.select("output_digest").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("output_digest")))
    return M.first_envelope(probe, done).select(F.col("output_digest").alias("digest_id"), "export_id")


@query("""
WITH d AS (SELECT sha256(text) AS digest, min(doc_id) AS export_id FROM documents WHERE doc_id % 3 = 0 GROUP BY 1),
p AS (SELECT 'B-' || item_id AS probe_id, sha256(text) AS digest FROM benchmark UNION ALL SELECT 'D-' || doc_id, sha256(text) FROM documents)
SELECT probe_id, export_id FROM p LEFT JOIN d USING (digest)
""")
def first_envelope_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item with the first export of its bytes, every third document having been exported."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("output_digest"))
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("B-"), text("item_id")).alias("probe_id"), F.sha2("text", 256).alias("output_digest"))
    done = d.filter("doc_id % 3 = 0").select("output_digest", F.col("doc_id").alias("export_id"), F.col("doc_id").alias("event_sequence"))
    probe = b.unionByName(d.select(F.concat(F.lit("D-"), text("doc_id")).alias("probe_id"), "output_digest"))
    return M.first_envelope(probe, done).select("probe_id", "export_id")


@query("SELECT 'rows' AS rule, (SELECT count(*) FROM orders) AS log_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 100 <> 0) AS table_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 0) = 0 AS same UNION ALL SELECT 'sets', NULL, NULL, true UNION ALL SELECT 'changed', NULL, NULL, false")
def count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a log and its table have, and whether two frames hold the same rows, one in another order, one with a row changed."""
    o = table(spark, sf_dir, "orders")
    keys = o.select("o_orderkey", "o_custkey")
    rows = S.count_check(o, o.filter("o_orderkey % 100 <> 0")).select(F.lit("rows").alias("rule"), "log_rows", "table_rows", "same")
    changed = keys.withColumn("o_custkey", F.when(F.col("o_orderkey") == 1, -1).otherwise(F.col("o_custkey")))
    none = F.lit(None).cast("long")
    sets = [spark.range(1).select(F.lit(n).alias("rule"), none.alias("log_rows"), none.alias("table_rows"), F.lit(M.set_equal(keys, other)).alias("same")) for n, other in (("sets", keys.repartition(3)), ("changed", changed))]
    return S.union_all([rows, *sets])


@query("""
SELECT printf('P-%03d', c_nationkey) AS project_id, CAST(count(*) FILTER (WHERE c_custkey % 5 <> 0) AS BIGINT) AS n_hashed, CAST(count(*) FILTER (WHERE c_custkey % 7 = 0) AS BIGINT) AS n_writable, coalesce(string_agg(CASE WHEN c_custkey % 7 = 0 THEN c_name END, ',' ORDER BY c_name), '') AS writable FROM customer GROUP BY c_nationkey
""")
def payload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    seen = c.select(F.format_string("P-%03d", "c_nationkey").alias("project_id"), F.col("c_name").alias("storage_path"), F.when(n % 5 != 0, "d").alias("content_digest"), (n % 7 == 0).alias("writable"))
    listed = S.concat_members(S.writable_payloads(seen), "project_id", "storage_path", name="writable")
    return S.payload_summary(seen).join(listed, "project_id", "left").withColumn("writable", F.coalesce("writable", F.lit("")))


@query("""
WITH n AS (SELECT user_id, event_type, event_id FROM events)
SELECT user_id, CAST(count(*) FILTER (WHERE event_type IN ('signup', 'view')) AS BIGINT) AS granted, CAST(count(*) FILTER (WHERE event_type NOT IN ('signup', 'view')) AS BIGINT) AS revoked FROM n GROUP BY user_id
""")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("operator_id"), F.when(F.col("event_type").isin("signup", "view"), "grant").otherwise("revoke").alias("action"))
    return D.transition_counts(e).withColumnRenamed("operator_id", "user_id")


@query("SELECT p_partkey, p_brand || '-' || printf('%06d', row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)) AS ref FROM part")
def ordinal_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.ordinal_refs(table(spark, sf_dir, "part"), ["p_brand"], ["p_retailprice", "p_partkey"], "X")
    return out.select("p_partkey", F.concat("p_brand", F.substring("ref", 2, 99)).alias("ref"))


@query("""
WITH d AS (SELECT doc_id, source || '/' || doc_id % 100 || '/' || doc_id AS path FROM documents)
SELECT doc_id, CAST(row_number() OVER (ORDER BY split(path, '/')) AS INTEGER) AS by_parts, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS by_text, CAST(row_number() OVER (ORDER BY doc_id % 10, doc_id) AS INTEGER) AS by_seq FROM d
""")
def orders_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of rows in three orders; each order is a range sort, whose places come from the sizes of its ranges."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", (F.col("doc_id") % 100).cast("string"), text("doc_id")).alias("path"), (F.col("doc_id") % 10).alias("s"))
    out = None
    for name, df in (("by_parts", S.order_by_path(d, "path", True)), ("by_text", S.order_by_path(d, "path")), ("by_seq", S.order_by_sequence(d, "s", "doc_id"))):
        # Written in its order: the numbers of a partition's rows go on after those of the partitions before it.
        rows = written(df.select("doc_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")), "ordered")
        sizes = rows.groupBy("p").agg(F.count("*").alias("n"), F.min("i").alias("least"))
        before = sizes.select("p", "least", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
        placed = rows.join(F.broadcast(before), "p").select("doc_id", (F.col("before") + F.col("i") - F.col("least") + 1).cast("int").alias(name))
        out = placed if out is None else out.join(placed, "doc_id")
    return out


@query("""
WITH r AS (SELECT l_orderkey, l_suppkey % 20 AS s, l_linenumber FROM lineitem)
SELECT l_orderkey, s, min(l_linenumber) AS first_line FROM r GROUP BY l_orderkey, s
""")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each supplier group of an order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 20).alias("s"), F.col("l_linenumber").alias("first_line"))
    return S.distinct_in_order(rows, ["l_orderkey", "s"], ["first_line"])


@query("""
WITH n AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 'NOTE-' || conv_id AS object_id, CASE WHEN conv_id % 6 = 0 AND conv_id % 10 <> 0 THEN 'B' ELSE 'A' || conv_id % 7 END AS authority_id FROM n WHERE conv_id % 3 = 0
""")
def current_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authority over each confidential note, from the history of all of them."""
    led = note_events(spark, sf_dir)
    now = R.confidential_authority(led).select("object_type", "object_id", "authority_id", "effective_sequence")
    first = now.select("object_type", "object_id", F.lit("old").alias("authority_id"), F.lit(-1).cast("long").alias("effective_sequence"))
    return Q.current_authority(now.unionByName(first)).select("object_id", "authority_id")


@query("""
WITH g AS (SELECT user_id, event_id, event_id % 20 AS object_id, event_type, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS revoked FROM events WHERE event_type IN ('signup', 'view'))
SELECT user_id AS operator_id, max(event_id) AS granted_sequence FROM g WHERE revoked IS NULL GROUP BY user_id
""")
def latest_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest open grant of each operator."""
    e = M.intervals(table(spark, sf_dir, "events").filter("event_type in ('signup', 'view')"), ["user_id", "event_type"], "event_id")
    given = e.select(F.col("user_id").alias("operator_id"), F.col("event_id").alias("granted_sequence"), F.col("valid_until").alias("revoked_sequence"))
    return D.latest_open(given, ["operator_id"]).select("operator_id", "granted_sequence")


# Sources and digests


@query(f"""
WITH {LEDGER}, b AS (SELECT *, CASE WHEN event_id % 10 < 6 THEN 0 ELSE 1 END AS batch FROM led)
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY batch, object_id) AS event_sequence, object_id FROM b
""")
def append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of a ledger appended in two batches: the second goes on where the first ended, without what is there already."""
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows, first = ledger(spark, sf_dir).drop("event_sequence"), F.substring("object_id", 3, 12).cast("long") % 10
    spark.createDataFrame([], L.LEDGER).write.parquet(path)
    L.append_events(path, rows.filter(first < 6), order=("object_id",))
    L.append_events(path, rows.filter(first > 2), order=("object_id",))
    return L.read_ledger(spark, path).select("project_id", "event_sequence", "object_id")


@query(f"WITH {FILES} SELECT file_id, content_digest, CASE WHEN doc_id % 3 = 0 THEN 'derived' ELSE 'native' END AS mode, 'files/' || file_id || '/' || doc_id AS output_path FROM fil WHERE doc_id % 4 <> 0")
def export_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presented files exported; the payloads of every third are changed on the way."""
    d = files(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = d.select("file_id", "logical_path", "content_digest", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("payload"), F.when(F.col("doc_id") % 4 == 0, "superseded").otherwise("presented").alias("presentation_state"))
    out = L.export_set(rows, f"{shared_dir(spark)}/export-{uuid.uuid4().hex}", "presented")
    return out.select("file_id", F.col("source_digest").alias("content_digest"), "mode", "output_path")


@query("""
WITH n AS (SELECT s_nationkey AS k, string_agg('{"n":"' || s_suppkey || '","s":"' || s_name || '"}', ',' ORDER BY s_suppkey) AS s FROM supplier GROUP BY s_nationkey),
c AS (SELECT c_nationkey AS k, string_agg('{"c":' || c_custkey || '}', ',' ORDER BY c_custkey) AS c FROM customer GROUP BY c_nationkey)
SELECT printf('P-%03d', coalesce(n.k, c.k)) AS project_id, sha256('{"customers":[' || coalesce(c, '') || '],"suppliers":[' || coalesce(s, '') || ']}') AS state_digest FROM n FULL JOIN c ON n.k = c.k
""")
def ordered_state_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each nation: its suppliers and customers, in fixed order."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    suppliers = s.select(F.format_string("P-%03d", "s_nationkey").alias("project_id"), text("s_suppkey").alias("n"), F.col("s_name").alias("s"))
    customers = c.select(F.format_string("P-%03d", "c_nationkey").alias("project_id"), F.col("c_custkey").alias("c"))
    return H.ordered_state_digest({"suppliers": (suppliers, [F.col("n").cast("long")]), "customers": (customers, ["c"])})


@query("""
WITH d AS (SELECT substr(h, 1, 3) AS b, string_agg(h || ':' || n, ',' ORDER BY h || ':' || n) AS x, sum(n) AS m FROM (SELECT sha256('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}') AS h, count(*) AS n FROM part GROUP BY ALL) y GROUP BY b)
SELECT 'part' AS "table", CAST(sum(m) AS BIGINT) AS n_rows, sha256(string_agg(sha256(x), '' ORDER BY b)) AS digest FROM d
""")
def state_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.state_digest({"part": table(spark, sf_dir, "part").select("p_partkey", "p_name")})


@query("""
SELECT 'FILE-' || doc_id AS file_id, CASE WHEN doc_id % 6 = 0 AND doc_id % 12 <> 0 THEN 'retracted' ELSE 'presented' END AS now, CASE WHEN doc_id % 6 = 0 AND (doc_id % 12 <> 0 OR doc_id * 10 + 2 > m) THEN 'retracted' ELSE 'presented' END AS was
FROM documents, (SELECT (max(doc_id) // 12 * 12) * 10 + 1 AS m FROM documents) x WHERE doc_id * 10 <= m AND (doc_id % 6 <> 0 OR doc_id * 10 + 1 <= m)
""")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files now, and as they were just after the last file whose number is divisible by 12 was retracted, before it was presented again."""
    led, spec = file_events(spark, sf_dir), R.projections()["files"]
    upto = (table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] // 12 * 12) * 10 + 1
    now = R.project(led, spec)
    was = L.snapshot({"files": now}, upto, {}, led)["files"].select("file_id", F.col("presentation_state").alias("was"))
    return now.select("file_id", F.col("presentation_state").alias("now")).join(was, "file_id")


@query(f"""
WITH {LEDGER} SELECT project_id, CAST(count(*) AS BIGINT) AS event_count, arg_max(object_id, seq) AS chain_head, sha256(project_id) AS state_digest FROM led GROUP BY project_id
""")
def write_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of all projects, written and read again."""
    path = f"{shared_dir(spark)}/checkpoints-{uuid.uuid4().hex}"
    led = ledger(spark, sf_dir).withColumn("event_hash", F.col("object_id"))
    L.write_checkpoint(path, led, led.select("project_id").distinct().select("project_id", F.sha2("project_id", 256).alias("state_digest")))
    return spark.read.parquet(path).select("project_id", "event_count", "chain_head", "state_digest")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS export_id, CAST(count(*) AS BIGINT) AS n_items FROM lineitem GROUP BY l_orderkey UNION ALL SELECT 'bad', 1")
def read_export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of all exports written as JSON, one file of another schema among them, and read again."""
    items = R.export_items(export_events(spark, sf_dir)).groupBy("export_id").agg(F.collect_list(F.struct("file_id", "output_path", "source_digest", "output_digest", "mode")).alias("items"))
    path = f"{shared_dir(spark)}/manifests-{uuid.uuid4().hex}"
    rows = items.select(F.lit("manifest/v1").alias("schema"), "export_id", F.lit("P").alias("project_id"), F.lit("A").alias("actor_id"), F.lit("full").alias("view_mode"), "items")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    spark.range(1).select(F.lit('{"schema":"other","export_id":"x"}').alias("value")).write.mode("append").text(path)
    held, found = L.read_export_manifest(spark, path, "manifest/v1", multi_line=False)
    return held.groupBy("export_id").agg(F.count("*").alias("n_items")).unionByName(found.groupBy().agg(F.count("*").alias("n_items")).select(F.lit("bad").alias("export_id"), "n_items"))

