"""Members of groups, a row each, and long texts in parts, over the provided tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain as C
from ..operators import checkin as B
from ..operators import members as M
from ..operators.findings import report_parts, summarise_findings
from ..operators.verify import verify_files
from ..sources import ledger as L
from .registry import LEDGER, query
from .standins import ledger, table
from .verifiers import LIVE, live_files, number


@query("SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS ordinal, l_orderkey, l_linenumber FROM lineitem")
def member_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each supplier in the order of orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return M.ordinals(lines, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"]).drop("l_partkey")


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal, o_orderkey FROM orders")
def member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer by date."""
    return M.member_rows(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("""
WITH n AS (SELECT c_mktsegment, c_name, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name, c_custkey) - 1) // 100 + 1 AS part FROM customer)
SELECT c_mktsegment, CAST(part AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n, string_agg(c_name, ',' ORDER BY c_name) AS text FROM n GROUP BY c_mktsegment, part
""")
def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each market segment as a text, in parts of a hundred names."""
    return M.text_parts(table(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_name", "c_custkey"], "c_name", ",", 100)


@query("""
WITH a AS (SELECT source, lang, count(*) AS n_files, 'ARTEFACT-' || printf('%06d', row_number() OVER (ORDER BY source NULLS FIRST, lang NULLS FIRST)) AS artefact_id FROM documents GROUP BY source, lang),
m AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS ordinal FROM documents)
SELECT a.source AS batch_id, a.lang AS role, n_files, artefact_id, ordinal, doc_id FROM a JOIN m ON a.source IS NOT DISTINCT FROM m.source AND a.lang IS NOT DISTINCT FROM m.lang
""")
def artefact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artefact for each language of a source, and its documents, a row each."""
    f = table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id"), F.col("lang").alias("role"), F.col("doc_id").alias("file_id"), F.col("doc_id").alias("logical_path"))
    counters = spark.range(1).select(F.lit("artefact").alias("namespace"), F.lit("ARTEFACT").alias("prefix"), F.lit(1).alias("next_value"))
    made, members = B.artefact_rows(f, counters)
    return made.join(members.withColumnRenamed("file_id", "doc_id"), "artefact_id")


@query("""
SELECT source AS batch_id, count(*) OVER (PARTITION BY source) AS n_files, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal, doc_id, upper(source) AS record FROM documents WHERE source IS NOT NULL
""")
def acquisition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents in order, a row each, with its record."""
    f = table(spark, sf_dir, "documents").filter("source is not null").select(F.col("source").alias("batch_id"), F.col("doc_id").alias("file_id"))
    heads, members = B.acquisition_rows(f, f.select("batch_id", F.upper("batch_id").alias("record")).distinct())
    return members.join(heads, "batch_id").withColumnRenamed("file_id", "doc_id")


@query(f"""
WITH {LIVE}, t AS (SELECT doc_id % 9 AS g, doc_id FROM documents), x AS (SELECT g, '  ' || rule || ' FILE-' || doc_id AS line, (row_number() OVER (PARTITION BY g ORDER BY rule, 'FILE-' || doc_id) - 1) // 10 + 1 AS part FROM t JOIN bad ON n = doc_id WHERE rule <> 'changed')
SELECT CAST(g AS VARCHAR) AS target, CAST(0 AS BIGINT) AS part, 'Target: ' || g || chr(10) || 'Status: ' || CASE WHEN count(line) = 0 THEN 'VERIFIED' ELSE 'FAILED' END || chr(10) || 'Findings: ' || count(line) AS value FROM (SELECT DISTINCT g FROM t) s LEFT JOIN x USING (g) GROUP BY g
UNION ALL SELECT CAST(g AS VARCHAR), CAST(part AS BIGINT), string_agg(line, chr(10) ORDER BY line) FROM x GROUP BY g, part
""")
def detailed_report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on nine groups of files with all their findings, in parts of ten lines."""
    found = verify_files(*live_files(spark, sf_dir)).filter("rule <> 'changed'")
    found = found.withColumns({"target": (number("key") % 9).cast("string"), "column": F.lit(None).cast("string")})
    groups = table(spark, sf_dir, "documents").select((F.col("doc_id") % 9).cast("string").alias("g")).distinct()
    return report_parts(summarise_findings(found, groups, "g"), found, 10)


@query(f"""
WITH {LEDGER}, s AS (SELECT project_id, count(*) AS n, arg_max(object_id, seq) AS head, arg_max(occurred_at, seq) AS t FROM led GROUP BY project_id),
h AS (SELECT project_id, object_id, row_number() OVER (PARTITION BY project_id ORDER BY object_id) AS place, count(*) OVER (PARTITION BY project_id) AS k FROM led WHERE event_type = 'ERROR'),
p AS (SELECT project_id, (place - 1) // 3 + 1 AS part, (max(k) + 2) // 3 AS last, string_agg('"' || object_id || '"', ',' ORDER BY object_id) AS ids FROM h GROUP BY project_id, (place - 1) // 3)
SELECT s.project_id, CAST(0 AS BIGINT) AS part, '{{"schema":"package/v1","project_id":"' || s.project_id || '","event_count":' || n || ',"chain_head":"' || head || '","state_digest":"' || sha256(head) || '","state_timestamp":"' || t
       || '","included_roots":["files","cases"],"withheld_file_ids":[' || CASE WHEN s.project_id IN (SELECT project_id FROM h) THEN '' ELSE ']}}' END AS text FROM s
UNION ALL SELECT project_id, CAST(part AS BIGINT), CASE WHEN part > 1 THEN ',' ELSE '' END || ids || CASE WHEN part = last THEN ']}}' ELSE '' END FROM p
""")
def descriptor_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' ledgers as packages that withhold what failed; descriptors in parts of three ids."""
    led = ledger(spark, sf_dir)
    now = C.ledger_summary(led, head="object_id")
    held = led.filter("event_type = 'ERROR'").select("project_id", F.col("object_id").alias("file_id"))
    return L.descriptor_parts(now, now.select("project_id", F.sha2("chain_head", 256).alias("state_digest")), held, most=3)
