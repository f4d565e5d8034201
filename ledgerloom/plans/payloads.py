"""Queries of files as payloads and manifests: written from the provided tables, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checkin as B
from ..operators import scopes as Q
from ..operators import verify as V
from ..sources import ledger as L
from ..sources.shared import shared_dir
from .registry import ORACLE_SQL, query
from .replays import replay_export_policy
from .standins import table, text


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def by_source(spark: SparkSession, sf_dir: str, line: Column, name: str) -> str:
    """The path of a folder with a text file for each source: a line for each of its documents, in the order of their ids."""
    path = folder(spark, name)
    rows = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("of"), "doc_id", line.alias("line"))
    rows.repartition("of").sortWithinPartitions("of", "doc_id").drop("doc_id").write.partitionBy("of").text(path)
    return path


def source_of(path: str) -> Column:
    return F.regexp_extract(path, "of=([^/]*)/", 1)


@query("""
WITH f AS (SELECT source, string_agg(doc_id || ' ' || lang || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY source)
SELECT source, CAST(octet_length(encode(body)) AS BIGINT) AS size_bytes, sha256(body) AS content_digest FROM f
""")
def scan_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each source, those of more than 500 bytes in blocks."""
    path = by_source(spark, sf_dir, F.concat_ws(" ", text("doc_id"), "lang"), "payloads")
    return L.scan_payloads(spark, path, whole=500).select(source_of("path").alias("source"), "size_bytes", "content_digest")


@query("""
WITH l AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM documents)
SELECT 'path' AS kind, 'd/' || doc_id AS key, sha256(CAST(doc_id AS VARCHAR)) AS value FROM l WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0
UNION ALL SELECT 'malformed-line', source || ':' || number, 'no digest ' || doc_id FROM l WHERE doc_id % 13 = 0
""")
def read_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each source, with lines that are none and empty ones among its lines."""
    n, key = F.col("doc_id"), text("doc_id")
    line = F.when(n % 13 == 0, F.concat(F.lit("no digest "), key)).when(n % 17 == 0, "").otherwise(F.concat(F.sha2(key, 256), F.lit("  d/"), key))
    good, bad = L.read_manifest(spark, by_source(spark, sf_dir, line, "manifests"))
    held = good.select(F.lit("path").alias("kind"), F.col("path").alias("key"), F.col("content_digest").alias("value"))
    return held.unionByName(bad.select(F.col("rule").alias("kind"), F.concat_ws(":", source_of("target"), "key").alias("key"), F.col("actual").alias("value")))


@query("SELECT 'd/' || source || '/' || doc_id AS path, sha256(text) AS content_digest FROM documents")
def write_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' manifest, written in four parts and read back."""
    path = folder(spark, "manifest")
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("d"), "source", text("doc_id")).alias("path"), F.sha2("text", 256).alias("content_digest"))
    L.write_manifest(files, path, parts=4)
    return L.read_manifest(spark, path)[0]


@query(ORACLE_SQL["replay_export_policy"])
def export_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy in force in each project, among drafts under other names."""
    held = replay_export_policy(spark, sf_dir)
    drafts = held.withColumns({"policy_id": F.concat(F.lit("draft-"), "project_id"), "ordinary_export": F.lit("members")})
    return Q.export_policy(held.unionByName(drafts))


@query("""
WITH f AS (SELECT doc_id, doc_id % 50 AS b, row_number() OVER (ORDER BY 'b' || doc_id % 50, 'd/' || doc_id) AS n FROM documents WHERE doc_id % 50 <> 3)
SELECT printf('FILE-%06d', n) AS file_id, 'd/' || doc_id AS logical_path, 'files/b' || b || '/' || printf('FILE-%06d', n) || '/' || doc_id AS storage_path, NULL AS about FROM f
UNION ALL SELECT printf('FILE-%06d', n) || '-note', 'd/' || doc_id || '.note', 'files/b' || b || '/' || printf('FILE-%06d', n) || '/' || doc_id || '.note', printf('FILE-%06d', n) FROM f WHERE doc_id % 5 = 0
""")
def checkin_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents checked in by batches, with a note added for every fifth in the same commit; one batch is refused, its notes too."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("b"), (F.col("doc_id") % 50).cast("string")).alias("batch_id"), F.concat(F.lit("d/"), text("doc_id")).alias("logical_path"), F.col("text").cast("binary").alias("payload"), F.when(F.col("doc_id") % 50 == 3, "other").alias("copied_digest"), "doc_id")
    prepared, found = B.prepare_batch(rows)
    counters = spark.range(1).select(F.lit("file").alias("namespace"), F.lit("FILE").alias("prefix"), F.lit(1).alias("next_value"))

    def with_notes(committed: DataFrame) -> DataFrame:
        own = committed.withColumn("about", F.lit(None).cast("string"))
        notes = own.filter("doc_id % 5 = 0").withColumns({"about": F.col("file_id"), "file_id": F.concat("file_id", F.lit("-note")), "logical_path": F.concat("logical_path", F.lit(".note")), "storage_path": F.concat("storage_path", F.lit(".note"))})
        return own.unionByName(notes)

    return B.commit_batch(prepared, found, counters, with_notes).select("file_id", "logical_path", "storage_path", "about")


@query("""
SELECT 'missing' AS rule, 'd/' || doc_id AS key FROM documents WHERE doc_id % 31 = 0 OR doc_id % 37 = 0
UNION ALL SELECT 'unexpected-link', 'd/' || doc_id FROM documents WHERE doc_id % 31 = 0
UNION ALL SELECT 'special-member', 'd/' || doc_id FROM documents WHERE doc_id % 31 <> 0 AND doc_id % 37 = 0
UNION ALL SELECT 'changed', 'd/' || doc_id FROM documents WHERE doc_id % 31 <> 0 AND doc_id % 37 <> 0 AND doc_id % 41 = 0
UNION ALL SELECT 'unsafe-member', '/dirs/' || source FROM (SELECT DISTINCT source FROM documents) x
""")
def verify_package_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members of a package: some are links or devices, some are changed; the directories have absolute paths."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    manifest = d.select(F.concat(F.lit("d/"), text("doc_id")).alias("path"), F.sha2("text", 256).alias("content_digest"))
    seen = d.select(F.concat(F.lit("d/"), text("doc_id")).alias("path"), F.when(n % 41 == 0, "x").otherwise(F.sha2("text", 256)).alias("content_digest"), F.when(n % 31 == 0, "symlink").when(n % 37 == 0, "device").otherwise("file").alias("kind"))
    dirs = d.select(F.concat(F.lit("/dirs/"), "source").alias("path"), F.lit(None).cast("string").alias("content_digest"), F.lit("directory").alias("kind")).distinct()
    return V.verify_package(manifest, seen.unionByName(dirs)).select("rule", "key")
