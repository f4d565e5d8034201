"""Batch check-in of files: candidates, preparation, all-or-none commit, relations, acquisitions, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..functions.text import has_reason, is_safe_path, is_transient, merge_record, normalise_path, safe_leaf, storage_path
from ..sources.shared import written
from .findings import finding, row_findings
from .matching import resolve_endpoints
from .members import member_rows, ordinals
from .sets import assign_ids, ordered_members


def build_candidates(found: DataFrame, registered: DataFrame, allowed: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Found files (batch_id, logical_path, ...) that are registered or allowed, and findings for those left over.

    Files that are still being written are neither.
    """
    rows = found.filter(~is_transient("logical_path"))
    named = registered.select("batch_id", "logical_path").distinct().withColumn("_known", F.lit(True))
    marked = rows.join(named, ["batch_id", "logical_path"], "left").withColumn("_known", F.coalesce("_known", F.col("logical_path").isin(*allowed)))
    left = finding(marked.filter(~F.col("_known")), F.col("batch_id"), "unregistered", F.col("logical_path"))
    return marked.filter("_known").drop("_known"), left


def prepare_batch(candidates: DataFrame, algorithm: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """Candidates (batch_id, logical_path, payload, copied_digest) with normalised paths, digests and sizes, and findings:
    unsafe and doubled paths, and copies whose digest is not that of the payload."""
    rows = candidates.withColumns({"logical_path": normalise_path("logical_path"), "content_digest": digest("payload", algorithm), "size_bytes": F.octet_length("payload").cast("long")})
    unsafe = finding(rows.filter(~is_safe_path("logical_path")), F.col("batch_id"), "unsafe-path", F.col("logical_path"))
    counts = rows.groupBy("batch_id", "logical_path").count().filter("count > 1")
    doubled = finding(counts, F.col("batch_id"), "doubled-path", F.col("logical_path"), actual=F.col("count"))
    differs = rows.filter(F.col("copied_digest").isNotNull() & ~F.col("copied_digest").eqNullSafe(F.col("content_digest")))
    copied = finding(differs, F.col("batch_id"), "copy-differs", F.col("logical_path"), "content_digest", F.col("content_digest"), F.col("copied_digest"))
    return rows, unsafe.unionByName(doubled).unionByName(copied)


def commit_batch(prepared: DataFrame, findings: DataFrame, counters: DataFrame, extend=None) -> DataFrame:
    """The rows of batches without any finding, with file ids going on after the counter and their storage paths.

    A batch is committed as a whole or not at all. `extend` may add rows or columns to what is committed.
    """
    clean = prepared.join(findings.select(F.col("target").alias("batch_id")).distinct(), "batch_id", "left_anti").withColumn("_namespace", F.lit("file"))
    numbered = assign_ids(clean, counters, "_namespace", ["batch_id", "logical_path"]).withColumnRenamed("identifier", "file_id").drop("_namespace", "number")
    rows = numbered.withColumn("storage_path", storage_path(F.lit("files"), "batch_id", "file_id", safe_leaf("logical_path")))
    return rows.transform(extend) if extend else rows


def complete_results(registered: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings for collector results: registered paths (batch_id, logical_path) outside the batch's root, and relationships
    (batch_id, parent_path, child_path, relationship) with an end that is not registered, without a label, or with a
    label but no end."""
    outside = finding(registered.filter(~is_safe_path(normalise_path("logical_path"))), F.col("batch_id"), "outside-root", F.col("logical_path"))
    known = lambda c: registered.select("batch_id", F.col("logical_path").alias(c), F.lit(True).alias(f"_{c}")).distinct()
    ends = edges.join(known("parent_path"), ["batch_id", "parent_path"], "left").join(known("child_path"), ["batch_id", "child_path"], "left")
    both, label = F.col("parent_path").isNotNull() & F.col("child_path").isNotNull(), has_reason("relationship")
    return outside.unionByName(row_findings(ends, F.col("batch_id"), F.concat_ws(">", F.coalesce("parent_path", F.lit("-")), F.coalesce("child_path", F.lit("-"))), [
        ("unknown-parent", F.col("parent_path").isNotNull() & F.col("_parent_path").isNull(), None, None, None), ("unknown-child", F.col("child_path").isNotNull() & F.col("_child_path").isNull(), None, None, None),
        ("no-label", both & ~label, "relationship", None, F.col("relationship")), ("label-without-end", ~both & label, "relationship", None, F.col("relationship")),
    ]))


def relate(committed: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relationships by path as relationships by file id, and findings for ends that were not committed."""
    return resolve_endpoints(edges, committed)


def group_artefacts(committed: DataFrame, counters: DataFrame, group: str = "role") -> DataFrame:
    """(batch_id, group, artefact_id, file_ids): an artefact for each group of a batch's files."""
    keyed = committed.withColumn("_g", F.struct("batch_id", group))
    members = ordered_members(keyed, "_g", "logical_path", "file_id", "file_ids").select("_g.*", "file_ids").withColumn("_namespace", F.lit("artefact"))
    return assign_ids(members, counters, "_namespace", ["batch_id", group]).withColumnRenamed("identifier", "artefact_id").drop("_namespace", "number")


def artefact_rows(committed: DataFrame, counters: DataFrame, group: str = "role") -> tuple[DataFrame, DataFrame]:
    """Artefacts (batch_id, group, artefact_id, n_files), one for each group of a batch's files, and their members
    (artefact_id, ordinal, file_id) by path, a row each: what group_artefacts gives, for groups of any size."""
    counted = committed.groupBy("batch_id", group).agg(F.count("*").alias("n_files")).withColumn("_namespace", F.lit("artefact"))
    made = assign_ids(counted, counters, "_namespace", ["batch_id", group]).withColumnRenamed("identifier", "artefact_id").select("batch_id", group, "artefact_id", "n_files")
    made = written(made, "artefacts")
    placed = ordinals(committed.select("batch_id", group, "logical_path", "file_id"), ["batch_id", group], ["logical_path", "file_id"])
    ids = made.select(F.col("batch_id").alias("_batch"), F.col(group).alias("_group"), "artefact_id")
    members = placed.join(ids, F.col("batch_id").eqNullSafe(F.col("_batch")) & F.col(group).eqNullSafe(F.col("_group")))
    return made, members.select("artefact_id", "ordinal", "file_id")


def acquisition_rows(committed: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Acquisitions (batch_id, n_files, record) and their files (batch_id, ordinal, file_id), a row each: what
    record_acquisition gives, for batches of any size."""
    counted = committed.groupBy("batch_id").agg(F.count("*").alias("n_files")).join(records, "batch_id", "left")
    return counted, member_rows(committed, ["batch_id"], "file_id", "file_id")


def record_acquisition(committed: DataFrame, records: DataFrame) -> DataFrame:
    """(batch_id, file_ids, record): each batch's files in order, with its provenance record."""
    return ordered_members(committed, "batch_id", "file_id", "file_id", "file_ids").join(records, "batch_id", "left")


def provenance_record(batches: DataFrame, defaults: str = "defaults", source: str = "source", result: str = "result") -> DataFrame:
    """batches with record: three maps merged, the later ones' values win."""
    return batches.withColumn("record", merge_record(merge_record(defaults, source), result))


def batch_summary(prepared: DataFrame, committed: DataFrame) -> DataFrame:
    """(batch_id, n_files, status)."""
    asked = prepared.groupBy("batch_id").agg(F.count("*").alias("n"))
    done = committed.groupBy("batch_id").agg(F.count("*").alias("n_files"))
    return asked.join(done, "batch_id", "left").select("batch_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.when(F.col("n_files") == F.col("n"), "committed").otherwise("refused").alias("status"))
