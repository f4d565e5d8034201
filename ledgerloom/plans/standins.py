"""Ledger-shaped frames derived from the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import iso_utc

# The export life cycle that event types stand for.
EXPORT_TYPES = {"signup": "EXPORT_STARTED", "purchase": "EXPORT_COMPLETED", "error": "EXPORT_FAILED"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a ledger without hashes: a project is a user, sequences are dense in each."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    null = F.lit(None).cast("string")
    return e.select(
        F.format_string("P-%06d", "user_id").alias("project_id"), seq.alias("event_sequence"), iso_utc("ts").alias("occurred_at"), F.upper("event_type").alias("event_type"), F.lit("event").alias("object_type"),
        F.format_string("E-%06d", "event_id").alias("object_id"), F.lit("system").alias("actor_kind"), null.alias("actor_id"), null.alias("actor_uuid"), null.alias("credential_fingerprint"),
        F.lit("system").alias("authority_basis"), F.replace("props", F.lit(" "), F.lit("")).alias("details_json"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a catalogue of files."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.format_string("FILE-%06d", "doc_id").alias("file_id"), F.col("source").alias("case_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("logical_path"), F.sha2("text", 256).alias("content_digest"), F.octet_length("text").cast("long").alias("size_bytes"), "lang", "doc_id")


def scope_tables(spark: SparkSession, sf_dir: str, f: DataFrame, number: Column, name: Callable[[Column], Column], artefact: str = "ART") -> dict[str, DataFrame]:
    """The tables that scopes are resolved with, f being files and number their documents': artefacts of each odd file,
    relations of each file to the one of twice its number, conversations as notes and suppliers as exports of files."""
    artefacts = f.filter(number % 2 == 1).select(F.concat(F.lit(f"{artefact}-"), number.cast("string")).alias("artefact_id"), "file_id")
    notes = table(spark, sf_dir, "conversations").select(F.concat(F.lit("NOTE-"), F.col("conv_id").cast("string")).alias("note_id"), name(F.col("conv_id") * 3 + F.col("turn")).alias("file_id"))
    exports = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("EXPORT-"), F.col("l_suppkey").cast("string")).alias("export_id"), name(F.col("l_partkey")).alias("file_id"))
    edges = f.select(F.col("file_id").alias("parent_file_id"), name(number * 2).alias("child_file_id"))
    return {"files": f, "artefact_files": artefacts, "note_revisions": notes, "export_items": exports, "file_relationships": edges}


def export_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the life cycles of exports, one export for each user."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*EXPORT_TYPES))
    kind = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in EXPORT_TYPES.items()])
    text = F.format_string("%.2f", "value")
    body = F.struct(text.alias("scope_type"), F.col("props").alias("view_mode"), text.alias("manifest_digest"), F.col("event_id").cast("string").alias("output_digest"))
    details = F.to_json(F.struct(F.struct(F.concat(F.lit("OP-"), F.col("user_id").cast("string")).alias("actor_id"), body.alias("data")).alias("authority_transaction")))
    return e.select(F.lit("P").alias("project_id"), (F.col("event_id") + 1).alias("event_sequence"), kind.alias("event_type"), F.lit("export").alias("object_type"), F.format_string("EXP-%06d", "user_id").alias("object_id"), details.alias("details_json"))


def text(c: str) -> Column:
    return F.col(c).cast("string")


def event(rows: DataFrame, kind: str, object_type: str, object_id: Column, seq: Column, data: dict[str, Column], actor: Column | None = None, project: Column | None = None, signed: bool = True) -> DataFrame:
    """A ledger event for each row: its data as details, in the envelope of a signed transaction unless told otherwise."""
    actor = F.lit(None).cast("string") if actor is None else actor
    body = F.struct(*[c.alias(n) for n, c in data.items()]) if data else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    details = F.struct(F.struct(actor.alias("actor_id"), body.alias("data")).alias("authority_transaction")) if signed else body
    return rows.select(
        (F.lit("P") if project is None else project).alias("project_id"), seq.cast("long").alias("event_sequence"), F.lit(kind).alias("event_type"), F.lit(object_type).alias("object_type"), object_id.alias("object_id"), actor.alias("actor_id"), F.to_json(details).alias("details_json"),
    )
