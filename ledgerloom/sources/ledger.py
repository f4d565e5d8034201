"""Sources and sinks: ledgers, payloads, manifests, metadata, exports, checkpoints."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import digest, hasher
from ..operators.chain import append_guard, assign_sequences, chain_parts, ledger_summary
from ..operators.findings import finding
from ..operators.members import PART, text_parts

# Payloads of more bytes than WHOLE are read in blocks of BLOCK bytes.
WHOLE, BLOCK = 1 << 28, 1 << 20
LEDGER = T.StructType(
    [T.StructField("project_id", T.StringType()), T.StructField("event_sequence", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("occurred_at", "event_type", "object_type", "object_id", "actor_kind", "actor_id", "actor_uuid", "credential_fingerprint", "authority_basis", "details_json", "previous_hash", "event_hash")]
)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType = LEDGER) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def scan_payloads(spark: SparkSession, path: str, algorithm: str = "sha256", only: DataFrame | None = None, whole: int = WHOLE) -> DataFrame:
    """(path, size_bytes, content_digest) of files of any size. `only` (path) limits what is read before any byte is.

    Files of at most `whole` bytes are read as one value each. Larger ones are read in blocks of BLOCK bytes inside tasks,
    one file a task at a time, through pyarrow's file systems.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Scans leave files without a byte out; the reader's own list of files has them.
    listed = [re.sub("^([a-z0-9]+):///", r"\1:/", unquote(p)) for p in files.inputFiles()]
    empty = spark.createDataFrame([(p,) for p in listed], "path string").join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    files = files.select("path", "length", "content").unionByName(empty)
    if only is not None:
        files = files.join(F.broadcast(only.select("path")) if only.count() < 100_000 else only.select("path"), "path", "left_semi")
    small = files.filter(F.col("length") <= whole).select("path", F.col("length").alias("size_bytes"), digest("content", algorithm).alias("content_digest"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [digest_file(p, algorithm) for p in batch["path"]]
            yield pd.DataFrame({"path": batch["path"], "size_bytes": [n for n, _ in found], "content_digest": [d for _, d in found]})

    large = files.filter(F.col("length") > whole).select("path").repartition("path")
    return small.unionByName(large.mapInPandas(read, "path string, size_bytes bigint, content_digest string"))


def digest_file(path: str, algorithm: str, block: int = BLOCK) -> tuple[int, str]:
    """(bytes, digest) of one file, a block at a time."""
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(quote(re.sub("^file:/(?!/)", "file:///", path), safe=":/"))
    state, n = hasher(algorithm)(), 0
    with fs.open_input_stream(at, buffer_size=0) as stream:
        while data := stream.read(block):
            state.update(data)
            n += len(data)
    return n, state.hexdigest()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line) of text files, lines numbered from 1 in each, empty ones too.

    Spark reads a large file in splits, each in order. How many lines a split has and which are before it comes from one
    row a split; no line is shuffled.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    splits = lines.groupBy("file", "_start").agg(F.min("_row").alias("_first"), F.count("*").alias("_lines"))
    before = F.sum("_lines").over(Window.partitionBy("file").orderBy("_start")) - F.col("_lines")
    offsets = splits.select("file", "_start", (before - F.col("_first") + 1).alias("_offset"))
    return lines.join(offsets, ["file", "_start"]).select("file", (F.col("_row") + F.col("_offset")).alias("number"), F.regexp_replace("value", "\\r$", "").alias("line"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, content_digest) of lines `<hex>  <path>`, and findings for other lines that are not empty, by their number."""
    pattern = r"^([0-9a-f]{64,128})  (.+)$"
    lines = spark.read.text(path).withColumn("line", F.regexp_replace("value", "\\r$", ""))
    good = lines.filter(F.col("line").rlike(pattern)).select(F.regexp_extract("line", pattern, 2).alias("path"), F.regexp_extract("line", pattern, 1).alias("content_digest"))
    bad = numbered_lines(spark, path).filter(~F.col("line").rlike(pattern) & (F.length(F.trim("line")) > 0))
    return good, finding(bad, F.col("file"), "malformed-line", F.col("number"), "line", actual=F.col("line"))


def write_manifest(files: DataFrame, path: str, name: str = "path", content: str = "content_digest", parts: int = 1) -> None:
    """Lines `<hex>  <path>` in the order of paths, in one file, or in several that are one manifest in the order of their
    names: each is written by a task of its own."""
    lines = files.select(name, F.concat_ws("  ", content, name).alias("value"))
    lines.repartitionByRange(parts, name).sortWithinPartitions(name).select("value").write.text(path)


def strange_schemas(documents: DataFrame, schema_name: str) -> DataFrame:
    """Findings for documents (_file, schema) of another schema than the one that is read, or of none."""
    return finding(documents.filter(~F.col("schema").eqNullSafe(F.lit(schema_name))), F.col("_file"), "unsupported-schema", F.col("_file"), "schema", F.lit(schema_name), F.col("schema"))


def read_export_manifest(spark: SparkSession, path: str, schema_name: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """The items of export manifests of a schema, one row each, and findings for those of other schemas. A file is a manifest, or with multi_line off each line is one."""
    item = "file_id string, output_path string, source_digest string, output_digest string, mode string, classification string, case_id string, acquisition_id string, logical_path string"
    shape = f"schema string, export_id string, project_id string, actor_id string, view_mode string, source_project struct<event_count:bigint,chain_head:string,state_digest:string>, items array<struct<{item.replace(' ', ':').replace(',:', ',')}>>"
    manifests = spark.read.schema(shape).option("multiLine", multi_line).option("mode", "FAILFAST").json(path).withColumn("_file", F.input_file_name())
    items = manifests.filter(F.col("schema") == schema_name).select("export_id", "project_id", "actor_id", "view_mode", "source_project", F.explode("items").alias("item")).select("*", "item.*").drop("item")
    return items, strange_schemas(manifests, schema_name)


def promote_metadata(df: DataFrame, json_col: str, fields: tuple[str, ...] = ("title", "channel", "upload_date", "id")) -> DataFrame:
    """df with fields of a JSON column, and observation: why nothing could be read, else null."""
    parsed = F.from_json(json_col, ", ".join(f"{f} string" for f in fields) + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = df.withColumn("_m", parsed)
    bad = F.col("_m").isNull() | F.col("_m._corrupt_record").isNotNull()
    return rows.select(*df.columns, *[F.when(~bad, F.col(f"_m.{f}")).alias(f) for f in fields], F.when(F.col(json_col).isNull(), "no metadata").when(bad, "metadata is no JSON object").alias("observation"))


def read_review_layers(spark: SparkSession, path: str, schema_name: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """The annotations and proposed redactions of review layers, one row each (original_sha256, original_width,
    original_height, created_utc, layer, id, kind, note, label, reason, category, geometry), and findings for files of other
    schemas. geometry holds what is a number; an annotation's whole geometry is text in geometry_json. A
    file is one layer, or with lines=True each line of it is."""
    annotation = "struct<annotation_id:string,kind:string,geometry:string,note:string,label:string>"
    redaction = "struct<redaction_id:string,box:struct<x:double,y:double,width:double,height:double>,reason:string,category:string>"
    shape = f"schema string, original_sha256 string, original_width bigint, original_height bigint, created_utc string, annotations array<{annotation}>, proposed_redactions array<{redaction}>"
    every = spark.read.schema(shape).option("multiLine", not lines).option("mode", "FAILFAST").json(path).withColumn("_file", F.input_file_name())
    layers, none = every.filter(F.col("schema") == schema_name), F.lit(None).cast("string")
    head = ["original_sha256", "original_width", "original_height", "created_utc"]
    numbers = F.map_filter(F.transform_values(F.from_json("x.geometry", "map<string,string>"), lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    notes = layers.select(*head, F.explode("annotations").alias("x")).select(*head, F.lit("annotation").alias("layer"), F.col("x.annotation_id").alias("id"), "x.kind", "x.note", "x.label", none.alias("reason"), none.alias("category"), numbers.alias("geometry"), F.col("x.geometry").alias("geometry_json"))
    box = F.create_map(*[part for k in ("x", "y", "width", "height") for part in (F.lit(k), F.col(f"x.box.{k}"))])
    cuts = layers.select(*head, F.explode("proposed_redactions").alias("x")).select(*head, F.lit("redaction").alias("layer"), F.col("x.redaction_id").alias("id"), F.lit("box").alias("kind"), none.alias("note"), none.alias("label"), "x.reason", "x.category", box.alias("geometry"), F.to_json("x.box").alias("geometry_json"))
    return notes.unionByName(cuts), strange_schemas(every, schema_name)


def snapshot(tables: dict[str, DataFrame], upto: int, seq: dict[str, str], ledger: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows of each table that were there at a sequence; with a ledger, tables of projections() are replayed up to it."""
    from ..operators.replay import project, projections

    specs = projections() if ledger is not None else {}
    past = ledger.filter(F.col("event_sequence") <= upto) if ledger is not None else None
    return {name: project(past, specs[name]) if name in specs else df.filter(F.col(seq[name]) <= upto) if name in seq else df for name, df in tables.items()}


def append_events(ledger_path: str, events: DataFrame, key_col: str = "project_id", id_cols: tuple[str, ...] | None = None, schema: str = "audit-event/v3", expected: DataFrame | None = None, order: tuple[str, ...] = ("occurred_at", "object_id", "event_type")) -> int:
    """Chain new events on to the ledger at a path and append them; events that are there already are left out.

    Returns how many were appended. The first link of each key's new part takes up the head that the ledger has. An
    event is known by id_cols if they are given, else by all its columns and its number among equal ones, so a batch
    that is tried again adds nothing and no two different events are taken for one; nulls are equal. With expected
    (key, expected_count, expected_head) nothing is appended when the ledger has moved on: ValueError.
    """
    from ..functions.hashing import envelope

    spark = events.sparkSession
    held = read_ledger(spark, ledger_path)
    heads = ledger_summary(held)
    if expected is not None and not append_guard(expected, heads, key_col).isEmpty():
        raise ValueError("the ledger has another head than the batch was made for")
    made = ("event_sequence", "previous_hash", "event_hash")
    own = list(id_cols) if id_cols else [f.name for f in LEDGER if f.name not in made]
    name = F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)
    numbered = lambda df: df.withColumn("_id", name).withColumn("_nth", F.row_number().over(Window.partitionBy("_id").orderBy(F.lit(1))) if not id_cols else F.lit(1))
    new = numbered(events).join(numbered(held).select("_id", "_nth"), ["_id", "_nth"], "left_anti").drop("_id", "_nth")
    rows = assign_sequences(new, heads, list(order))
    head, tail = envelope(schema, "sha256")
    known = heads.select(key_col, F.col("chain_head").alias("_start"))
    started = rows.join(known, key_col, "left").withColumn("_start", F.coalesce("_start", F.lit("0" * 64)))
    chained = chain_parts(started, key_col, "event_sequence", head, tail, start="_start").drop("_start")
    out = chained.select([f.name for f in LEDGER])
    from .shared import written

    kept = written(out, "new-events")
    kept.write.mode("append").parquet(ledger_path)
    return kept.count()


def write_checkpoint(path: str, ledger: DataFrame, state_digest: DataFrame) -> None:
    """Append a row (key, event_count, chain_head, last_event_at, state_digest) for each key. state_digest: (project_id, state_digest)."""
    ledger_summary(ledger).join(state_digest, "project_id", "left").write.mode("append").parquet(path)


def export_set(files: DataFrame, out: str, view: str = "full", partition: str | None = None, transform=None) -> DataFrame:
    """Write the files of a view and return the item manifest (file_id, output_path, source_digest, output_digest, mode).

    mode is `native`, or `derived` for payloads that transform (a column function of the payload) changes.
    """
    from ..functions.text import safe_leaf, strip_suffix

    rows = files if view == "full" else files.filter("presentation_state = 'presented'")
    rows = rows.withColumn("payload", transform(F.col("payload"))) if transform else rows
    rows = rows.withColumns({"output_path": F.concat_ws("/", F.lit("files"), "file_id", strip_suffix(safe_leaf("logical_path"))), "output_digest": digest("payload")})
    rows = rows.withColumn("mode", F.when(F.col("output_digest").eqNullSafe(F.col("content_digest")), "native").otherwise("derived"))
    writer = rows.write.partitionBy(partition) if partition else rows.write
    writer.parquet(out)
    return rows.select("file_id", "output_path", F.col("content_digest").alias("source_digest"), "output_digest", "mode")


def package_inventory(files: DataFrame, withheld: DataFrame) -> DataFrame:
    """(file_id, storage_path, content_digest, included): a package's files, those withheld named but not included."""
    held = withheld.select("file_id").distinct().withColumn("_held", F.lit(True))
    return files.join(held, "file_id", "left").select("file_id", "storage_path", "content_digest", F.col("_held").isNull().alias("included"))


def package_descriptor(summary: DataFrame, state_digest: DataFrame, withheld: DataFrame, schema: str = "package/v1", roots: tuple[str, ...] = ("files", "cases")) -> DataFrame:
    """(project_id, descriptor): a JSON description of each project's package: counts, head, state digest and time of the
    ledger (from ledger_summary and state_digest), what it includes, and the ids of withheld files (project_id, file_id) in order."""
    held = withheld.groupBy("project_id").agg(F.sort_array(F.collect_set("file_id")).alias("withheld_file_ids"))
    rows = summary.join(state_digest.select("project_id", "state_digest"), "project_id", "left").join(held, "project_id", "left")
    return rows.select("project_id", described(schema, roots, F.coalesce("withheld_file_ids", F.array().cast("array<string>"))).alias("descriptor"))


def described(schema: str, roots: tuple[str, ...], withheld: Column) -> Column:
    body = F.struct(
        F.lit(schema).alias("schema"), "project_id", "event_count", "chain_head", "state_digest", F.col("last_event_at").alias("state_timestamp"),
        F.array(*map(F.lit, roots)).alias("included_roots"), withheld.alias("withheld_file_ids"),
    )
    return F.to_json(body, {"ignoreNullFields": "false"})


def descriptor_parts(summary: DataFrame, state_digest: DataFrame, withheld: DataFrame, schema: str = "package/v1", roots: tuple[str, ...] = ("files", "cases"), most: int = PART) -> DataFrame:
    """(project_id, part, text): package_descriptor in parts, for projects with any number of withheld files. Part 0 goes
    up to the list of ids, each other part has at most `most` of them; a project's parts in order, put together, are its
    descriptor."""
    rows = summary.join(state_digest.select("project_id", "state_digest"), "project_id", "left")
    whole = described(schema, roots, F.array().cast("array<string>"))
    ids = withheld.filter("file_id is not null").select("project_id", "file_id").distinct().join(summary.select("project_id"), "project_id", "left_semi")
    quoted = F.to_json(F.array("file_id"))
    listed = text_parts(ids.withColumn("_item", F.substring(quoted, F.lit(2), F.length(quoted) - 2)), ["project_id"], ["file_id"], "_item", ",", most)
    last = ids.groupBy("project_id").agg(F.call_function("div", F.count("*") + (most - 1), F.lit(most)).alias("_last"))
    head = rows.join(last, "project_id", "left").select("project_id", F.lit(0).cast("long").alias("part"), F.when(F.col("_last").isNull(), whole).otherwise(F.substring(whole, F.lit(1), F.length(whole) - 2)).alias("text"))
    body = listed.join(last, "project_id").select("project_id", "part", F.concat(F.when(F.col("part") > 1, ",").otherwise(""), "text", F.when(F.col("part") == F.col("_last"), "]}").otherwise("")).alias("text"))
    return head.unionByName(body)
