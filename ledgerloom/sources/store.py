"""A ledger in versions: appends that cost what their batch costs, and of two from one head only one is kept.

    events/_attempt=<id>/_bucket=<b>   events of one append, by bucket of their project
    heads/_attempt=<id>/_bucket=<b>    the heads of all projects of a bucket, for each bucket that an append touched
    commits/<version>.json             which attempt is that version, of which batch, and its buckets

An append writes its files under an attempt of its own and then puts the commit of the next version where none may be yet.
Before that nobody reads its files; an append that fails or comes second leaves files that nobody ever reads.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import envelope
from ..operators.chain import append_guard, assign_sequences, chain_parts, ledger_summary
from .ledger import LEDGER
from .shared import written

BUCKETS = 64
HEADS = T.StructType([T.StructField("project_id", T.StringType()), T.StructField("event_count", T.LongType()), T.StructField("chain_head", T.StringType()), T.StructField("last_event_at", T.StringType())])
COMMIT = "version long, batch string, attempt string, events long, buckets array<int>"
MADE = ("event_sequence", "previous_hash", "event_hash")


class MovedHead(ValueError):
    """The ledger has another head than a batch was made for, or another append was committed first."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file at once and whole, unless there is one: then nothing is written and the answer is False."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    own = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    stream = fs.create(own)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if target.toUri().getScheme() == "file":
            # A link either comes into being or fails; a local rename looks first and may replace.
            at = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(at(target), at(own))
        else:
            kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(own, target, kinds)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(own, False)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int")


class LedgerStore:
    """A ledger at path. buckets is fixed for its life: a project's events and head are in one of so many parts."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def commits(self) -> DataFrame:
        """(version, batch, attempt, events, buckets) of all appends."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(f"{self.path}/commits/*.json")

    def version(self) -> int:
        return self.commits().agg(F.max("version")).first()[0] or 0

    def _read(self, kind: str, attempts: list[str], schema: T.StructType, touched: list[int] | None) -> DataFrame:
        if not attempts:
            return self.spark.createDataFrame([], schema)
        shape = T.StructType([*schema.fields, T.StructField("_attempt", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        rows = self.spark.read.schema(shape).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/_attempt={a}" for a in attempts])
        return rows if touched is None else rows.filter(F.col("_bucket").isin(touched))

    def events(self, version: int | None = None, projects: DataFrame | None = None) -> DataFrame:
        """The events up to a version; with projects (project_id) only their buckets are read."""
        done = self.commits() if version is None else self.commits().filter(F.col("version") <= version)
        touched = None if projects is None else self._touched(projects)
        rows = self._read("events", [r["attempt"] for r in done.filter("events > 0").select("attempt").collect()], LEDGER, touched)
        rows = rows.select(LEDGER.names)
        return rows if projects is None else rows.join(projects.select("project_id").distinct(), "project_id", "left_semi")

    def since(self, version: int) -> DataFrame:
        """The events that were appended after a version; no others are read."""
        later = self.commits().filter((F.col("version") > version) & (F.col("events") > 0))
        return self._read("events", [r["attempt"] for r in later.select("attempt").collect()], LEDGER, None).select(LEDGER.names)

    def _touched(self, projects: DataFrame) -> list[int]:
        return sorted(r["b"] for r in projects.select(bucket_of(self.buckets).alias("b")).distinct().collect())

    def heads(self, touched: list[int] | None = None, version: int | None = None) -> DataFrame:
        """(project_id, event_count, chain_head, last_event_at): the newest head of each project, of the buckets asked for."""
        done = self.commits() if version is None else self.commits().filter(F.col("version") <= version)
        each = done.select("version", "attempt", F.explode("buckets").alias("b"))
        if touched is not None:
            each = each.filter(F.col("b").isin(touched))
        newest = [(r["b"], r["attempt"]) for r in each.groupBy("b").agg(F.max_by("attempt", "version").alias("attempt")).collect()]
        if not newest:
            return self.spark.createDataFrame([], HEADS)
        # One path for each bucket: at most as many as the store has.
        paths = [f"{self.path}/heads/_attempt={a}/_bucket={b}" for b, a in newest]
        return self.spark.read.schema(HEADS).parquet(*paths)

    def append(self, events: DataFrame, batch: str | None = None, expected: DataFrame | None = None, id_cols: tuple[str, ...] | None = None, schema: str = "audit-event/v3", order: tuple[str, ...] = ("occurred_at", "object_id", "event_type")) -> int:
        """Chain events on to their projects' heads and commit them as the next version; returns how many there were.

        A batch with a name is taken once: later tries return 0. An event that the ledger has already is left out, known
        by id_cols if they are given, else by all its columns and its number among equal ones. expected (project_id,
        expected_count, expected_head) says on which heads the batch was made. MovedHead: those have moved on, or another
        append was committed meanwhile; nothing is appended then. Only the batch and the buckets of its projects are read.
        """
        spark, done = self.spark, self.commits()
        if batch is not None and not done.filter(F.col("batch") == batch).isEmpty():
            return 0
        version = (done.agg(F.max("version")).first()[0] or 0) + 1
        own = [f.name for f in LEDGER if f.name not in MADE]
        rows = written(events.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER if f.name not in MADE]), "batch")
        touched = self._touched(rows)
        heads = written(self.heads(touched, version - 1), "batch-heads")
        if expected is not None and not append_guard(expected, heads).isEmpty():
            raise MovedHead("the ledger has another head than the batch was made for")
        held = self.events(version - 1, rows)
        name = F.sha2(F.to_json(F.struct(*(id_cols or own)), {"ignoreNullFields": "false"}), 256)
        nth = F.lit(1) if id_cols else F.row_number().over(Window.partitionBy("_id").orderBy(F.lit(1)))
        numbered = lambda df: df.withColumn("_id", name).withColumn("_nth", nth)
        new = numbered(rows).join(numbered(held).select("_id", "_nth"), ["_id", "_nth"], "left_anti")
        placed = assign_sequences(new.select(own), heads, list(order))
        started = placed.join(heads.select("project_id", F.col("chain_head").alias("_start")), "project_id", "left").withColumn("_start", F.coalesce("_start", F.lit("0" * 64)))
        head, tail = envelope(schema, "sha256")
        chained = chain_parts(started, "project_id", "event_sequence", head, tail, start="_start").select(LEDGER.names)
        attempt = uuid.uuid4().hex
        at = f"{self.path}/events/_attempt={attempt}"
        chained.withColumn("_bucket", bucket_of(self.buckets)).repartition("_bucket").sortWithinPartitions("_bucket", "project_id", "event_sequence").write.partitionBy("_bucket").parquet(at)
        kept = self._read("events", [attempt], LEDGER, None)
        n = kept.count()
        if n:
            first = ledger_summary(kept)
            moved = first.select("project_id", F.col("event_count").alias("_n"), F.col("chain_head").alias("_h"), F.col("last_event_at").alias("_t")).join(heads, "project_id", "full_outer")
            now = moved.select("project_id", (F.coalesce("event_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("event_count"), F.coalesce("_h", "chain_head").alias("chain_head"), F.coalesce("_t", "last_event_at").alias("last_event_at"))
            now.withColumn("_bucket", bucket_of(self.buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/heads/_attempt={attempt}")
        commit = {"version": version, "batch": batch, "attempt": attempt, "events": n, "buckets": touched if n else []}
        if not put_if_absent(spark, f"{self.path}/commits/{version:010d}.json", json.dumps(commit)):
            raise MovedHead("another append was committed first")
        return n


def append_stream(store: LedgerStore, name: str):
    """For foreachBatch: append each micro-batch once, however often it is run. name tells the stream from others."""

    def run(batch: DataFrame, number: int) -> None:
        store.append(batch, batch=f"{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}/{number}")

    return run
