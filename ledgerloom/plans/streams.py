"""Ledgers as streams over the provided tables: each runs all that is there in micro-batches, and has the SQL of the batch form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.chain import ledger_summary
from ..sources.shared import shared_dir
from ..streaming import ledger as T
from .registry import LEDGER, query
from .standins import ledger, table

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def fed(df: DataFrame, parts: list[str], start: Callable[[DataFrame, str], StreamingQuery]) -> str:
    """Feed a stream with df's rows, those of each condition in a micro-batch of their own, in as many files as they come;
    start begins or takes up the query on it. Returns the folder of the query: start is told it, and output and marks
    belong there."""
    spark, at = df.sparkSession, f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            df.filter(part).write.mode("append").parquet(f"{at}/in")
            start(spark.readStream.schema(df.schema).parquet(f"{at}/in"), at).awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return at


def drained(df: DataFrame, parts: list[str], query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming query has put out when it has been fed all parts of df."""

    def start(stream: DataFrame, at: str) -> StreamingQuery:
        return query(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/marks").outputMode("append").trigger(availableNow=True).start()

    at = fed(df, parts, start)
    spark = df.sparkSession
    return spark.read.schema(query(spark.readStream.schema(df.schema).parquet(f"{at}/in")).schema).parquet(f"{at}/out")


CHAIN = """
parts AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
links AS (
  SELECT user_id, seq, sha256(repeat('0', 64) || props) AS h FROM parts WHERE seq = 1
  UNION ALL
  SELECT p.user_id, p.seq, sha256(l.h || p.props) FROM parts p JOIN links l ON p.user_id = l.user_id AND p.seq = l.seq + 1
)"""


@query(f"WITH RECURSIVE {CHAIN} SELECT CAST(user_id AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n, arg_max(h, seq) AS head FROM links GROUP BY user_id")
def stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of users' events built by a stream: three batches, one after another in the order of events."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("position"), F.col("props").alias("payload"))
    top = e.agg(F.max("position")).first()[0] or 0
    out = drained(e, [f"position < {top // 3}", f"position between {top // 3} and {top // 2}", f"position > {top // 2}"], T.stream_chain)
    return out.groupBy("key").agg(F.count("*").alias("n"), F.max_by("event_hash", "sequence").alias("head"))


@query("""
WITH parts AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events)
SELECT CAST(user_id AS VARCHAR) AS key, seq AS sequence, 'wrong-hash' AS rule FROM parts WHERE event_id % 29 = 0
UNION ALL SELECT CAST(user_id AS VARCHAR), seq, 'late-or-doubled' FROM parts WHERE event_id % 37 = 0
""")
def stream_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains checked by a stream: later halves come first and wait, some payloads are changed, some events come twice."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("position"), F.col("props").alias("payload"))
    links = drained(e, ["true"], T.stream_chain).join(e, ["key", "position"])
    rows = links.select("key", "sequence", "previous_hash", "event_hash", F.when(F.col("position") % 29 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")).alias("payload"), "position")
    return drained(rows, ["sequence % 100 > 50", "sequence % 100 <= 50", "position % 37 = 0"], lambda s: T.stream_verify(s.drop("position")))


@query("""
WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS key, 3 AS sequence, 'gap' AS rule FROM n WHERE user_id % 4 = 0 AND n - 3 > 5
UNION ALL SELECT CAST(user_id AS VARCHAR), 3, 'late-or-doubled' FROM n WHERE user_id % 8 = 0 AND n - 3 > 5
""")
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of which the third event is lost for every fourth user; at most five events wait for it. For half of these users
    it comes after all, when it was given up."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("position"), F.col("props").alias("payload"))
    links = drained(e, ["true"], T.stream_chain).join(e, ["key", "position"]).select("key", "sequence", "previous_hash", "event_hash", "payload")
    lost = "cast(key as bigint) % 4 = 0 and sequence = 3"
    enough = links.groupBy("key").agg((F.count("*") > 8).alias("enough"))
    rows = links.join(enough, "key")
    return drained(rows, [f"not ({lost})", f"{lost} and enough and cast(key as bigint) % 8 = 0"], lambda s: T.stream_verify(s.drop("enough"), most_waiting=5))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each user and type of event, kept up to date over three batches."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    at = fed(e, ["event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2"], lambda s, at: T.stream_state(s, f"{at}/state", f"{at}/marks", ["user_id", "event_type"], "event_id", buckets=8))
    return T.latest_version(spark, f"{at}/state")


@query(f"""
WITH {LEDGER}, h AS (SELECT project_id, user_id, count(*) AS n FROM led GROUP BY ALL) SELECT project_id, CAST(n AS BIGINT) AS expected_count FROM h WHERE user_id % 3 <> 1
""")
def stream_checkin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches on a ledger's heads: those of every third user were made for an older head and are refused."""
    led = ledger(spark, sf_dir).withColumn("event_hash", F.col("object_id"))
    heads = ledger_summary(led)
    user = F.substring("project_id", 3, 9).cast("long")
    asked = heads.select("project_id", F.when(user % 3 == 1, F.col("event_count") - 1).otherwise(F.col("event_count")).alias("expected_count"), F.col("chain_head").alias("expected_head"))
    held = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    led.write.parquet(held)
    at = fed(asked, ["project_id <= 'P-000005'", "project_id > 'P-000005'"], lambda s, at: T.stream_checkin(s, f"{at}/out", f"{at}/marks", T.guard_append(held)))
    return spark.read.option("recursiveFileLookup", "true").schema(asked.schema).parquet(f"{at}/out").select("project_id", "expected_count")
