"""Queries of trees of digests, versioned ledgers and checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checkpoints as K
from ..operators import merkle as T
from ..operators import verify as V
from ..sources.shared import shared_dir, written
from ..sources.store import LedgerStore
from .registry import LEDGER, query
from .standins import ledger, table


@query("""
WITH h AS (SELECT sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}') AS h FROM orders),
e AS (SELECT h, count(*) AS times FROM h GROUP BY h),
l4 AS (SELECT substr(h, 1, 4) AS prefix, sum(times) AS n, sha256(string_agg(h || ':' || times, ',' ORDER BY h)) AS digest FROM e GROUP BY 1),
l2 AS (SELECT substr(prefix, 1, 2) AS prefix, sum(n) AS n, sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest FROM l4 GROUP BY 1),
l0 AS (SELECT '' AS prefix, sum(n) AS n, sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest FROM l2)
SELECT 0 AS level, prefix, CAST(n AS BIGINT) AS n, digest FROM l0 UNION ALL SELECT 2, prefix, CAST(n AS BIGINT), digest FROM l2 UNION ALL SELECT 4, prefix, CAST(n AS BIGINT), digest FROM l4
""")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the tree of digests over orders."""
    tree = T.build_tree(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"], digits=4)
    out = None
    for level in (0, 2, 4):
        part = tree.nodes(level).select(F.lit(level).alias("level"), "prefix", "n", "digest")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS k FROM lineitem)
SELECT 'lines' AS target, 'missing' AS rule, l_orderkey || '/' || l_linenumber AS key, NULL AS "column" FROM l WHERE k % 101 = 0
UNION ALL SELECT 'lines', 'changed', l_orderkey || '/' || l_linenumber, 'l_returnflag' FROM l WHERE k % 101 <> 0 AND k % 97 = 0
UNION ALL SELECT 'orders', 'extra', CAST(-o_orderkey AS VARCHAR), NULL FROM orders WHERE o_orderkey % 500 = 3
""")
def verify_snapshot_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and orders against copies with rows lost, changed and added, compared by their trees of digests."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    lines = written(lines, "lines")
    orders = written(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").distinct(), "orders")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    copy = lines.filter(k % 101 != 0).withColumn("l_returnflag", F.when(k % 97 == 0, F.lit(None)).otherwise(F.col("l_returnflag")))
    more = orders.unionByName(orders.filter("o_orderkey % 500 = 3").withColumn("o_orderkey", -F.col("o_orderkey")))
    found = V.verify_snapshot({"lines": lines, "orders": orders}, {"lines": copy, "orders": more}, {"lines": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"]}, by_tree=True)
    return found.select("target", "rule", "key", "column")


@query(f"""
WITH {LEDGER}, b AS (SELECT *, CASE WHEN event_id % 10 < 6 THEN 0 ELSE 1 END AS batch FROM led),
s AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY batch, object_id) AS event_sequence, object_id, batch FROM b)
SELECT project_id, event_sequence, object_id, max(event_sequence) OVER (PARTITION BY project_id) AS event_count, batch = 1 AS later FROM s
""")
def append_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of a ledger in versions, appended in two batches of which the second holds events of the first and is tried
    twice; with the heads that the store keeps, and what the second version added."""
    store = LedgerStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=16)
    rows, first = ledger(spark, sf_dir).drop("event_sequence"), F.substring("object_id", 3, 12).cast("long") % 10
    store.append(rows.filter(first < 6), batch="one", order=("object_id",))
    for _ in range(2):
        store.append(rows.filter(first > 2), batch="two", order=("object_id",))
    new = store.since(1).select("project_id", "event_sequence", F.lit(True).alias("later"))
    held = store.events().join(store.heads().select("project_id", "event_count"), "project_id").join(new, ["project_id", "event_sequence"], "left")
    return held.select("project_id", "event_sequence", "object_id", "event_count", F.coalesce("later", F.lit(False)).alias("later"))


def export_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a ledger of exports, one for each project, with sequences that are dense in it and numbered heads."""
    kinds = F.create_map(*[F.lit(x) for pair in (("SIGNUP", "EXPORT_STARTED"), ("PURCHASE", "EXPORT_COMPLETED"), ("ERROR", "EXPORT_FAILED")) for x in pair])
    said = F.struct(F.struct(F.struct(F.col("object_id").alias("manifest_digest")).alias("data")).alias("authority_transaction"))
    rows = ledger(spark, sf_dir).withColumns({"details_json": F.to_json(said), "event_type": F.coalesce(kinds[F.col("event_type")], F.col("event_type"))})
    seq = F.col("event_sequence")
    return rows.withColumns({"object_id": F.concat(F.lit("EXPORT-"), "project_id"), "previous_hash": F.concat(F.lit("h"), (seq - 1).cast("string")), "event_hash": F.concat(F.lit("h"), seq.cast("string"))})


def from_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exports of export_history: a checkpoint of all but each project's last events, taken on by these."""
    rows, path = written(export_history(spark, sf_dir), "history"), f"{shared_dir(spark)}/checkpoint-{uuid.uuid4().hex}"
    early = F.col("event_sequence") % 10_000_000 <= 5
    K.take(rows.filter(early), f"{path}/1", ["exports"])
    K.advance(spark, f"{path}/1", rows.filter(~early), f"{path}/2", ["exports"])
    return K.tables(spark, f"{path}/2", ["exports"])["exports"]


EXPORTS = f"""
{LEDGER}, own AS (
  SELECT project_id, user_id, count(*) FILTER (WHERE event_type = 'SIGNUP') AS n, arg_max(CASE event_type WHEN 'SIGNUP' THEN 'preparing' WHEN 'PURCHASE' THEN 'completed' ELSE 'failed' END, seq) AS state,
         max(seq) FILTER (WHERE event_type = 'SIGNUP') AS created, max(seq) FILTER (WHERE event_type <> 'SIGNUP') AS done, arg_max(object_id, seq) FILTER (WHERE event_type = 'PURCHASE') AS manifest
  FROM led WHERE event_type IN ('SIGNUP', 'PURCHASE', 'ERROR') GROUP BY project_id, user_id)"""


@query(f"""
WITH {EXPORTS} SELECT project_id, 'EXPORT-' || project_id AS export_id, state, manifest AS manifest_digest, CAST(created AS VARCHAR) AS created_sequence, CAST(done AS VARCHAR) AS completed_sequence FROM own WHERE n > 0
""")
def replay_from_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_checkpoint(spark, sf_dir).select("project_id", "export_id", "state", "manifest_digest", "created_sequence", "completed_sequence")


@query(f"""
WITH {EXPORTS} SELECT 'exports' AS target, 'changed' AS rule, project_id || '/EXPORT-' || project_id AS key, 'state' AS "column", state AS expected, 'cancelled' AS actual FROM own WHERE n > 0 AND user_id % 9 = 0
UNION ALL SELECT 'exports', 'missing', project_id || '/EXPORT-' || project_id, NULL, NULL, NULL FROM own WHERE n > 0 AND user_id % 9 <> 0 AND user_id % 14 = 0
""")
def verify_state_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live exports against a checkpoint that was taken on, not the ledger, by trees of digests: states changed, rows lost."""
    held = written(from_checkpoint(spark, sf_dir), "exports")
    user = F.substring("project_id", 3, 12).cast("long")
    live = held.filter((user % 9 == 0) | (user % 14 != 0)).withColumn("state", F.when(user % 9 == 0, "cancelled").otherwise(F.col("state")))
    return V.verify_state(export_history(spark, sf_dir), {"exports": live}, {"exports": held}, by_tree=True)
