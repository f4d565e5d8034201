import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
from pyspark.sql import SparkSession
from ledgerloom.sources.shared import shared_dir, written

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
at = shared_dir(spark)
assert at == shared_dir(spark.newSession()) and at.startswith("/tmp/spark-")
assert written(spark.range(5), "five").count() == 5 and written(spark.range(3), "three").inputFiles()[0].startswith(f"file://{at}/three-")
print("fine")
"""


def test_a_local_session_without_the_setting(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", PROGRAM], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_large_joins_and_replays_keep_their_tasks(spark):
    """Spark puts no tasks together that sort whole tables, however few bytes their rows take in a shuffle; one shuffle a side."""
    from ledgerloom.operators import replay as R
    from ledgerloom.operators import verify as V
    from ledgerloom.operators.chain import anchor_check
    from ledgerloom.operators.matching import diff

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(str(i) if i % 7 else None, i if i % 5 else None, "x" if i % 3 else None) for i in range(40)]
    a, b = spark.createDataFrame(rows, "k string, n long, v string"), spark.createDataFrame([*rows[:-1], (None, None, "z")], "k string, n long, v string")
    found = diff(a, b, ["k", "n"], ["v"], "t")
    assert found.rdd.getNumPartitions() == n
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2
    assert {(r["rule"], r["key"]) for r in found.collect()} == {("changed", ""), ("missing", "39/39")}
    heads = spark.createDataFrame([("P", 1, "h1"), ("P", 2, "x")], "project_id string, event_count long, chain_head string")
    ledger = spark.createDataFrame([("P", 1, "h1"), ("P", 2, "h2")], "project_id string, event_sequence long, event_hash string")
    checked = anchor_check(heads, ledger)
    assert checked.rdd.getNumPartitions() == n and {r["event_count"]: r["anchored"] for r in checked.collect()} == {1: True, 2: False}
    said = '{"authority_transaction":{"data":{"operator_id":"A","authority_basis":"b","reason":"%s","granted_sequence":1}}}'
    events = spark.createDataFrame([("P", 1, "CONFIDENTIAL_ACCESS_GRANTED", "file", "F", said % "r"), ("P", 5, "CONFIDENTIAL_ACCESS_REVOKED", "file", "F", said % "q")], "project_id string, event_sequence long, event_type string, object_type string, object_id string, details_json string")
    held = R.project(events, R.projections()["access_grants"])
    assert held.rdd.getNumPartitions() == n
    assert [(r["grant_reason"], r["revoked_sequence"], r["revoke_reason"]) for r in held.collect()] == [("r", "5", "q")]
    acquired = spark.createDataFrame([("P", 1, "ACQUISITION_RECORDED", "A", '{"authority_transaction":{"data":{"file_ids":["F","G"]}}}')], "project_id string, event_sequence long, event_type string, object_id string, details_json string")
    files = spark.createDataFrame([("P", "A", "G", 1), ("P", "A", "F", 2)], "project_id string, acquisition_id string, file_id string, committed_sequence int")
    found = V.verify_acquisitions(acquired, files)
    assert found.rdd.getNumPartitions() > n and [r["rule"] for r in found.collect()] == ["membership"]


def test_scope_lists_meet_the_catalogue_first(spark):
    """Revisions and export items that are no catalogued files go before they are joined to targets and made distinct."""
    from ledgerloom.operators.scopes import resolve_scopes

    files = spark.createDataFrame([("P", "C", "Q", "F1", 1), ("P", "C", "Q", "F2", 2)], "project_id string, case_id string, acquisition_id string, file_id string, committed_sequence int")
    lists = spark.createDataFrame([("E", "F1"), ("E", "F1"), *[("E", f"X{i}") for i in range(50)], ("N", "X1")], "export_id string, file_id string")
    state = {"files": files, "export_items": lists, "note_revisions": lists.withColumnRenamed("export_id", "note_id"), "artefact_files": lists.limit(0).withColumnRenamed("export_id", "artefact_id")}
    state["file_relationships"] = spark.createDataFrame([], "parent_file_id string, child_file_id string")
    targets = spark.createDataFrame([("export", "E"), ("note", "N"), ("case", "C")], "scope_type string, scope_id string")
    found, none = resolve_scopes(targets, state)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 2
    assert sorted((r["scope_id"], r["file_id"]) for r in found.collect()) == [("C", "F1"), ("C", "F2"), ("E", "F1")]
    assert [(r["rule"], r["key"]) for r in none.collect()] == [("empty-scope", "N")]
