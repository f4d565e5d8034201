"""Members in order, a row each, against plain Python; groups that fill many tasks, ties, nulls and clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import checkin as B
from ledgerloom.operators import members as M
from ledgerloom.operators.chain import fold_chain
from ledgerloom.operators.findings import report, report_parts, summarise_findings
from ledgerloom.operators.verify import verify_acquisitions
from ledgerloom.sources.ledger import descriptor_parts, package_descriptor


@pytest.fixture(scope="module")
def rows(spark):
    # Half of all rows in one group, so that it fills several ranges; a group of nulls; repeated rows.
    made = [("hot" if i % 2 else f"g{i % 7}" if i % 5 else None, i * 7919 % 1009, f"m{i:05d}") for i in range(4000)]
    made += [("tie", 1, "same")] * 50 + [("none", None, None)]
    return made


def test_ordinals(spark, rows):
    df = spark.createDataFrame(rows, "g string, s int, m string").withColumns({"_row": F.lit(1), "_n": F.lit(2), "_range": F.lit(3), "ordinal": F.lit(-1)})
    out = M.ordinals(df, ["g"], ["s", "m"])
    assert out.columns == ["g", "s", "m", "_row", "_n", "_range", "ordinal"]
    want = {}
    for g, s, m in sorted(rows, key=lambda r: (r[0] or "", r[1] or -1, r[2] or "")):
        want.setdefault(g, []).append((s, m))
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], {})[r["ordinal"]] = (r["s"], r["m"])
    assert {g: [places[i] for i in range(1, len(places) + 1)] for g, places in got.items()} == want


def test_a_hot_group_is_numbered_in_many_tasks(spark, monkeypatch):
    seen, write = [], M.written
    monkeypatch.setattr(M, "written", lambda *a: seen.append(write(*a)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(20000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 20011).alias("s"))
    out = M.ordinals(df, ["g"], ["s"])
    # Each range is a group of its own for the window, so no task sorts all rows of the hot group.
    sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 15000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["ordinal"] for r in out.orderBy("s").collect()] == list(range(1, 20001))


def test_empty(spark):
    df = spark.createDataFrame([], "g string, s int, m string")
    assert M.ordinals(df, ["g"], ["s"]).count() == 0 and M.text_parts(df, ["g"], ["s"], "m").count() == 0


def test_text_parts(spark, rows):
    df = spark.createDataFrame(rows, "g string, s int, m string")
    parts = M.text_parts(df, ["g"], ["s", "m"], "m", ";", 100).collect()
    assert max(r["n"] for r in parts) == 100 and "none" not in {r["g"] for r in parts}
    for g in ("hot", None, "tie"):
        own = sorted((r["part"], r["text"]) for r in parts if r["g"] == g)
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert ";".join(t for _, t in own) == ";".join(m for _, m in sorted((s, m) for x, s, m in rows if x == g))


def test_reports_and_descriptors_in_parts(spark):
    found = spark.createDataFrame([("a", f"r{i % 3}", f"k{i:03d}", *(("c", "1", None) if i % 2 else (None, None, None))) for i in range(57)], "target string, rule string, key string, column string, expected string, actual string")
    summary = summarise_findings(found, spark.createDataFrame([("a",), ("b",)], "target string"))
    parts = sorted(map(tuple, report_parts(summary, found, 10).collect()))
    whole = {r["target"]: r["value"] for r in report(summary, findings=found).collect()}
    assert {t: "\n".join(v for x, _, v in parts if x == t) for t in "ab"} == whole and len(parts) == 8
    now = spark.createDataFrame([("P", 3, "h", "t"), ("Q", 1, None, None), ("R", 1, "h", "t")], "project_id string, event_count bigint, chain_head string, last_event_at string")
    state = now.select("project_id", F.lit("s").alias("state_digest"))
    held = spark.createDataFrame([("P", f'F"{i}\\') for i in range(25)] + [("P", 'F"1\\'), ("Q", "A"), ("X", "none")], "project_id string, file_id string")
    want = {r["project_id"]: r["descriptor"] for r in package_descriptor(now, state, held).collect()}
    parts = sorted(map(tuple, descriptor_parts(now, state, held, most=10).collect()))
    assert {p: "".join(t for x, _, t in parts if x == p) for p in "PQR"} == want and len(parts) == 7
    assert len(json.loads(want["P"])["withheld_file_ids"]) == 25


def test_artefacts_and_acquisitions_in_rows(spark):
    done = spark.createDataFrame([("b", "x", f"p{i % 40:02d}", f"F{i:03d}") for i in range(90)] + [("b", None, "p", "F900"), ("c", "x", "p", "F901")], "batch_id string, role string, logical_path string, file_id string")
    counters = spark.createDataFrame([("artefact", "ART", 5)], "namespace string, prefix string, next_value bigint")
    want = {(r["batch_id"], r["role"], r["artefact_id"]): r["file_ids"] for r in B.group_artefacts(done, counters).collect()}
    made, members = B.artefact_rows(done, counters)
    names = {r["artefact_id"]: (r["batch_id"], r["role"], r["artefact_id"]) for r in made.collect()}
    got = {}
    for r in sorted(members.collect(), key=lambda r: r["ordinal"]):
        got.setdefault(names[r["artefact_id"]], []).append(r["file_id"])
    assert got == want and {r["artefact_id"]: r["n_files"] for r in made.collect()} == {k[2]: len(v) for k, v in want.items()}
    records = spark.createDataFrame([("b", "R")], "batch_id string, record string")
    heads, files = B.acquisition_rows(done, records)
    assert {tuple(r) for r in heads.collect()} == {("b", 91, "R"), ("c", 1, None)}
    assert [r["file_id"] for r in files.filter("batch_id = 'b'").orderBy("ordinal").collect()] == sorted([f"F{i:03d}" for i in range(90)] + ["F900"])


def test_acquisitions_place_by_place(spark):
    said = {"same": ["a", "b"], "swapped": ["b", "a"], "short": ["a"], "long": ["a", "b", "c"], "doubled": ["a", "a"], "none": [], "null": None, "holes": ["a", None]}
    event = lambda n, k, ids: ("P", n, "ACQUISITION_RECORDED", k, json.dumps({"authority_transaction": {"data": {} if ids is None else {"file_ids": ids}}}))
    led = [event(n, k, ids) for n, (k, ids) in enumerate(said.items())] + [event(99, "same", ["a", "b"])]
    ledger = spark.createDataFrame(led, "project_id string, event_sequence bigint, event_type string, object_id string, details_json string")
    files = spark.createDataFrame([("P", k, f, n) for k in said if k != "null" for n, f in enumerate("ab")], "project_id string, acquisition_id string, file_id string, committed_sequence int")
    got = {(r["rule"], r["key"]) for r in verify_acquisitions(ledger, files).collect()}
    wrong = {("membership", k) for k in ("swapped", "short", "long", "doubled", "none", "holes")}
    assert got == wrong | {("recorded-twice", "same"), ("doubled-file", "doubled"), ("no-files", "none"), ("no-files", "null")}


def test_fold_is_a_plain_chain(spark):
    import hashlib

    df = spark.createDataFrame([(k, i % 5, p) for k in (1, 2, None) for i, p in enumerate(["x", None, "y", "x", "z", "x", "x"])], "k int, o int, p string")
    got = {r["k"]: (r["n"], r["head"]) for r in fold_chain(df, "k", "o", "p").collect()}
    head = "0" * 64
    for _, p in sorted((i % 5, p or "") for i, p in enumerate(["x", None, "y", "x", "z", "x", "x"])):
        head = hashlib.sha256((head + p).encode()).hexdigest()
    assert got == {k: (7, head) for k in (1, 2, None)}
