import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import merkle as M
from ledgerloom.operators.matching import diff

SHAPE = "k long, p string, v string, n int"


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", None]), rng.choice(["x", "y", None]), rng.randrange(5)) for i in range(n)]


def plain_levels(rows, digits):
    """{level: {prefix: (n, digest)}}"""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    times = {}
    for r in rows:
        h = sha(json.dumps(dict(zip(("k", "p", "v", "n"), r, strict=True)), separators=(",", ":")))
        times[h] = times.get(h, 0) + 1
    out, below = {}, {}
    for h, n in sorted(times.items()):
        below.setdefault(h[:digits], []).append((n, f"{h}:{n}"))
    for level in range(digits, -1, -2):
        out[level] = {p: (sum(n for n, _ in own), sha(",".join(x for _, x in own))) for p, own in below.items()}
        below = {}
        for p, (n, d) in sorted(out[level].items()):
            below.setdefault(p[: level - 2] if level else "", []).append((n, f"{p}:{d}"))
    return out


@pytest.mark.parametrize("digits", [0, 2, 4])
def test_tree_of_digests(spark, digits):
    rows = rows_of(300) + rows_of(20)
    tree = M.build_tree(spark.createDataFrame(rows, SHAPE).repartition(5), ["k", "p"], digits=digits)
    want = plain_levels(rows, digits)
    for level, nodes in want.items():
        assert {r["prefix"]: (r["n"], r["digest"]) for r in tree.nodes(level).collect()} == nodes
    assert tree.root() == want[0][""]
    assert tree.entries().count() == 300


def test_depth_follows_from_the_number_of_rows(spark):
    assert [M.digits_for(n, 4096) for n in (0, 1, 1024, 1025, 10**6, 10**12)] == [0, 0, 0, 2, 4, 8]
    tree = M.build_tree(spark.range(20_000).select("id"), ["id"], most=64)
    assert tree.digits == 4
    counts = tree.nodes(4).agg(F.max("n")).first()[0]
    assert counts <= 64 and tree.nodes(2).count() == 256


def test_differences_are_those_of_a_full_comparison(spark):
    rows = rows_of(3000)
    rng = random.Random(3)
    other = [(k, p, "changed" if k % 500 == 7 else v, n) for k, p, v, n in rows if k % 700 != 9] + [(10_000 + i, None, None, i) for i in range(3)]
    rng.shuffle(other)
    a, b = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(other, SHAPE)
    for digits in (None, 4):
        got = M.tree_diff(a, b, ["k", "p"], ["v", "n"], "t", digits)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, diff(a, b, ["k", "p"], ["v", "n"], "t").collect()))
        assert got.count() == 6 + 5 + 3
    assert M.tree_diff(a, a.orderBy(F.desc("k")), ["k", "p"], ["v", "n"], "t").count() == 0
    assert M.tree_diff(a.limit(0), a.limit(0), ["k", "p"], ["v", "n"], "t").count() == 0
    assert M.tree_diff(a.limit(0), a.filter("k < 5"), ["k", "p"], ["v", "n"], "t").count() == 5


def test_repeated_rows_count(spark):
    a = spark.createDataFrame([(1, "a", "x", 1)] * 2 + [(2, "a", "x", 1)], SHAPE)
    ta, tb = (M.build_tree(df, ["k"], digits=0) for df in (a, a.dropDuplicates()))
    assert [r["key"]["k"] for r in M.changed_keys(ta, tb).collect()] == [1]


def test_only_changed_subtrees_are_read(spark):
    a = spark.range(50_000).select("id", F.lit("x").alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 31_337, "y").otherwise(F.col("v")))
    ta = M.build_tree(a, ["id"], digits=4)
    tb = M.build_tree(b, ["id"], digits=ta.digits)
    leaves = M.changed_leaves(ta, tb)
    assert leaves.count() == 2  # where the row was, and where it is
    assert M.below(ta.entries(), "h", leaves, 4).count() < 20
    plan = M.below(ta.entries(), "h", leaves, 4)._jdf.queryExecution().toString()
    assert "StringStartsWith(h" in plan
    assert [r["key"]["id"] for r in M.changed_keys(ta, tb).collect()] == [31_337]
    with pytest.raises(ValueError):
        M.changed_leaves(ta, M.build_tree(a, ["id"], digits=2))


def test_rows_are_shuffled_once(spark):
    """A tree's entries and leaves come from one shuffle of the rows, as bytes of digests."""
    ids = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("tree", "tree")
    try:
        tree = M.build_tree(spark.range(30_000).select("id"), ["id"], digits=2)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    store = spark._jsparkSession.sparkContext().statusStore()
    stages = {s for j in ids("tree") for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    moved = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert 30_000 <= moved < 31_000  # rows once, and nodes; each row three times before
    assert tree.entries().count() == 30_000 and tree.root()[0] == 30_000
