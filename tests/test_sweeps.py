import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import sweeps as S


def rows_of(seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    left = [(key(), rng.choice([None, *range(-5, 200)]), i) for i in range(400)]
    right = [(k, s, f"v{i}", None if i % 7 == 0 else i) for i, (k, s) in enumerate({(key(), rng.choice([None, *range(-5, 200)])) for _ in range(120)})]
    return left, right


@pytest.mark.parametrize("width", [None, 1, 7, 1 << 16])
def test_asof_join_in_slices(spark, width):
    left, right = rows_of(1)
    a, b = spark.createDataFrame(left, "k string, seq long, id long").repartition(5), spark.createDataFrame(right, "k string, at long, v string, n long").repartition(3)
    got = {r["id"]: (r["v"], r["n"]) for r in S.asof_join(a, b, ["k"], "seq", "at", ["v", "n"], width).collect()}
    for k, seq, i in left:
        held = [(s, v, n) for kk, s, v, n in right if kk == k and s is not None and seq is not None and s <= seq]
        assert got[i] == (max(held)[1:] if held else (None, None)), (k, seq)
    assert len(got) == len(left)
    assert S.asof_join(a.limit(0), b, ["k"], "seq", "at", ["v"], width).count() == 0
    assert S.asof_join(a, b.limit(0), ["k"], "seq", "at", ["v"], width).filter("v is not null").count() == 0


@pytest.mark.parametrize("width", [None, 1, 7, 1 << 16])
def test_sweep_finds_the_ranges_that_hold(spark, width):
    rng = random.Random(2)
    key = lambda: (rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 1, 2]))
    events = [(*key(), rng.choice([None, *range(-5, 120)]), i) for i in range(500)]
    events += events[:5]
    ranges = [(*key(), s, rng.choice([None, s, s - 3, s + 1, s + 40]), i) for i, s in enumerate(rng.choices(range(-5, 120), k=90))] + [("a", 1, None, 5, 99)]
    a, b = spark.createDataFrame(events, "k string, p int, seq long, id long").repartition(4), spark.createDataFrame(ranges, "k string, p int, valid_from long, valid_until long, r long")
    got = sorted(((r["id"], r["r"], r["valid_from"]) for r in S.valid_at(a, b, ["k", "p"], "seq", width=width).collect()), key=repr)
    want = [(i, r, s) for k, p, seq, i in events for kk, pp, s, e, r in ranges if (k, p) == (kk, pp) and k is not None and seq is not None and s is not None and s <= seq and (e is None or seq < e)]
    assert got == sorted(want, key=repr) and len(want) > 500
    assert S.valid_at(a.limit(0), b, ["k", "p"], "seq", width=width).count() == S.valid_at(a, b.limit(0), ["k", "p"], "seq", width=width).count() == 0


def test_batches_end_anywhere(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        test_sweep_finds_the_ranges_that_hold(spark, None)
        test_sweep_finds_the_ranges_that_hold(spark, 7)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hot_key_pairs_nothing_needlessly(spark):
    # 10^6 events and 10^4 ranges of one key: pairs would be 10^10.
    events = spark.range(1_000_000).select(F.lit("k").alias("k"), F.col("id").alias("seq"))
    ranges = spark.range(10_000).select(F.lit("k").alias("k"), (F.col("id") * 100).alias("valid_from"), (F.col("id") * 100 + 50).alias("valid_until"))
    for width in (None, S.SLICE):
        began = time.perf_counter()
        out = S.valid_at(events, ranges, ["k"], "seq", width=width)
        row = out.agg(F.count("*").alias("n"), F.sum((F.col("seq") - F.col("valid_from")).cast("long")).alias("s")).first()
        assert (row["n"], row["s"]) == (500_000, 10_000 * sum(range(50))) and time.perf_counter() - began < 60


def test_hot_key_is_many_tasks(spark):
    left = spark.range(1_000_000).select(F.lit("k").alias("k"), F.col("id").alias("seq"))
    right = spark.createDataFrame([("k", 10, "x"), ("k", 200_000, "y")], "k string, at long, v string")
    out = S.asof_join(left, right, ["k"], "seq", "at", ["v"], width=S.SLICE)
    counts = {r["v"]: r["n"] for r in out.groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert counts == {None: 10, "x": 199_990, "y": 800_000}
    assert left.select(S.slice_of("seq", S.SLICE)).distinct().count() == 16
