import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup as L

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    rank = lambda i: (i is not None, i or 0)
    keep = {k: max(v, key=rank) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def run(spark, rows, schema="doc_id bigint, text string", **options):
    out = L.dedup_lines(spark.createDataFrame(rows, schema).repartition(3), **options)
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    pool = [f"{'Shared LINE é ' * 4}{k}" for k in range(30)] + ["short", "x" * 39, "x" * 40, "É" * 40, "é" * 40]
    rows = []
    for i in range(200):
        lines = [rng.choice([" ", "\t", "", "\r", "\x0b"]) + rng.choice(pool) + rng.choice(["", " ", "\x0c"]) for _ in range(rng.randrange(6))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.3 and "é" not in x else x for x in lines)))
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, pool[0]), (None, pool[1] + "\n" + pool[0]), (7, rows[7][1]), (303, "y" * 50_000 + "\n" + pool[2])]
    assert run(spark, rows) == brute(rows)


def test_small_filter_gives_the_same_rows(spark):
    rows = [(i, "\n".join(f"line number {j} that is long enough to have a key" for j in range(i % 40))) for i in range(120)]
    assert run(spark, rows, max_bits=L.SEGMENT_BITS) == brute(rows)


@pytest.mark.parametrize("max_bits", [1, 1 << 29])
def test_filters_of_many_shards(spark, max_bits, monkeypatch):
    monkeypatch.setattr(L, "SHARD_BYTES", 1 << 16)
    rng = random.Random(4)
    common = [f"{'a common line with enough letters' * 2} {k}" for k in range(400)]
    rows = [(i, "\n".join([f"{i} {j} {rng.getrandbits(300):x}" for j in range(200)] + rng.sample(common, 5) + [common[0]])) for i in range(400)]
    rows += [(None, common[0] + "\nown"), (None, common[0] + "\nown"), (None, common[1])]
    assert L.scan_shards(sum(len(t) for _, t in rows)) >= 64
    assert run(spark, rows, max_bits=max_bits) == brute(rows)


def test_only_documents_that_lose_lines_are_joined(spark):
    line = "a line that is certainly longer than forty characters"
    docs = spark.createDataFrame([(i, line if i < 6 else f"{line} {i}") for i in range(500)], "doc_id bigint, text string")
    lost = L.lost_lines(found := L.suspected_lines(docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_hash"), F.col("text").cast("binary").alias("_text")), 40, 5, 1 << 29), L.repeated_lines(found, 5))
    may = L.may_hold(lost.select(F.xxhash64("_id").alias("k")), 1 << 29)
    held = docs.withColumn("may", may(F.xxhash64("doc_id"))).filter("may").collect()
    assert {r["doc_id"] for r in held} >= set(range(5)) and len(held) < 10


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    schema = "doc_id bigint, text string, n_lines string, _key int, n_dropped int"
    line = "a line that is certainly longer than forty characters"
    out = L.dedup_lines(spark.createDataFrame([(i, line, "x", 1, 2) for i in range(6)], schema))
    assert set(out.columns) == {"doc_id", "text", "n_lines", "_key", "n_dropped"}
    assert sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in out.collect()) == [*((i, "", 1) for i in range(5)), (5, line, 0)]


def test_only_suspected_repeats_leave_the_scan(spark):
    # Every line is in some documents, but few are in five: only those, and false alarms, are put out with their place.
    rows = [(i, "\n".join(f"a line that has a key, number {j} of its kind" for j in range(i * 10, i * 10 + 40))) for i in range(300)]
    rows = [(i, t + "\na line that all of the documents have in common") for i, t in rows]
    docs = spark.createDataFrame(rows, "_id bigint, _t string").repartition(7).select("_id", F.xxhash64("_t").alias("_text_hash"), F.col("_t").cast("binary").alias("_text"))
    counts = {n: L.suspected_lines(docs, 40, n, 1 << 29).count() for n in (2, 4, 5)}
    assert counts[2] >= counts[4] > 300 * 30 and 300 <= counts[5] < 330


@pytest.mark.parametrize("n_shards", [1, 8])
def test_filters_never_miss_in_any_order(spark, n_shards):
    keys = [f"key {i:060d}" for i in range(3000)]
    texts = ["\n".join(keys[:2000]), "\n".join(keys[1000:]), "\n".join(keys[:10] + keys[:10]), "\n".join(keys[:5])]
    for order in (texts, texts[::-1]):
        rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(order)], "i int, _text binary").repartitionByRange(4, "i")
        found = L.met_again(L.line_hashes(rows, 40, n_shards), L.SEGMENT_BITS).groupBy("hash").agg(F.sum("again").alias("n")).collect()
        got = {r["hash"] & (1 << 64) - 1: r["n"] for r in found}
        h = L.hashes_of([k.encode() for k in keys]).tolist()
        assert all(got[x] == 2 for x in h[:5]) and all(got[x] == 1 for x in h[5:10] + h[1000:2000])
        assert len(got) < 1020
