"""Files beyond what a row or a task holds: payloads in blocks, lines numbered over splits."""

import hashlib
import resource

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import ledger as L


@pytest.mark.parametrize("algorithm", ["sha256", "blake2b-256"])
def test_payloads_whole_and_in_blocks(spark, tmp_path, algorithm):
    (tmp_path / "a b").mkdir()
    bodies = {"empty": b"", "short": b"abc", "edge": b"x" * L.BLOCK, "long": bytes(range(256)) * 9000}
    for name, body in bodies.items():
        (tmp_path / "a b" / name).write_bytes(body)
    plain = (lambda b: hashlib.blake2b(b, digest_size=32)) if algorithm.startswith("b") else hashlib.sha256
    want = {(n, len(b), plain(b).hexdigest()) for n, b in bodies.items()}
    for whole in (L.WHOLE, 10, -1):
        got = L.scan_payloads(spark, str(tmp_path), algorithm, whole=whole).collect()
        assert {(r["path"].split("/")[-1], r["size_bytes"], r["content_digest"]) for r in got} == want
    only = spark.createDataFrame([(r["path"],) for r in got if r["path"].endswith("/long")], "path string")
    assert [r["size_bytes"] for r in L.scan_payloads(spark, str(tmp_path), algorithm, only, whole=10).collect()] == [256 * 9000]


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    n = 3 << 30
    with open(tmp_path / "sparse", "wb") as f:
        f.truncate(n)
    (tmp_path / "small").write_bytes(b"s")
    got = {r["path"].split("/")[-1]: (r["size_bytes"], r["content_digest"]) for r in L.scan_payloads(spark, str(tmp_path)).collect()}
    state = hashlib.sha256()
    for _ in range(n >> 20):
        state.update(bytes(1 << 20))
    assert got == {"sparse": (n, state.hexdigest()), "small": (1, hashlib.sha256(b"s").hexdigest())}
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert L.digest_file(f"file://{tmp_path}/sparse", "sha256") == got["sparse"]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 * 1024


def test_lines_are_numbered_over_splits(spark, tmp_path):
    bodies = {f"f{i}.txt": [f"{i} {j} " + "x" * (j % 40) if j % 7 else "" for j in range(i * 300)] for i in range(4)}
    for name, lines in bodies.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = L.numbered_lines(spark, str(tmp_path))
        assert rows.select(F.spark_partition_id()).distinct().count() > 10 or rows.rdd.getNumPartitions() > 1
        got = sorted((r["file"].split("/")[-1], r["number"], r["line"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((n, i, x) for n, lines in bodies.items() for i, x in enumerate(lines, 1))


def test_manifest_in_parts(spark, tmp_path):
    files = spark.range(1000).select(F.format_string("d/%05d", "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("content_digest"))
    L.write_manifest(files, str(tmp_path / "m"), parts=4)
    parts = sorted((tmp_path / "m").glob("part-*"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    assert len(parts) == 4 and [x[66:] for x in lines] == sorted(x[66:] for x in lines) and len(lines) == 1000
    good, bad = L.read_manifest(spark, str(tmp_path / "m"))
    assert sorted(good.collect()) == sorted(files.collect()) and bad.count() == 0
