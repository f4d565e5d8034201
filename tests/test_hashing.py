import hashlib

from ledgerloom.functions import hashing as H


def test_digests_stream_and_gather_no_group(spark):
    rows = [("a", f"d/{i}", f"x{i}") for i in range(50)] + [("b", "z", "y"), (None, "n", "m")]
    df = spark.createDataFrame(rows, "k string, p string, c string")
    tree, lines = H.tree_digest(df, "k", "p", "c"), H.lines_digest(df, "k", ["p"], ["p", "c"])
    for out in (tree, lines):
        assert "collect_list" not in out._jdf.queryExecution().toString()
    for k in ("a", "b", None):
        own = sorted((p.split("/"), p, c) for g, p, c in rows if g == k)
        body = "[" + ",".join(f'{{"content_digest":"{c}","path":"{p}"}}' for _, p, c in own) + "]"
        assert {r["k"]: r["tree_digest"] for r in tree.collect()}[k] == hashlib.sha256(body.encode()).hexdigest()
        text = "\n".join(f"{p}:{c}" for _, p, c in own)
        assert {r["k"]: r["lines_digest"] for r in lines.collect()}[k] == hashlib.sha256(text.encode()).hexdigest()
