import zlib

import numpy as np

from ledgerloom.llm import quality_model as M

SF = "/root/testdata/sf0.01"


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out_accuracy_and_expression(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = M.fit_quality(docs, labels)
    assert 0 < len(model.rules) < 80
    out = M.score_quality(docs.select("doc_id", "text"), model).join(labels, "doc_id").toPandas()
    held = out[out["held_out"]]
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    assert area(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.97
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    x = np.array([M.statistics(t) for t in out["text"]])
    logit = model.intercept + sum(w * M.holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    assert np.allclose(out["score"], 1 / (1 + np.exp(-logit)))
    assert len(model.text()) == len(model.rules)


def test_labels_of_held_out_rows_do_not_count(spark):
    docs = spark.createDataFrame([(i, "good words here " * 5 if i % 2 else "### $$$ !!! " * 5) for i in range(200)], "doc_id bigint, text string")
    rows = [(i, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i in range(200)] + [(None, 1), (3, None)]
    model = M.fit_quality(docs, spark.createDataFrame(rows, "doc_id bigint, quality int"))
    out = {r["doc_id"]: r["predicted"] for r in M.score_quality(docs, model).collect()}
    assert out == {i: i % 2 for i in range(200)}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "text", "z")], "doc_id bigint, text string, score string")
    none = M.fit_quality(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    out = M.score_quality(docs, none).collect()
    assert [r["score"] for r in out] == [0.5] * 3 and all(r["predicted"] == 1 for r in out)
    assert M.score_quality(docs.limit(0), none).count() == 0
    one = M.fit_rules(np.zeros((3, len(M.STATS))), np.ones(3))
    assert one.rules == [] and one.intercept > 2


def test_lasso_drops_useless_rules():
    rng = np.random.default_rng(0)
    z = rng.random((2000, 10)) < 0.5
    y = (rng.random(2000) < np.where(z[:, 3], 0.9, 0.1)).astype(float)
    _, w = M.lasso(z.astype(float), y, 0.02)
    assert w[3] > 1 and np.abs(np.delete(w, 3)).max() < 0.1
