import numpy as np
import pytest

import corpus_pipeline as P
from ledgerloom.llm import quality_model
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_copies import brute as brute_copies
from tests.llm.test_secrets import brute as brute_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """The input and the output of every stage, written and read again as the driver does."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.toPandas()}
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = docs.toPandas()
    return out


def test_names_and_columns(outputs):
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_copies", "secrets", "packing"]
    for name in list(outputs)[:-1]:
        assert list(outputs[name].columns) == list(outputs["documents"].columns)


def test_quality(spark, outputs):
    model = quality_model.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    docs = outputs["documents"]
    x = np.array([quality_model.statistics(t) for t in docs["text"]])
    logit = model.intercept + sum((w * quality_model.holds(r, x) for r, w in zip(model.rules, model.weights, strict=True)), np.zeros(len(x)))
    assert set(outputs["quality"]["doc_id"]) == set(docs["doc_id"][1 / (1 + np.exp(-logit)) >= 0.3])
    assert 0 < len(outputs["quality"]) < len(docs)


def test_lines(outputs):
    rows = list(outputs["quality"][["doc_id", "text"]].itertuples(index=False, name=None))
    got = outputs["lines"]
    assert sorted(got[["doc_id", "text"]].itertuples(index=False, name=None)) == sorted(r[:2] for r in brute_lines(rows))
    assert (got["n_chars"] == got["text"].str.len()).all()


def test_near_copies(outputs):
    docs, kept = outputs["lines"].sort_values("doc_id", ignore_index=True), outputs["near_copies"]
    group = brute_copies(docs["text"].tolist())
    want = {int(docs["doc_id"][i]) for i in set(group.values())}
    assert set(kept["doc_id"]) == want and len(kept) == len(want) < len(docs)


def test_secrets(outputs):
    before = dict(outputs["near_copies"][["doc_id", "text"]].itertuples(index=False, name=None))
    after = dict(outputs["secrets"][["doc_id", "text"]].itertuples(index=False, name=None))
    assert set(before) == set(after)
    for i, text in before.items():
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in brute_spans(text).split(",") if s)
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert after[i] == out + text[at:]


def test_packing(outputs):
    docs, packed = outputs["secrets"], outputs["packing"]
    words = {r.doc_id: len(r.text.split()) for r in docs.itertuples()}
    assert packed.groupby("doc_id")["length"].sum().to_dict() == words
    source = dict(zip(docs["doc_id"], docs["source"], strict=True))
    for _, own in packed.groupby("bin"):
        assert own["length"].sum() <= 2048
        held = [source[i] for i in own["doc_id"]]
        assert len(held) == len(set(held))


def test_run_gives_the_last_stage(spark, outputs):
    out = P.run(spark, SF).toPandas()
    assert sorted(map(tuple, out[["doc_id", "piece", "length"]].values)) == sorted(map(tuple, outputs["packing"][["doc_id", "piece", "length"]].values))


def test_nulls_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "some text here", "en", "s", 14), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "plain words of text " * 30, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = {}
    for start in (docs, docs.limit(0)):
        rows = start
        for name, stage in P.STAGES:
            rows = stage(spark, rows, SF)
            if start is docs:
                names[name] = rows.toPandas()
                kept = rows.schema
                rows = spark.createDataFrame([tuple(r) for r in rows.collect()], kept)
            else:
                assert rows.count() == 0
    every = sorted(docs.select("doc_id", "text").collect(), key=repr)
    assert [tuple(r) for r in every if r["doc_id"] == 2] and set(names["quality"]["doc_id"].dropna()) <= {1, 2}
    # Nothing is lost but what the classifier rejects and the doubled row; null texts are empty from the second stage on.
    n = len(names["quality"])
    assert len(names["lines"]) == n and names["lines"]["text"].notna().all()
    assert len(names["near_copies"]) == len(names["secrets"]) <= n and len(names["packing"]) == len(names["secrets"])
    assert names["near_copies"].drop_duplicates(["doc_id", "text"]).shape[0] == len(names["near_copies"])


def test_near_copies_are_screened_by_odd_sketches(spark, monkeypatch):
    """The stage goes through the MinHash operator: bands, odd sketches, full sets."""
    from ledgerloom.llm import minhash

    asked = []
    with_sketches = minhash.with_sketches
    monkeypatch.setattr(minhash, "with_sketches", lambda *a: asked.append(a[1:]) or with_sketches(*a))
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:195], "x"]), " ".join([*words[:150], *["y"] * 50]), None, " ", " ".join(words)]
    docs = spark.createDataFrame([(9 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    group = brute_copies([t or "" for t in reversed(texts)])
    kept = {r["doc_id"] for r in P.near_copies(spark, docs, SF).collect()}
    assert asked == [(5, (20, 4))] and kept == {4 + i for i in set(group.values())} == {4, 5, 7}
    assert minhash.bits_apart(0.8) < minhash.SKETCH // 2


def test_near_copies_at_the_limit_need_no_luck_with_bands(spark):
    """Pairs of 40 and 50 shingles, 40 in common, found by search: of some 320,000 such pairs these share none of the 20 bands."""
    import random

    from ledgerloom.llm import near_copies as N

    texts = []
    for seed in (83412, 141529, 155698, 264683):
        rng = random.Random(seed)
        words = [f"w{rng.getrandbits(40)}" for _ in range(54)]
        texts += [" ".join(words[:44]), " ".join(words)]
        a, b = (N.least_hashes(t, 5)[2] for t in texts[-2:])
        assert not set(N.band_keys(a, 20, 4)) & set(N.band_keys(b, 20, 4))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in P.near_copies(spark, docs, SF).collect()} == set(brute_copies(texts).values()) == {0, 2, 4, 6}
