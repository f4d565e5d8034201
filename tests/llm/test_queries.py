"""The registered queries over small tables of odd rows, against plain versions of their contracts."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import flac as X
from ledgerloom.llm import quality_model as M
from ledgerloom.llm import quality_rules as R
from ledgerloom.llm import queries as Q
from tests.llm.test_quality_rules import brute as brute_rules
from tests.llm.test_secrets import brute as brute_spans
from tests.llm.test_simhash import brute as brute_prints


def rows():
    rng = random.Random(12)
    words = ["the", "a", "Word", "é", "ſ", "中文", "x1", "<|endoftext|>", "don't", "SECRET", "password: hunter2hunter2", "AKIA" + "Q7" * 10, "deadbeef" * 5, "#*|"]
    texts = [None, "", " \n\t ", "a b", "A  b", "tie", "tie", "\x0b\x1c\x85", "same line of some length here\n" * 8, "long " * 20_000, "token = 'abcdefgh12345678'\r\nnext"]
    texts += [" ".join(rng.choices(words, k=rng.randrange(1, 120))) + rng.choice(["", "\n", "\n\nend"]) for _ in range(60)]
    sources = ["hot", "hot", "s1", "s2", None]
    return [(i, t, rng.choice(["en", "fr"]), rng.choice(sources), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows(), shape).repartition(5).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int((i * 7) % 3 > 0), 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op2(spark, sf_dir):
    out = Q.op2_best_fit_packing(spark, sf_dir).collect()
    words = {i: len((t or "").encode().split()) for i, t, *_ in rows()}
    total = Counter()
    for r in out:
        total[r["doc_id"]] += r["length"]
    assert {i: total[i] for i in words} == words and {r["doc_id"] for r in out} == set(words)
    component = {i: c for i, _, c in brute_prints([r[:2] for r in rows()])}
    source = {r[0]: r[3] for r in rows()}
    bins = {}
    for r in out:
        bins.setdefault(r["bin"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        assert sum(r["length"] for r in own) <= 2048 and all(a["offset"] + a["length"] <= b["offset"] for a, b in zip(own, own[1:], strict=False))
        for of in (source, component):
            held = [of[r["doc_id"]] for r in own if of[r["doc_id"]] is not None]
            assert len(held) == len(set(held))


def test_op3(spark, sf_dir):
    got = {r["doc_id"]: r for r in Q.op3_secret_scan(spark, sf_dir).collect()}
    for i, text, *_ in rows():
        spans = [s for s in brute_spans(text).split(",") if s]
        base = [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")]
        count = Counter(s.split(":")[0] for s in base)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) == (count["assign"], count["access"], count["hex"], sha(",".join(base)), ",".join(spans))


def test_op4(spark, sf_dir):
    for r in Q.op4_quality_classifier(spark, sf_dir).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op5(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation(), library.no_padding()
    got, start = sorted(Q.op5_token_store(spark, sf_dir).collect(), key=lambda r: r["doc_id"]), 0
    for r, (i, text, *_) in zip(got, rows(), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_op6(spark, sf_dir):
    got = {r["doc_id"]: r for r in Q.op6_quality_rules(spark, sf_dir).collect()}
    for i, text, *_ in rows():
        if len(text or "") < 50_000:
            r = got[i]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_rules(text)
            assert not (r["base_failed"] and r["kept"])


def test_op8(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    got = {r["doc_id"]: r for r in Q.op8_bpe(spark, sf_dir).collect()}
    for i, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op9(spark, sf_dir):
    got, seen = {r["doc_id"]: r for r in Q.op9_flac_media(spark, sf_dir).collect()}, {}
    for i, text, *_ in rows():
        data = (text or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        x = [b - 128 for b in payload]
        signs = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        assert r["feature"] == f"n={len(x)} sum={sum(x)} squares={sum(v * v for v in x)} crossings={signs} peak={max(map(abs, x))}"
        assert seen.setdefault(text or "", (r["media_sha256"], r["media_bytes"])) == (r["media_sha256"], r["media_bytes"])


def test_op10(spark, sf_dir):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in Q.op10_simhash_near_dedup(spark, sf_dir).collect()]
    assert sorted(got, key=repr) == brute_prints([r[:2] for r in rows()])
    assert xxhash.xxh64_intdigest(b"tie", 42) == int(next(f for i, f, _ in got if i == 5), 16)


def test_columns_with_the_names_of_helpers_stay(spark):
    docs = spark.createDataFrame([(1, "some words here", 7, 8)], "doc_id bigint, text string, _stats int, _measures int")
    model = M.fit_quality(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    for out in (M.score_quality(docs, model), R.quality_rules(docs)):
        assert (out.first()["_stats"], out.first()["_measures"]) == (7, 8)


def test_blocks_in_another_order_are_refused(spark):
    media = X.encode_media(spark.createDataFrame([(1, "x" * 200_000), (2, "y")], "doc_id bigint, text string"))
    blocks = X.pcm_blocks(media.select("doc_id", "media"))
    assert blocks.filter("doc_id = 1").count() > 2
    assert X.digest_blocks(blocks).count() == 2
    with pytest.raises(Exception, match="a block begins at sample"):
        X.digest_blocks(blocks.coalesce(1).orderBy(F.desc("first_sample"))).count()
