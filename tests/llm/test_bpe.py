import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def samples():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFXYZ     \n\t'.,!?0123456789éèüßÑçΣσИя中文字ア😀éİ  \x1c|<>-_"
    out = [None, "", " ", "\n\n  \t", "Hello World", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "don't we'll I'M", "aaaaaaaaaaaaaaaaaaaaaaa aaaa aaa", "hahahahahaha " * 30, "ΣΑΣ ὈΔΥΣΣΕΎΣ"]
    out += ["".join(rng.choices(letters, k=rng.randrange(200))) for _ in range(400)]
    return out + ["".join(rng.choices(letters, k=60_000)), "x" * 20_000]


def test_equals_library(spark, library):
    texts = samples()
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, None)], "doc_id int, text string").withColumn("ids", B.bpe_encode("text", PATH)).withColumn("back", B.bpe_decode("ids", PATH))
    rows = docs.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want, r["text"]
        assert r["back"] == library.decode(want, skip_special_tokens=False)
    assert docs.limit(0).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([3306, None, -1, 10**6, 1002],)], "ids array<int>")
    assert [r[0] for r in odd.select(B.bpe_decode("ids", PATH)).collect()] == ["", "", "hello</w>    world</w>"]


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", B.bpe_encode("text", PATH).alias("ids"))
    rows = docs.filter(F.length("text") < 20_000).collect()
    for r, e in zip(rows, library.encode_batch([r["text"] for r in rows], add_special_tokens=False), strict=True):
        assert r["ids"] == e.ids


def test_small_cache_and_batches(monkeypatch):
    texts = [t or "" for t in samples()[:60]]
    want = B.load(PATH).encode_batch(texts)
    monkeypatch.setattr(B, "MOST_CACHED", 5)
    monkeypatch.setattr(B, "MOST_WORDS", 7)
    fresh = B.BatchBPE(PATH)
    assert [x for part in B.slices(texts, 50) for x in fresh.encode_batch(part)] == want
    assert np.frombuffer(want[4], "<i4").tolist() == [3306, 1002]
