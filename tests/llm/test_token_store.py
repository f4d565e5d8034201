import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import token_store as S

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano_round_trip(lengths):
    ends = np.cumsum(np.array(lengths, np.int64))
    ef, at = S.EliasFano.read(b"head" + S.EliasFano.of(ends).tobytes() + b"tail", 4)
    assert at == 4 + len(S.EliasFano.of(ends).tobytes())
    assert ef.select(np.arange(len(ends))).tolist() == ends.tolist()
    assert [int(ef.select([i])[0]) for i in range(0, len(ends), 7)] == ends[::7].tolist()


@settings(deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=200), st.integers(0, 3))
def test_document_ids_of_any_range(ids, n_null):
    ids, i = [None] * n_null + sorted(ids), np.arange(n_null + len(ids))
    block = S.open_block(S.pack_block(ids, np.ones(len(ids), np.int64), np.arange(len(ids)).astype("<u4").tobytes(), 4))
    assert block.doc_ids(i).to_pylist() == ids
    assert [x.tolist() for x in block.spans(i)] == [i.tolist(), (i + 1).tolist()]


def test_blocks_are_small():
    lengths = np.random.default_rng(1).integers(1, 2000, 4000)
    data = S.pack_block(list(range(0, 12_000, 3)), lengths, np.zeros(lengths.sum(), "<u4").tobytes(), 2)
    block = S.open_block(data)
    assert len(block.ids) == lengths.sum() and block.ends.select(np.arange(4000)).tolist() == np.cumsum(lengths).tolist()
    # Boundaries in 2 + log2(2000) bits a document and their samples, document ids in 2 + log2(3) and theirs.
    assert (len(data) - 2 * len(block.ids)) * 8 / len(lengths) < 2 + np.log2(2000) + 2 + np.log2(3) + 1.5


def rows_of_text():
    rng = random.Random(2)
    letters = "abc def  ghi\n\n\t  'S don't 123 é中😀<|endoftext|>    .　\xa0"
    rows = [(i * 7 % 101, "".join(rng.choices(letters, k=rng.randrange(120)))) for i in range(100)]
    big = (1 << 62) + 1
    return rows + [(200, None), (201, ""), (None, "no id"), (202, " "), (202, " "), (203, "  two  three   four    x \n  y \n\n z "), (-5, "minus"), (big, "large " * 30_000), (big + 1, "x")]


def test_store_equals_library(spark, monkeypatch):
    rows = rows_of_text()
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id bigint, text string, start int, part string").repartition(5)
    library = Tokenizer.from_file(PATH)
    path = S.new_store(docs, PATH)
    got = S.read_store(spark, path).collect()
    want, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), ids))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) for r in got), key=lambda r: r[1]) == want
    index = {r["start"]: tuple(r) for r in S.store_index(spark, path).collect()}
    assert index == {a: (i, a, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, a, n, ids in want}
    assert S.read_store(spark, S.new_store(docs.limit(0), PATH)).count() == 0


def test_chunks_equal_library_on_white_space():
    rng = random.Random(8)
    encoder = S.Encoder(PATH)
    texts = ["".join(rng.choices(" \n\t　\xa0\x0b\x1c\x85a'1.é", k=rng.randrange(14))) for _ in range(3000)]
    texts += ["".join(map(chr, rng.choices(range(0x250), k=40))) for _ in range(500)]
    assert encoder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
