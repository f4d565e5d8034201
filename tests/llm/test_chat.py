import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.llm import chat as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = ["<|", "|>", "\\", "\\\\", "<|end|>", "<|turn|>", "<", "|", "</s>[INST] ok [/INST]", " ", "\n", "é", "😀", "word", "<\\|", "é"]


@given(st.lists(st.tuples(st.text() | st.sampled_from(WORDS), st.lists(st.sampled_from(WORDS)).map("".join)), max_size=6))
def test_render_is_reversible(turns):
    text, spans = C.render(turns, "x")
    assert C.read_turns(text) == turns
    for _, t in turns:
        assert not any(c in C.escape(t) for c in (C.TURN, C.TEXT, C.END)) and C.unescape(C.escape(t)) == t


def conversations():
    rng = random.Random(6)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(WORDS, k=rng.randrange(30)))))
    rows += [(50, 0, "assistant", None), (50, 1, None, "x"), (50, None, "assistant", "first"), (51, 0, "assistant", ""), (None, 1, "user", "no id"), (52, 3, "assistant", "tie b"), (52, 3, "assistant", "tie a"), (52, 3, "assistant", "tie a")]
    rows += [(60, t, ["user", "assistant"][t % 2], f"turn {t} " * 50) for t in range(400)] + [(61, 0, "assistant", "very long é " * 20_000)]
    return rows


def test_digests_and_turns(spark):
    rows = conversations()
    rng = random.Random(1)
    mixed = rng.sample(rows, len(rows))
    docs = spark.createDataFrame([(*r, "x") for r in mixed], "conv_id bigint, turn int, role string, text string, block string").repartition(4)
    blocks = C.format_conversations(docs, PATH, block_chars=3000).cache()
    out = {r["conv_id"]: r for r in C.digest_conversations(blocks).collect()}
    low = lambda x: (x is not None, x or 0)
    own = {}
    for c, t, role, text in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    assert set(out) == set(own)
    for c, turns in own.items():
        r, said = out[c], "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r["formatted_chars"] == len(C.render(turns, "assistant")[0])
    back = {}
    for r in sorted(C.read_formatted(blocks).collect(), key=lambda r: (r["part"], r["block"], r["position"])):
        back.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert back == own
    ids = {}
    for r in sorted(blocks.collect(), key=lambda r: (r["part"], r["block"])):
        ids.setdefault(r["conv_id"], []).extend(r["ids"])
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"]) == len(r["loss"])
    for c, turns in own.items():
        assert ids[c] == C.load(PATH).encode(C.render(turns, "")[0], add_special_tokens=False).ids
    assert C.digest_conversations(C.format_conversations(docs.limit(0), PATH)).count() == 0


def test_conversations_are_encoded_whole_and_hot_ones_dealt_by_ranges(spark):
    rng = random.Random(2)
    rows = [(7, t, ["user", "assistant"][t % 2], f"turn {t} é") for t in range(2500)] + [(None, t, "assistant", f"no id {t}") for t in range(1100)]
    rows += [(c, t, ["user", "assistant"][t % 2], "".join(rng.choices(WORDS, k=60))) for c in range(100, 300) for t in range(5)]
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), "conv_id bigint, turn int, role string, text string").repartition(5)
    blocks = C.format_conversations(docs, PATH).cache()
    n = {r["conv_id"]: r["count"] for r in blocks.groupBy("conv_id").count().collect()}
    assert n[7] > 1 and all(n[c] == 1 for c in range(100, 300))
    out = {r["conv_id"]: r for r in C.digest_conversations(blocks).collect()}
    own = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        own.setdefault(c, []).append((role, text))
    for c, turns in own.items():
        assert out[c]["n_turns"] == len(turns)
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert out[c]["loss_sha256"] == hashlib.sha256("".join(b for a, b in turns if a == "assistant").encode()).hexdigest()


@given(st.lists(st.integers(1, 5), max_size=30), st.data())
def test_mask_equals_plain_overlap(lengths, data):
    cuts = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    marks = sorted(data.draw(st.sets(st.integers(0, int(cuts[-1])), max_size=8)))
    spans = np.array(list(zip(marks[::2], marks[1::2], strict=False)), np.int64).reshape(-1, 2)
    offsets = np.stack([cuts[:-1], cuts[1:]], axis=1)
    want = [any(a < y and b > x for x, y in spans) for a, b in offsets]
    assert C.mask(offsets, spans).tolist() == want
