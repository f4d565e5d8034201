import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import periodic as P
from ledgerloom.llm import queries as Q


def brute(words):
    """Every run, from each lag and start."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(words):
    gone = {i for s, n, q in brute(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def measured(texts):
    runs, collapsed = P.measured([None if t is None else t.encode() for t in texts])
    return [[tuple(r.values()) for r in x] for x in runs.to_pylist()], collapsed.to_pylist()


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return ["ab"[i.bit_count() & 1] for i in range(n)]


def odd_words():
    rng = random.Random(4)
    yield fibonacci(700)
    yield thue_morse(512)
    yield ["a"] * 500
    yield (["a", "b"] * 60 + ["a"]) * 3
    yield (["a", "b"] * 60 + ["a"] + ["b", "a"] * 70) * 2 + ["c"]
    yield (["a"] * 90 + ["b"]) * 4 + ["a"] * 90
    yield (fibonacci(89) + ["x"]) * 3
    yield ((["a", "b", "c"] * 25 + ["a"]) * 2 + ["z"]) * 3
    for period in (31, 32, 33, 63, 64, 65, 100, 127, 128):
        block = [f"w{rng.randrange(1000)}" for _ in range(period)]
        yield ["pre"] * 3 + (block * 3)[: 2 * period] + ["post"]
        yield block * 2 + block[: period // 2] + block * 2
    for _ in range(60):
        block = rng.choices("ab", k=rng.randrange(1, 70))
        words = []
        while len(words) < 400:
            words += block * rng.randrange(1, 6) + rng.choices("abc", k=rng.randrange(4))
        yield words


def test_all_runs_of_periodic_texts():
    cases = list(odd_words())
    runs, collapsed = measured([" ".join(w) for w in cases])
    for words, got, text in zip(cases, runs, collapsed, strict=True):
        assert got == brute(words)
        assert text == brute_collapsed(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=50).flatmap(lambda b: st.integers(1, 5).map(lambda k: b * k)), max_size=8))
def test_all_runs_of_random_texts(parts):
    words = [w for p in parts for w in p]
    assert measured([" ".join(words), " ".join(words[::-1])])[0] == [brute(words), brute(words[::-1])]


def test_seeds_stay_few_in_long_periodic_texts():
    for words in (["a"] * 60_000, (["a", "b"] * 10_000 + ["a"]) * 3, fibonacci(60_000), [f"w{i % 3000}" for i in range(60_000)]):
        x, _ = P.flat([[w.encode() for w in words]])
        h, size = P.mixed(x.astype("uint64")), 1
        total = 0
        for scale in range(1, (len(words) // 2).bit_length()):
            if scale >= P.LAGS_SCALE:
                at = P.window_minima(h, 1 << (scale - 1))
                total += sum(len(i) for i, _ in P.seeds(at, h[at], scale))
            size = 1 << (scale - 1)
            h = P.mixed(h[:-size] * P.np.uint64(0x9E3779B97F4A7C15) + h[size:])
        assert total < 16 * len(words)


def odd_rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n\t", "a", "x " * 12, "x " * 11, "é É " * 10, "a\x0bb\x0c" * 9 + "\x1c", " ".join(rng.choices(words, k=250)), "tie tie " * 20, "tie tie " * 20]
    rows = [(i, t, i, "r", "c") for i, t in enumerate(texts)]
    return rows + [(None, "x y " * 30, 1, None, "c"), (9, "tie tie " * 20, 9, "r", "c"), (99, " ".join(rng.choices(words, k=200_000)), 1, "r", "c")]


def test_odd_rows_and_clashing_names(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _text bigint, runs string, collapsed string")
    out = P.periodic_runs(docs).collect()
    assert len(out) == len(rows) and out[0].__fields__ == ["doc_id", "text", "_text", "runs", "collapsed"]
    for r in out:
        if r["doc_id"] != 99:
            words = [w for w in (r["text"] or "").translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
            assert [tuple(x) for x in r["runs"]] == brute(words)
            assert r["collapsed"] == brute_collapsed(words)
    assert P.periodic_runs(docs.limit(0)).count() == 0


def expected(doc_id, text):
    words = [w for w in (text or "").translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapsed(words)))


@pytest.fixture
def sf_dir(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, t) for i, t, *_ in odd_rows()[:-1]] + [(100 + i, " ".join(rng.choices("abcdefgh", k=rng.randrange(300)))) for i in range(150)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def test_query_equals_brute_force(spark, sf_dir):
    at, rows = sf_dir
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in Q.op11_periodic_runs(spark, at).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 8
