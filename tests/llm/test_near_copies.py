import itertools
import random

import numpy as np

from ledgerloom.llm import near_copies as N


def similarity(a, b):
    x, y = N.shingles(a, 5), N.shingles(b, 5)
    return len(x & y) / len(x | y)


def changed(rng, words, n):
    """words with n of them replaced, far enough from each other that each spoils five shingles."""
    out = list(words)
    for at in rng.sample(range(4, len(words) - 4, 5), n):
        out[at] = f"new{rng.getrandbits(40)}"
    return out


def pairs_near(limit, n, seed=9):
    """n pairs of texts whose similarity is a little over the limit."""
    rng = random.Random(seed)
    for _ in range(n):
        words = [f"w{rng.getrandbits(40)}" for _ in range(304)]
        # 300 shingles; each change spoils 5: (300 - 5 k) / (300 + 5 k).
        k = int(60 * (1 - limit) / (1 + limit))
        yield " ".join(words), " ".join(changed(rng, words, k))


def groups(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r["component_id"] for r in N.near_copy_groups(docs, **options).collect()}


def test_bands_find_pairs_at_the_limit_whatever_the_size():
    # A band key does not depend on the other texts, so this recall is that of a corpus of any size.
    found = [bool(set(N.minima(a, 5)[1]) & set(N.minima(b, 5)[1])) for a, b in pairs_near(0.8, 1000)]
    apart = [sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(N.minima(a, 5)[2], N.minima(b, 5)[2], strict=True)) for a, b in pairs_near(0.8, 300)]
    assert sum(found) >= 998
    assert max(apart) <= N.BITS_APART and 20 < np.mean(apart) < 31


def test_pairs_at_the_limit_are_grouped(spark):
    pairs = list(pairs_near(0.8, 150))
    assert all(0.8 <= similarity(a, b) < 0.82 for a, b in pairs)
    got = groups(spark, [t for p in pairs for t in p])
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(150))


def brute(texts, limit=0.8):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [N.shingles(t, 5) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


def test_crowded_bands_are_compared_as_a_whole(spark):
    # Members lie about 0.75 from each other, so most are no near copies of a hub, but each has one of its own.
    rng = random.Random(5)
    base = [f"w{rng.getrandbits(40)}" for _ in range(304)]
    texts = []
    for _ in range(200):
        own = changed(rng, base, 8)
        texts += [" ".join(own), " ".join(changed(rng, own, 5))]
    want = brute(texts)
    assert len(set(want.values())) > 50
    for block in (N.BLOCK, 16):
        assert groups(spark, texts, block=block) == want


def test_only_the_similarity_of_shingle_sets_links(spark):
    near, below = list(pairs_near(0.8, 60)), list(pairs_near(0.72, 60, seed=3))
    assert all(0.72 <= similarity(a, b) < 0.8 for a, b in below)
    # Repeated passages count once: the sets are those of the single text.
    rng = random.Random(8)
    words = [f"w{rng.getrandbits(40)}" for _ in range(304)]
    repeated = " ".join(words + words[:40] * 30)
    texts = [t for p in near + below for t in p] + [" ".join(words), repeated, None, "", "a b", "A  b"]
    got = groups(spark, texts)
    assert got == brute(texts) | {243: 242}
    assert all(got[2 * i + 1] == 2 * i for i in range(60)) and all(got[2 * i + 1] == 2 * i + 1 for i in range(60, 120))
    assert got[241] == 240 and got[245] == 244


def test_rows_are_judged_by_their_texts_not_their_ids(spark):
    rng = random.Random(2)
    words = [f"w{rng.getrandbits(40)}" for _ in range(304)]
    near, other = " ".join(changed(rng, words, 3)), " ".join(f"o{i}" for i in range(100))
    # Id 5 names two texts: a near copy of 1, which goes, and one of its own, which stays.
    rows = [(1, " ".join(words), "a", 1, 2), (5, near, "b", 1, 2), (5, other, "c", 1, 2), (7, other, "d", 1, 2), (None, near, "e", 1, 2), (None, "alone", "f", 1, 2), (8, None, "g", 1, 2), (9, " ", "h", 1, 2), (1, " ".join(words), "i", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _node string, _text int, c0 int")
    out = N.without_near_copies(docs).collect()
    assert out[0].__fields__ == docs.columns
    kept = {(r["doc_id"], r["text"]) for r in out}
    assert len(out) == len(kept) == 4 and kept == {(1, " ".join(words)), (5, other), (None, "alone"), (8, None)}
    assert N.without_near_copies(docs.limit(0)).count() == 0


def test_a_block_hashes_each_text_once(monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.getrandbits(40)}" for _ in range(304)]
    texts = [" ".join(changed(rng, base, 1 + k % 10)) for k in range(300)]
    found = [N.minima(t, 5) for t in texts]
    block = {"node": list(range(300)), "root": list(range(300)), "text": texts, "bits": np.array([f[2] for f in found]).view(np.uint64)}
    calls, plain = [], N.hashes
    monkeypatch.setattr(N, "hashes", lambda t, size: calls.append(t) or plain(t, size))
    a, b = (block | {"keys": 2 * np.arange(300)[:, None] + k} for k in (1, 2))
    links = N.block_links(a, b, 5, 4, N.BITS_APART, 0)
    assert len(calls) <= 600
    want, forest = brute(texts), N.Forest()
    for u, v in links:
        forest.join(u, v)
    assert {i: forest.root(i) for i in range(300)} == want and 1 < len(set(want.values())) < 200


def test_bands_are_held_against_their_largest_component(spark):
    # Node 1 is the hub of the band and alone, 10 is alone too, the others are one component.
    rows = spark.createDataFrame([(7, n, 1) for n in range(1, 11)] + [(8, n, 2) for n in (2, 3)], "_key bigint, _node bigint, _hub bigint")
    root = spark.createDataFrame([(n, 2) for n in range(2, 10)], "node bigint, root bigint")
    got = N.mixed_bands(rows, root).collect()
    assert {(r["_key"], r["_n"], r["_m"]) for r in got} == {(7, 10, 2)}
    assert sorted(r["_node"] for r in got if r["_out"]) == [1, 10]


def test_copies_of_one_text_are_not_dealt_by_its_shingles(spark, monkeypatch):
    # All have the form's shingles among their rarest, so over each of these most of them would meet again.
    rng = random.Random(7)
    base = [f"w{rng.getrandbits(40)}" for _ in range(304)]
    texts = [" ".join(changed(rng, base, rng.randrange(4, 14))) for _ in range(200)]
    dealt, within = [], N.within_blocks
    monkeypatch.setattr(N, "within_blocks", lambda mixed, *a: dealt.append(mixed.count()) or within(mixed, *a))
    assert groups(spark, texts, block=16, crowd=4) == brute(texts)
    assert dealt[0] > 0 and sum(dealt[1:]) <= dealt[0]
