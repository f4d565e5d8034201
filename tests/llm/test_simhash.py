import itertools
import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from ledgerloom.llm import simhash as S
from ledgerloom.llm.components import connected_components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints, max_bits):
    left, out = set(prints), {}
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= max_bits}
            left -= near
            group |= near
            todo += near
        out |= dict.fromkeys(group, frozenset(group))
    return out


def brute(rows, max_bits=2):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    group = plain_components({f for _, f in prints}, max_bits)
    least = {}
    for i, f in prints:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    return sorted(((i, f"{f:016x}", least.get(group[f])) for i, f in prints), key=repr)


def texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}É" if i % 7 == 0 else f"Word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = (rows[rng.randrange(len(rows))][1] or "x").split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 60, 200, 600])))))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, "a b"), (n + 3, "A  b"), (n + 4, "tie"), (n + 4, "tie"), (None, "alone here"), (n + 5, "long " * 40_000)]
    return rows


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as fingerprint", "2 as _f0")
    return sorted((tuple(r) for r in S.near_duplicates(docs, **options).collect()), key=repr)


@pytest.mark.parametrize("most", [256, 2])
def test_matches_brute_force(spark, most):
    rows = texts(300)
    assert run(spark, rows, most=most) == brute(rows)


def test_one_bit(spark):
    rows = texts(80, 5)
    assert run(spark, rows, max_bits=1, most=1) == brute(rows, 1)


def test_empty(spark):
    assert run(spark, []) == []


def test_pivot_table_discards_pairs_and_keeps_close_ones():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    prints = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))])[:, None]
    left, right, looked, kept = S.close_pairs(np.zeros(800, np.int64), prints, 2)
    want = sum((int(a) ^ int(b)).bit_count() <= 2 for a, b in itertools.combinations(prints[:, 0], 2))
    assert len(left) == want
    assert looked == 800 * 799 // 2
    assert want <= kept < looked / 100


def test_masks_cover_every_change():
    rng = random.Random(2)
    for bits in (0, 1, 2):
        masks = [m[0] for m in S.exact_masks(bits)]
        for _ in range(300):
            change = sum(1 << b for b in rng.sample(range(64), bits))
            assert any(not change & m for m in masks)


def test_more_bits_are_refused(spark):
    with pytest.raises(ValueError):
        run(spark, texts(3), max_bits=3)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300), (None, 3)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)} | {100: 100} | {200 + i: 100 for i in range(50)} | {300: 300, 301: 300}
    assert pd.Series(got).index.is_unique
