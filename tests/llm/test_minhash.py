import itertools
import random
import time

import numpy as np

from ledgerloom.llm import minhash as M
from ledgerloom.llm import near_copies as N
from ledgerloom.llm import queries as Q

from .test_near_copies import changed

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = [w for w in (text or "").translate(LOWER).translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(rows):
    """(id, n_shingles, component, kept) over rows (id, text), by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return sorted(((own, len(s), least.get(find(i)), own == least.get(find(i))) for i, ((own, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near(rng, words, least, most):
    """words with some of them replaced, with a similarity between least and most."""
    while True:
        out = list(words)
        for at in rng.sample(range(len(words)), rng.randrange(1, max(2, len(words) // 12))):
            out[at] = f"new{rng.getrandbits(40)}"
        a, b = plain_set(" ".join(words)), plain_set(" ".join(out))
        if least <= len(a & b) / len(a | b) < most:
            return out


def rows_of(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.3:
            out.append((i, out[rng.randrange(len(out))][1]))
        elif out and kind < 0.6:
            words = (out[rng.randrange(len(out))][1] or "x").split()
            out.append((i, " ".join(near(rng, words, 0.8, 0.95)) if len(words) > 60 else " ".join(words).upper()))
        else:
            out.append((i, " ".join(f"w{rng.getrandbits(20)}" for _ in range(rng.choice([1, 2, 3, 80, 200, 300])))))
    rng.shuffle(out)
    return out + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, "a b"), (n + 3, "A  b"), (n + 4, "tie"), (n + 4, "tie"), (n + 4, "other text here"), (None, "alone here"), (n + 5, "long " * 40_000), (n + 6, "é É"), (n + 7, "É é")]


def got(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, kept string, _node int").repartition(6)
    return sorted((tuple(r) for r in M.minhash_near_duplicates(docs, **options).collect()), key=repr)


def test_matches_brute_force(spark):
    rows = rows_of(250)
    want = brute(rows)
    assert got(spark, rows) == want
    assert len({r[2] for r in want}) < 220
    assert M.minhash_near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_pairs_around_the_threshold(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        words = [f"w{rng.getrandbits(40)}" for _ in range(202)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near(rng, words, 0.85, 0.87) if i % 2 else near(rng, words, 0.82, 0.85)))]
    # 200 of 200 and 35 more shingles on one side give 85 % exactly; one less shared falls short.
    base = [f"b{i}" for i in range(172)]
    rows += [(1000, " ".join(base)), (1001, " ".join(base + [f"c{i}" for i in range(30)])), (1002, " ".join(f"d{i}" for i in range(171))), (1003, " ".join([f"d{i}" for i in range(171)] + [f"e{i}" for i in range(30)]))]
    want = brute(rows)
    assert got(spark, rows) == want
    parts = {r[0]: r[2] for r in want}
    assert parts[1001] == 1000 and parts[1003] == 1003
    assert sum(parts[2 * i] == parts[2 * i + 1] for i in range(120)) == 60


def test_sketches_estimate_similarity():
    rng = random.Random(1)
    limit, errors = M.bits_apart(0.85), []
    for i in range(400):
        words = [f"w{rng.getrandbits(40)}" for _ in range(300)]
        low = (0.85, 0.9, 0.7)[i % 3]
        other = near(rng, words, low, low + 0.02)
        a, b = (N.least_hashes(" ".join(w), 3)[2] for w in (words, other))
        apart = int(np.bitwise_count(M.odd_sketch(a).view(np.uint64) ^ M.odd_sketch(b).view(np.uint64)).sum())
        x, y = plain_set(" ".join(words)), plain_set(" ".join(other))
        errors.append(M.estimated(apart) - len(x & y) / len(x | y))
        assert i % 3 == 2 or apart <= limit
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    # Unrelated texts, and those of similarity 0.5, are far beyond the limit.
    assert M.estimated(limit) > 0.6


def template(rng, n, own, of=304):
    """n texts that share a form of `of` words and have own words of their own, each followed by a near copy."""
    base = [f"w{rng.getrandbits(40)}" for _ in range(of)]
    out = []
    for _ in range(n // 2):
        words = base + [f"o{rng.getrandbits(40)}" for _ in range(own)]
        out += [" ".join(words), " ".join(changed(rng, words, 3))]
    return out


def test_crowded_bands_are_dealt_by_rarest_shingles(spark):
    rows = list(enumerate(template(random.Random(4), 300, 150)))
    want = brute(rows)
    assert len({r[2] for r in want}) == 150
    assert got(spark, rows, block=16, crowd=4) == want == got(spark, rows)


def test_work_on_a_crowded_band_grows_with_its_size(spark):
    took, texts = [], template(random.Random(5), 8000, 40, 60)
    for n in (2000, 8000):
        began = time.perf_counter()
        rows = got(spark, list(enumerate(texts[:n])), block=64, crowd=16)
        took.append(time.perf_counter() - began)
        assert len({r[2] for r in rows}) <= n
    assert took[1] < 8 * took[0]


def test_query_equals_brute_force(spark, tmp_path):
    rows = rows_of(120, seed=5)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = Q.op12_minhash_near_dedup(spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows)
