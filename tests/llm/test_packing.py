import random
from collections import defaultdict

from ledgerloom.llm import packing as P


def plain(lengths, sources, clusters, capacity):
    """Each piece in turn goes to the bin with the least room that is enough and holds no conflict."""
    bins, where = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fits = [(capacity - used, b) for b, (used, ss, cc) in enumerate(bins) if used + n <= capacity and (s is None or s not in ss) and (c is None or c not in cc)]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([0, set(), set()])
        where.append((b, bins[b][0]))
        bins[b][0] += n
        bins[b][1].add(s)
        bins[b][2].add(c)
    return [list(x) for x in zip(*where, strict=True)] or [[], []]


def test_equals_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(120)
        lengths = sorted((rng.randrange(0, 101) for _ in range(n)), reverse=True)
        sources = [rng.choice(["hot", "hot", "a", "b", "c", None]) for _ in range(n)]
        clusters = [rng.choice([1, 2, None, None, None, i + 10]) for i in range(n)]
        assert list(P.best_fit(lengths, sources, clusters, 100)) == plain(lengths, sources, clusters, 100)


def test_whole_documents(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, -3, 0, 5, 300, 2048, 2049, 9000, rng.randrange(3000)]), rng.choice(["src0", "src0", f"src{i % 9}", None]), rng.choice(["c", None, str(i)]), "x", 1) for i in range(700)]
    rows += [(1, 10, "src0", "c", "x", 1)] * 3 + [(None, 7, None, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, n int, source string, cluster string, bin string, piece int")
    for shard in (4096, 100):
        out = P.pack_documents(docs, "n", shard=shard).collect()
        spans = defaultdict(list)
        total = defaultdict(int)
        for r in out:
            spans[r["bin"]].append((r["offset"], r["length"], r["doc_id"]))
            total[r["doc_id"]] += r["length"]
            assert r["start"] == r["piece"] * 2048 and 0 <= r["length"] <= 2048
        want = defaultdict(int)
        for r in rows:
            want[r[0]] += max(0, r[1] or 0)
        assert total == want and len(out) == sum(max(1, -(-max(0, r[1] or 0) // 2048)) for r in rows)
        info = {r[0]: r for r in rows if r[0] != 1 and r[0] is not None}
        for own in spans.values():
            own.sort()
            assert all(a + n <= b for (a, n, _), (b, _, _) in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] <= 2048
            for k in (2, 3):
                held = [info[i][k] for _, _, i in own if i in info and info[i][k] is not None]
                assert len(held) == len(set(held))
        if shard == 100:
            assert len({b >> 32 for b in spans}) > 3
    assert P.pack_documents(docs.limit(0), "n").count() == 0
