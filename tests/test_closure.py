import random
from collections import defaultdict, deque

import pytest

from ledgerloom.operators import matching as M


def brute(edges, roots, most=None):
    out, below = set(), defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            below[a].add(b)
    for r in set(roots):
        depth, todo = {r: 0}, deque([r])
        while todo:
            x = todo.popleft()
            if most is not None and depth[x] >= most:
                continue
            for y in below[x] if x is not None else ():
                if y not in depth:
                    depth[y] = depth[x] + 1
                    todo.append(y)
        out |= {(r, n, d) for n, d in depth.items()}
    return out


def graphs():
    rng = random.Random(7)
    yield [(i, i + 1) for i in range(40)], [0, 5, 40, 99]
    yield [(i, (i + 1) % 12) for i in range(12)] + [(20, 3), (7, 30), (30, 31), (31, 32)], [0, 20, 32]
    yield [(i, (i + 1) % 12) for i in range(12)] + [(20, 21)], [20]  # a circle that no root leads to
    yield [(i, i + 1) for i in range(30)] + [(i, 100 + i) for i in range(30)], [0, 10]  # leaves on a chain
    yield [(1, 1), (1, 2), (2, 1), (None, 3), (3, None), (2, 3)], [1, 3, None]
    yield [(0, i) for i in range(1, 6)] + [(i, 9) for i in range(1, 6)] + [(9, 10), (10, 11), (0, 11)], [0]
    for n in (10, 30):
        for _ in range(4):
            yield [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(n * 2))], rng.sample(range(n), 3)


@pytest.mark.parametrize("most", [None, 0, 3])
def test_equals_search(spark, most):
    # All graphs at once, each with numbers of its own.
    edges, roots, want = [], [], set()
    for k, (own, start) in enumerate(graphs()):
        name = lambda x: None if x is None else k * 1000 + x  # noqa: B023, E731
        edges += [(name(a), name(b)) for a, b in own]
        roots += [name(r) for r in start]
    want = brute(edges, roots, most)
    got = M.descendants(spark.createDataFrame(edges, "parent long, child long"), spark.createDataFrame([(r,) for r in roots], "root long"), max_depth=most)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_long_chain_closes_in_few_rounds(spark, monkeypatch):
    n, writes = 100_000, []
    plain = M.written
    monkeypatch.setattr(M, "written", lambda df, name: writes.append(name) or plain(df, name))
    edges = spark.range(n).selectExpr("id as parent", "id + 1 as child")
    got = M.descendants(edges, spark.createDataFrame([(0,)], "root long"))
    assert got.selectExpr("count(*)", "max(depth)", "sum(depth - node)").first()[:] == (n + 1, n, 0)
    assert writes.count("chains") <= 20 and writes.count("frontier") <= 3


def test_empty(spark):
    none = spark.createDataFrame([], "parent long, child long")
    roots = spark.createDataFrame([(1,), (1,)], "root long")
    assert [tuple(r) for r in M.descendants(none, roots).collect()] == [(1, 1, 0)]
    assert M.descendants(none, roots.limit(0)).count() == 0
