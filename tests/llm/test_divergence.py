import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from ledgerloom.llm import divergence as D
from ledgerloom.llm import queries as Q

from ..conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, top=200):
    """(lang, source, part, item, value, rank) over rows (lang, source, text), each term of each pair by itself."""
    docs = [(a or "", b or "", terms(t)) for a, b, t in rows]
    held, count, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        held[lang].update(set(words))
        count[lang, source].update(words)
        whole[lang].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in held[lang].items() if n >= 3]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        sources = sorted({d[1] for d in docs if d[0] == lang})
        p, q = {s: share(count[lang, s]) for s in sources}, share(whole[lang])
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            own = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                ranked = sorted((v, x.encode(), x) for v, x in found)
                out += [(lang, s, part, x, -v, i) for i, (v, _, x) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


def samples():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdé", k=rng.randrange(1, 4))) for _ in range(80)] + ["ſ", "straße", "ÉTÉ", "zz"]
    rows = [(rng.choice(["en", "en", "fr", None]), rng.choice(["a", "b", "c", None, "É"]), " ".join(rng.choices(vocabulary, k=rng.randrange(60))).title()) for _ in range(150)]
    rows += [("en", "hot", " ".join(rng.choices(vocabulary, k=50))) for _ in range(80)]
    rows += [("xx", "alone", "only here"), ("xx", "other", None), ("de", "d", ""), ("en", "none", " 12 \t"), ("", "a", "x1y_z[q`r{s\x7ft u"), ("en", "long", "word " * 50_000)]
    rows += [rows[0], rows[0], ("en", "hot", rows[3][2])]
    return rows


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize(("bits", "top"), [(64, 200), (64, 3), (5, 200), (1, 200)])
def test_equals_brute_force_also_when_digests_meet(spark, bits, top):
    rows = samples()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, digest bigint, value string").repartition(5)
    got = D.source_divergence(docs, top=top, digest_bits=bits)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, top)


def test_tasks_put_counts_out_more_than_once(spark, monkeypatch):
    rows = samples()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    monkeypatch.setattr(D, "MOST_ENTRIES", 1)
    monkeypatch.setattr(D, "ROWS", 7)
    monkeypatch.setattr(D, "PAIRS", 5)
    assert sorted(tuple(r) for r in D.source_divergence(docs).collect()) == brute(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert D.source_divergence(docs).collect() == []
    docs = spark.createDataFrame([("en", "a", None), ("en", "b", "x")], "lang string, source string, text string")
    assert sorted(tuple(r) for r in D.source_divergence(docs).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_of_large_counts_are_exact(spark):
    n, total = 9 * 10**15, 10**16 + 1
    row = spark.range(1).select(D.share(D.F.lit(n), D.F.lit(total)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // total


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(Q.OP13_SQL).fetchall()
    got = [tuple(r) for r in Q.op13_source_divergence(spark, SF).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(want) and len(got) > 1000
