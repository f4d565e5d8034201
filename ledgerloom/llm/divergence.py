"""How far the sources of a language diverge in their terms, with term strings left behind until the end.

1. One scan counts terms. A task puts out, for each group (language and source) and each 64-bit digest of a language and
   a term, how often the term occurs and in how many documents; the string goes with the first group that has it. That
   table is written once.
2. Only digests and numbers are shuffled: documents by digest, then, for the digests that enough documents hold (a Bloom
   filter of bounded size goes before the exact join), counts by group.
3. Strings are read for those digests alone, the least and the greatest of each. Where they differ, the digest names
   several terms: such digests are counted again, by string.
4. Strings join what is put out: the first terms of each group.

Two sources are compared over all kept terms of their language, also those that neither holds. What both lack is the same
for all such terms, and what one lacks depends on the other's count alone, so a join has only terms that both hold:

    sum of f = V f(p0, q0) + sum over terms of the first (f(p, q0) - f(p0, q0)) + sum over terms of the second (f(p0, q) - f(p0, q0))
             + sum over terms of both (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

with p0 and q0 what a term of count 0 has.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices, written
from .line_dedup import may_hold

SCALE = 1_000_000_000
# A byte of a term to itself, in lower case; any other to a blank. Bytes of code points from 0x80 on are from 0x80 on.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 0x20 for b in range(256))
# A task puts its counts out when it holds so many.
MOST_ENTRIES = 1_000_000
FILTER_BITS = 1 << 29
COUNTS = "group bigint, digest bigint, n bigint, docs bigint, low string, high string"
# Pairs are summed when so many rows have come, so many pairs at a time.
ROWS, PAIRS = 200_000, 2_000_000


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def digests(words: list[bytes], bits: int) -> np.ndarray:
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return (h >> np.uint64(64 - bits)).view(np.int64)


def counted(group: int, lang: str, n: Counter, docs: Counter, seen: set[bytes], bits: int, by_string: bool) -> pa.RecordBatch:
    """Rows of COUNTS of one group: a row for each digest, or for each string. A string is a language, a line feed and a
    term. low and high are null where all strings of the digest are in `seen`; high is null where it is low."""
    words = sorted(n)
    head = lang.encode() + b"\n"
    full = [head + w for w in words]
    h = digests(full, bits)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool) if by_string else np.r_[True, h[order][1:] != h[order][:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(h)] - 1
    total = lambda c: np.add.reduceat(np.fromiter((c[w] for w in words), np.int64, len(words))[order], first)
    low, high = order[first].tolist(), order[last].tolist()
    known = [not by_string and a == b and words[a] in seen for a, b in zip(low, high, strict=True)]
    lows = [None if k else full[a] for k, a in zip(known, low, strict=True)]
    highs = [full[b] if a != b else None for a, b in zip(low, high, strict=True)]
    seen.update(words)
    text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
    columns = [pa.array(np.full(len(first), group)), pa.array(h[order][first]), pa.array(total(n)), pa.array(total(docs)), text(lows), text(highs)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in COUNTS.split(", ")])


def term_counts(rows: DataFrame, bits: int, by_string: bool = False) -> DataFrame:
    """COUNTS over rows (group, lang, _text); a digest may have several rows, from several tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            seen: dict[str, set[bytes]] = {}
            for (group, lang), (n, docs) in held.items():
                if n:
                    yield counted(group, lang, n, docs, seen.setdefault(lang, set()), bits, by_string)
            held.clear()

        for batch in batches:
            groups = list(zip(batch.column("group").to_pylist(), batch.column("lang").to_pylist(), strict=True))
            for start, part in text_slices(batch):
                for group, text in zip(groups[start : start + len(part)], part, strict=True):
                    own = terms(text)
                    n, docs = held.setdefault(group, (Counter(), Counter()))
                    before = len(n)
                    n.update(own)
                    docs.update(set(own))
                    size += len(n) - before
                if size > MOST_ENTRIES:
                    yield from out()
                    size = 0
        yield from out()

    return rows.mapInArrow(count, COUNTS)


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE (n + 1) / total); a count of a whole corpus times SCALE does not fit a long."""
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_counts(rows: DataFrame, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(group, digest, sub, n, lang_n, first) of the kept terms that a group holds, with their count in all groups of the
    language and a mark on one row of each term; and (digest, sub, term) of the kept terms.

    sub is empty, but for digests that name several terms: there it is the string. Both tables are dealt by digest.
    """
    found = written(term_counts(rows, bits), "term-counts")
    vocabulary = written(found.groupBy("digest").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("digest"), "kept-digests")
    may = may_hold(vocabulary, FILTER_BITS)
    counts = found.filter(may("digest")).select("group", "digest", "n").repartition("digest").groupBy("group", "digest").agg(F.sum("n").alias("n"))
    counts = counts.join(vocabulary, "digest", "left_semi").select("group", "digest", F.lit("").alias("sub"), "n")
    strings = found.filter("low is not null").filter(may("digest")).groupBy("digest").agg(F.min("low").alias("low"), F.max(F.coalesce("high", "low")).alias("high"))
    strings = written(strings, "kept-strings")
    split = strings.filter("low <> high").select("digest")
    named = strings.filter("low = high").select("digest", F.lit("").alias("sub"), F.col("low").alias("string"))
    if not split.isEmpty():
        suspect = may_hold(split, FILTER_BITS)
        again = term_counts(rows, bits, by_string=True).withColumnRenamed("low", "sub").filter(suspect("digest")).join(split, "digest", "left_semi")
        again = written(again.groupBy("group", "digest", "sub").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "split-counts")
        parted = again.groupBy("digest", "sub").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("digest", "sub")
        counts = counts.join(split, "digest", "left_anti").unionByName(again.join(parted, ["digest", "sub"], "left_semi").select("group", "digest", "sub", "n"))
        named = named.unionByName(parted.withColumn("string", F.col("sub")))
    term = Window.partitionBy("digest", "sub")
    counts = counts.withColumns({"lang_n": F.sum("n").over(term), "first": F.col("group") == F.min("group").over(term)})
    return written(counts, "kept-counts"), named.withColumn("term", F.substring_index("string", "\n", -1)).drop("string")


def pair_sums(start: np.ndarray, group: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, other group, sum) over the terms that both hold, the last sum of the formula above.

    Rows of one term lie together; start is where the term of each row starts. Pairs are laid out a bounded number at a time.
    """
    names, g = np.unique(group, return_inverse=True)
    size = np.bincount(start, minlength=len(start))[start]
    cuts = np.searchsorted(np.cumsum(size), np.arange(PAIRS, size.sum() + PAIRS, PAIRS))
    f = lambda x, y: (x - y) * (x - y) // y
    for low, high in itertools.pairwise([0, *(np.unique(np.minimum(cuts + 1, len(start)))).tolist()]):
        n = size[low:high]
        a = np.repeat(np.arange(low, high), n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start[low:high], n)
        a, b = a[a != b], b[a != b]
        value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
        code, at = np.unique(g[a] * len(names) + g[b], return_inverse=True)
        out = np.zeros(len(code), np.int64)
        np.add.at(out, at, value)
        yield names[code // len(names)], names[code % len(names)], out


def both_hold(shares: DataFrame) -> DataFrame:
    """(group, other, part): pair_sums over shares (digest, sub, group, p, p0), in tasks by digest."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}

        def add(table: pa.Table) -> None:
            columns = [table.column(c).to_numpy() for c in ("digest", "group", "p", "p0")]
            new = np.r_[True, (columns[0][1:] != columns[0][:-1]) | pc.not_equal(table.column("sub").slice(1), table.column("sub").slice(0, len(table) - 1)).to_numpy()]
            for a, b, values in pair_sums(np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)), *columns[1:]):
                for x, y, v in zip(a.tolist(), b.tolist(), values.tolist(), strict=True):
                    sums[x, y] = sums.get((x, y), 0) + v

        def out() -> pa.RecordBatch:
            keys = list(sums)
            batch = pa.record_batch({"group": pa.array([a for a, _ in keys], pa.int64()), "other": pa.array([b for _, b in keys], pa.int64()), "part": pa.array(list(sums.values()), pa.int64())})
            sums.clear()
            return batch

        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch])
                if len(held) < ROWS:
                    continue
                digest = held.column("digest").to_numpy()
                cut = int(np.searchsorted(digest, digest[-1]))  # all but the last digest are complete
                if not cut:
                    continue
                add(held.slice(0, cut))
                held = held.slice(cut)
            elif held is not None and len(held):
                add(held)
            if len(sums) > MOST_ENTRIES:
                yield out()
        yield out()

    dealt = shares.select("digest", "sub", "group", "p", "p0").repartition("digest").sortWithinPartitions("digest", "sub")
    return dealt.mapInArrow(summed, "group bigint, other bigint, part bigint")


def numbering(seed: int) -> Column:
    """A number for a language and source."""
    return F.xxhash64(F.lit(seed), "lang", "source")


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200, digest_bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of each language diverge.

    A term is a run of letters A-Z and of code points from 0x80 on, with A-Z in lower case. A language keeps the terms
    that at least min_docs of its documents hold; each row of docs is a document, repeated ones too. A group (language
    and source) of N occurrences of kept terms gives each of the V kept terms a share p = 1 + floor(10^9 (n + 1) / (N + V)),
    and so does the language as a whole. Part `pair` has, for each other source of the language with share q, the sum over
    all kept terms of floor((p - q)^2 / q); it is 0 where nothing is kept. Part `term` has the first `top` of the terms
    that the group holds and whose share is above that of the language, with the same measure. rank counts from 1 by value,
    descending, and item.

    Null languages, sources and texts are empty strings. Groups without terms are there, in part `pair`. Other columns
    are dropped. digest_bits: fewer bits make digests meet; the rows stay the same.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).cast("binary").alias("_text"))
    groups = written(rows.select("lang", "source").distinct(), "groups")
    number = next(n for n in map(numbering, itertools.count()) if groups.select(n.alias("n")).distinct().count() == groups.count())
    found, names = kept_counts(rows.select(number.alias("group"), "lang", "_text"), min_docs, digest_bits)

    of_group = found.groupBy("group").agg(F.sum("n").alias("total"), F.count_if("first").alias("terms"))
    groups = groups.withColumn("group", number).join(of_group, "group", "left").fillna(0, ["total", "terms"])
    langs = groups.groupBy("lang").agg(F.sum("terms").alias("terms"), F.sum("total").alias("lang_total"))
    groups = groups.drop("terms").join(langs, "lang").withColumns({"total": F.col("total") + F.col("terms"), "lang_total": F.col("lang_total") + F.col("terms")})
    # Without kept terms there is no share; any positive one gives 0 below.
    groups = written(groups.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"))).otherwise(1)), "group-totals")
    shares = found.join(groups.select("group", "total", "lang_total", "p0"), "group").withColumn("p", share(F.col("n"), F.col("total")))

    value, rank = F.col("value"), lambda *order: Window.partitionBy("group").orderBy(*order)
    above = shares.withColumn("q", share(F.col("lang_n"), F.col("lang_total"))).filter("p > q").withColumn("value", apart(F.col("p"), F.col("q")))
    first = above.select("digest", "sub", "group", "value").withColumn("_place", F.rank().over(rank(value.desc()))).filter(F.col("_place") <= top)
    named = first.join(names, ["digest", "sub"]).select("group", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    named = named.withColumn("rank", F.row_number().over(rank(value.desc(), F.col("item")))).filter(F.col("rank") <= top)

    p, p0, q0 = (F.col(x) for x in ("p", "p0", "q0"))
    other = groups.select("lang", F.col("group").alias("other"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = written(groups.select("lang", "group", "p0", "terms").join(other, "lang").filter("group <> other").drop("lang"), "group-pairs")
    exact = lambda c: c.cast("decimal(38,0)").alias("part")
    nothing = pairs.select("group", "other", exact(F.col("terms").cast("decimal(20,0)") * apart(p0, q0)))
    of_count = shares.groupBy("group", "n", "p").agg(F.count("*").alias("times"))
    one = of_count.join(pairs.drop("terms"), "group")
    times = lambda c: exact(F.sum(c.cast("decimal(20,0)") * F.col("times").cast("decimal(18,0)")))
    left = one.groupBy("group", "other").agg(times(apart(p, q0) - apart(p0, q0)))
    right = one.groupBy(F.col("other").alias("group"), F.col("group").alias("other")).agg(times(apart(q0, p) - apart(q0, p0)))
    both = both_hold(shares).select("group", "other", exact(F.col("part")))
    total = nothing.unionByName(left).unionByName(right).unionByName(both).groupBy("group", "other").agg(F.sum("part").cast("long").alias("value"))
    paired = total.join(pairs.select("group", "other", "item"), ["group", "other"]).select("group", F.lit("pair").alias("part"), "item", "value")
    paired = paired.withColumn("rank", F.row_number().over(rank(value.desc(), F.col("item"))))
    return paired.unionByName(named).join(groups.select("group", "lang", "source"), "group").select("lang", "source", "part", "item", "value", "rank")
