"""Periodic runs of words, found from multi-scale minimizers.

Texts of a batch lie in one flat array of word numbers, parted by numbers that occur once. A run of period q and at least
2 q words is found in one of two ways:

1. q below LAGS: the array is compared with itself at that distance.
2. q of scale k, in [2^k, 2^(k+1)): grams of 2^(k-1) words are hashed, and of each window of 2^(k-1) grams the least one
   is picked, the leftmost of equals. A window and the same one q words on hold the same words and both fit in the run,
   so they pick equal grams at distance q. Picked grams that are equal and lie that far apart are the seeds; a seed grows
   to both sides by binary search over prefix hashes.

Equal grams half a gram apart or less overlap and lie in one run of a shorter period, so they form a chain. A pair within a chain
is no seed: it would grow to that run again. Two chains give each distance between their members once, as steps of one
progression. At most nine chains of a gram start within reach of another, so seeds are few however periodic a text is.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, text_slices

SHORTEST = 12
LAGS_SCALE = 5
LAGS = 1 << LAGS_SCALE
# Prefix hashes: polynomials over two primes below 2^31.
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_103_515_245, 747_796_405)
RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")]), False)
RUNS_ARROW = pa.list_(pa.field("element", pa.struct([pa.field(x, pa.int64(), False) for x in ("start", "length", "period")]), False))

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lag_runs(x: np.ndarray, lag: int) -> Found:
    """(start, end, lag) of the stretches that keep this lag, long enough for a run."""
    edges = np.flatnonzero(np.diff(x[lag:] == x[:-lag], prepend=False, append=False))
    start, end = edges[::2], edges[1::2] + lag
    long = end - start >= max(SHORTEST, 2 * lag)
    return start[long], end[long], np.full(int(long.sum()), lag)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash of each window of `width` (a power of two) positions, the leftmost of equals, each once."""
    bits = np.uint64(len(h).bit_length())
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]]


def seeds(at: np.ndarray, h: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, lag) of equal picked grams with a lag in [2^scale, 2^(scale + 1)), from different chains. h: the grams' hashes."""
    low, high = 1 << scale, 2 << scale
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    new = np.r_[True, h[1:] != h[:-1]]
    gap = np.r_[0, np.diff(at)]
    head = new | (gap > low // 4)
    heads = np.flatnonzero(head)
    first, last = at[heads], at[np.r_[heads[1:], len(at)] - 1]
    gram = np.cumsum(new)[heads]
    step = np.gcd.reduceat(np.where(head, 0, gap), heads)
    for t in itertools.count(1):
        a = np.flatnonzero((gram[t:] == gram[:-t]) & (first[t:] - last[:-t] < high)) if t < len(heads) else []
        if not len(a):
            return
        b = a + t
        least, most, g = first[b] - last[a], last[b] - first[a], np.maximum(np.gcd(step[a], step[b]), 1)
        skipped = np.maximum(low - least + g - 1, 0) // g
        n = np.maximum((np.minimum(most, high - 1) - least) // g - skipped + 1, 0)
        pair = np.repeat(np.arange(len(a)), n)
        lag = least[pair] + g[pair] * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + skipped[pair])
        yield np.maximum(first[a[pair]], first[b[pair]] - lag), lag


class Prefixes:
    """Hashes of any stretch of an array, and how far two stretches agree."""

    def __init__(self, x: np.ndarray):
        self.n, values = len(x), mixed(x.astype(np.uint64) + np.uint64(1))
        self.parts = []
        for k, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
            powers = np.ones(1, np.uint64)
            while len(powers) <= self.n:
                powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), prime)) % np.uint64(prime)])
            powers = powers[: self.n + 1]
            terms = (values >> np.uint64(32 * k) & np.uint64(0x7FFFFFFF)) % np.uint64(prime) * powers[:-1] % np.uint64(prime)
            self.parts.append((np.uint64(prime), powers, np.r_[np.uint64(0), np.cumsum(terms)] % np.uint64(prime)))

    def equal(self, i: np.ndarray, lag: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.ones(len(i), bool)
        for prime, powers, sums in self.parts:
            own, other = sums[i + n] + prime - sums[i], sums[i + lag + n] + prime - sums[i + lag]
            out &= own % prime * powers[lag] % prime == other % prime
        return out

    def reach(self, i: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the stretch around i in which each value is that of lag values on."""
        back, ahead = np.zeros_like(i), np.zeros_like(i)
        for size in (1 << b for b in reversed(range(self.n.bit_length()))):
            most = ahead + size
            fits = np.flatnonzero(i + lag + most <= self.n)
            ahead[fits[self.equal(i[fits], lag[fits], most[fits])]] += size
            most = back + size
            fits = np.flatnonzero(i >= most)
            back[fits[self.equal(i[fits] - most[fits], lag[fits], most[fits])]] += size
        return i - back, i + ahead


def runs_of(x: np.ndarray, longest: int) -> Found:
    """(start, end, period) of every run, by start and period. No run is longer than `longest` values."""
    parts = [lag_runs(x, lag) for lag in range(1, min(LAGS, longest // 2 + 1))]
    h, prefixes = mixed(x.astype(np.uint64) + np.uint64(1)), None
    for scale in range(1, (longest // 2).bit_length()):
        # h holds the grams of 2^(scale - 1) values.
        if scale >= LAGS_SCALE:
            at = window_minima(h, 1 << (scale - 1))
            for i, lag in seeds(at, h[at], scale):
                prefixes = prefixes or Prefixes(x)
                start, end = prefixes.reach(i, lag)
                twice = end - start >= lag
                parts.append((start[twice], (end + lag)[twice], lag[twice]))
        size = 1 << (scale - 1)
        h = mixed(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:])
    start, end, period = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]).astype(np.int64) for k in range(3))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # A stretch that keeps several lags has the least as its period: it divides the others.
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def flat(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words of all texts with a number of its own after each text, where each text starts)."""
    names: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    out = np.empty(int(sizes.sum()) + len(words), np.int64)
    for at, own in zip(starts.tolist(), words, strict=True):
        out[at : at + len(own)] = [names.setdefault(w, len(names)) for w in own]
    out[starts + sizes] = len(names) + np.arange(len(words))
    return out, starts


def measured(texts: list[bytes | None]) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of each text."""
    words = [(t or b"").split() for t in texts]
    x, starts = flat(words)
    start, end, period = runs_of(x, max(map(len, words), default=0))
    text = np.searchsorted(starts, start, side="right") - 1
    gone = np.zeros(len(x) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    stays = np.cumsum(gone)[:-1] == 0
    collapsed, has = [], set(text.tolist())
    for i, own in enumerate(words):
        if i in has:
            own = list(itertools.compress(own, stays[starts[i] : starts[i] + len(own)].tolist()))
        collapsed.append(b" ".join(own))
    fields = [pa.array(v, pa.int64()) for v in (start - starts[text], end - start, period)]
    offsets = pa.array(np.searchsorted(text, np.arange(len(words) + 1)), pa.int32())
    runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(RUNS_ARROW.value_type)), type=RUNS_ARROW)
    return runs, pa.array(collapsed, pa.binary()).cast(pa.string())


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `runs`, an array of (start, length, period), and `collapsed`; columns of these names are replaced.

    A run is a stretch of words with smallest period q and at least max(12, 2 q) words that no word next to it extends
    with that period; words are numbered from 0. Runs come by start, then period, all of them, whatever their period.
    collapsed is the text without the words that some run holds after its first q, words joined by a space. Null, empty
    and blank texts have no words: no runs and an empty collapsed text. Rows are judged one by one, however often they
    are repeated; a text is looked at as a whole, in one task.
    """
    rows, at = numbered(docs)
    text = rows.withColumn("_text", F.col(at[text_col]).cast("binary"))
    kept = {c: n for c, n in at.items() if c not in ("runs", "collapsed")}
    shape = T.StructType([*[rows.schema[n] for n in kept.values()], T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_slices(batch):
                runs, collapsed = measured(part)
                own = batch.slice(first, len(part)).select(list(kept.values()))
                yield pa.RecordBatch.from_arrays([*own.columns, runs, collapsed], names=shape.names)

    return text.select(*kept.values(), "_text").mapInArrow(found, shape).toDF(*kept, "runs", "collapsed")
