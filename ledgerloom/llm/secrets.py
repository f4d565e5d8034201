"""Secret scans in DataFrame expressions only: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

# Candidate strings, and per character class (in order of preference): what belongs to it, its alphabet, and the
# least entropy in bits of a window that counts as random. The last two take every candidate: keys of one case with
# separators, and those without digits, whose limit is higher because words and names come near it.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    ("base36", r"^(?=.*[0-9])([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.6),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-", 3.7),
    ("separated", r"^(?=.*[0-9])[A-Za-z0-9+/_-]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-", 3.7),
    ("letters", r"^[A-Za-z0-9+/_-]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-", 4.0),
)
WINDOW = 20
# Candidates that are no secrets, each pattern over the whole candidate: UUIDs, placeholders of a key's length, runs of
# one character and counted-up characters that leave less than a window on both sides, paths without a part that long.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)^(?=.{0,40}$).*(example|sample|dummy|placeholder|changeme|your[_-])",
    r"^.{0,19}(.)\1{7,}.{0,19}$",
    r"(?i)^.{0,19}(0123456789|abcdefghij).{0,19}$",
    r"^/?([A-Za-z_-]{1,19}/){3}([^/]{1,19}/)*+[^/]{0,19}$",
)
SCALE = 1 << 20
KINDS = ("assign", "access", "hex", "entropy")


# Codes of candidates' characters: 64 times a counter's word, plus its place there. A word holds twelve counters of five bits.
ALPHABET = CLASSES[-1][2]
CODES = [64 * (i // 12) + 5 * (i % 12) for i in range(len(ALPHABET))]
TEXT_BLOCK = 1024


def weighted_logs(window: int) -> list[int]:
    """n * log2(n) for n up to window, in units of 1 / SCALE: whole numbers, so that sums do not drift."""
    return [round(SCALE * n * math.log2(n)) if n > 1 else 0 for n in range(window + 1)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """values[0] joined with all up to values[i], for each i: each round doubles how far back a value reaches."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))

    def step(s: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(s, lambda v, i: F.when(i >= back, join(v, F.get(s, i - back))).otherwise(v))

    return F.aggregate(rounds, values, step)


def matches(text: Column, pattern: str) -> Column:
    """Every match from left to right as array<struct<start, end, hit>> in code points; end is exclusive.

    Positions come from the lengths of matches and of the pieces between them, added up.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")

    def placed(hits: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda piece, hit: F.length(piece) + F.length(hit))
        return let(running(lengths, lambda a, b: a + b), lambda ends: F.transform(hits, lambda hit, i: F.struct((F.get(ends, i) - F.length(hit)).alias("start"), F.get(ends, i).alias("end"), hit.alias("hit"))))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def high_entropy(hit: Column, limit: Column, window: int = WINDOW) -> Column:
    """struct<low, high>: where in hit the windows of high entropy begin and end; low is null when there is none.

    A window slides over the string. The counter of the character that enters goes up by one and that of the character
    that leaves goes down, and so does the sum of n * log2(n), which is small where the entropy is high: it is compared
    with limit. A step costs the same wherever it is.
    """
    logs = weighted_logs(window)
    steps = F.array(*[F.lit(b - a) for a, b in zip([0, *logs], logs, strict=False)])  # what the n-th of one character adds
    codes = F.transform(F.split(hit, ""), lambda c: F.get(F.array(*map(F.lit, CODES)), F.instr(F.lit(ALPHABET), c) - 1))
    moves = let(codes, lambda own: F.transform(own, lambda c, i: F.struct(i.alias("at"), c.alias("new"), F.get(own, i - window).alias("old"))))
    bits = lambda name, *args: F.call_function(name, *args)
    word, spot = lambda c: bits("shiftright", c, F.lit(6)), lambda c: c.bitwiseAND(F.lit(63))
    count = lambda words, c: bits("shiftright", F.get(words, word(c)), spot(c)).bitwiseAND(F.lit(31)).cast("int")
    one = lambda c: bits("shiftleft", F.lit(1).cast("long"), spot(c))

    def found(s: Column, at: Column) -> list[Column]:
        """low and high with the window that ends before `at`, whose sum is that of s."""
        random = (at >= window) & (s["sum"] <= limit)
        return [F.when(random & s["low"].isNull(), at - window).otherwise(s["low"]).alias("low"), F.when(random, at).otherwise(s["high"]).alias("high")]

    def step(s: Column, x: Column) -> Column:
        left = F.coalesce(F.get(steps, count(s["words"], x["old"])), F.lit(0))
        again = F.when(x["new"] == x["old"], 1).otherwise(0)
        entered = F.get(steps, count(s["words"], x["new"]) - again + 1)
        moved = lambda w, k: w + F.when(k == word(x["new"]), one(x["new"])).otherwise(F.lit(0)) - F.when(k == word(x["old"]), one(x["old"])).otherwise(F.lit(0))
        return F.struct(F.transform(s["words"], moved).alias("words"), (s["sum"] - left + entered).alias("sum"), *found(s, x["at"]))

    zeros = F.array(*[F.lit(0).cast("long")] * (max(CODES) // 64 + 1))
    start = F.struct(zeros.alias("words"), F.lit(0).alias("sum"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    return F.aggregate(moves, start, step, lambda s: F.struct(*found(s, F.length(hit))))


def entropy_spans(candidates: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """array<struct<start, end>> of the parts of candidates that look random for their class and are not on the allow list."""
    window_bits = math.log2(WINDOW)

    def classed(x: Column) -> Column:
        limit, banned = F.lit(None).cast("int"), F.lit(False)
        for _, pattern, _, bits in reversed(CLASSES):
            limit = F.when(x["hit"].rlike(pattern), F.lit(math.floor(SCALE * WINDOW * (window_bits - bits)))).otherwise(limit)
        for pattern in allowed:
            banned = banned | x["hit"].rlike(pattern)
        return F.struct(x["start"].alias("start"), x["hit"].alias("hit"), F.when(~banned, limit).alias("limit"))

    judged = F.filter(F.transform(candidates, classed), lambda x: x["limit"].isNotNull())
    looked = F.transform(judged, lambda x: F.struct(x["start"].alias("start"), high_entropy(x["hit"], x["limit"]).alias("part")))
    return F.transform(F.filter(looked, lambda x: x["part"]["low"].isNotNull()), lambda x: F.struct((x["start"] + x["part"]["low"]).alias("start"), (x["start"] + x["part"]["high"]).alias("end")))


def joined_spans(base: Column, random: Column) -> Column:
    """Base spans and those random ones that no base span holds, sorted by start and kind, as struct<start, end, kind>."""

    def outside(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), F.greatest)
        return let(reach, lambda r: F.filter(spans, lambda x, i: (x["kind"] < 3) | (F.get(r, i) < x["end"])))

    kept = F.when(F.size(random) > 0, let(F.array_sort(F.concat(base, random)), outside)).otherwise(F.array_sort(base))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def scan_secrets(docs: DataFrame, text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with a column spans: array<struct<start, end, kind>> sorted by start and kind; kind indexes KINDS.

    Base kinds are the leftmost matches that do not overlap, each kind on its own; `assign` needs a value of at least
    8 characters. `entropy` adds the random-looking part of candidate strings, where no base span holds it already.
    Null and empty texts have no spans. A column named spans is replaced; no row is lost or joined with another. The
    work grows in proportion to a text's length and, but for a logarithm, to its matches.
    """
    rows, at = numbered(docs)
    text = F.coalesce(F.col(at[text_col]), F.lit(""))
    kind = lambda a, n: F.transform(a, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind"), x["end"].alias("end")))
    found = rows.withColumns({"_assign": matches(text, ASSIGN), "_access": matches(text, ACCESS), "_hex": matches(text, HEX), "_candidates": matches(text, CANDIDATE)})
    found = found.withColumns({
        "_base": F.concat(kind(F.filter("_assign", lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 8), 0), kind(F.col("_access"), 1), kind(F.col("_hex"), 2)),
        "_random": kind(entropy_spans(F.col("_candidates"), allowed), 3),
    })
    found = found.withColumn("_spans", joined_spans(F.col("_base"), F.col("_random")))
    return found.select(*[F.col(i).alias(c) for c, i in (at | {"spans": "_spans"}).items()])


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping spans replaced by mark. The text is cut into blocks, so that a part of it is found without a walk from its start."""

    def gaps(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            block = lambda i: F.floor(i / TEXT_BLOCK).cast("int")
            near = F.array_join(F.slice(blocks, block(a) + 1, block(b - 1) - block(a) + 1), "")
            return F.when(b > a, near.substr(a % TEXT_BLOCK + 1, b - a)).otherwise("")

        def cut(reach: Column) -> Column:
            first = lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1))
            starts = F.transform(F.filter(spans, lambda x, i: first(i)), lambda x: x["start"])
            ends = F.filter(reach, lambda r, i: F.coalesce(first(i + 1), F.lit(True)))
            return F.array_join(F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(starts, F.array(F.length(text))), piece), mark)

        return let(running(F.transform(spans, lambda x: x["end"]), F.greatest), cut)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0)), gaps)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping secret spans in text_col replaced by mark; null texts stay null. Other columns, one named spans too, stay."""
    rows, at = numbered(docs)
    text = F.col(at[text_col])
    done = F.when(F.size("spans") > 0, redacted(text, F.col("spans"), mark)).otherwise(text)
    return scan_secrets(rows, at[text_col]).select(*[(done if c == text_col else F.col(i)).alias(c) for c, i in at.items()])
