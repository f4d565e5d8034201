"""Quality rules: word and line counts, and compression bands for repetitive or incompressible text."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
LEVEL = 3
CHUNK = 4096
# Fixed values: (bytes, least ratio, greatest ratio) of compressed to raw bytes, for texts of up to so many bytes.
# Short texts compress less, and a frame's own bytes weigh more in them; hence a band for each length.
BANDS = ((512, 0.30, 0.90), (2048, 0.28, 0.80), (8192, 0.25, 0.72), (32768, 0.22, 0.68), (1 << 62, 0.18, 0.66))
CHUNK_BAND = (0.25, 0.74)

SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, zstd_ratio double, n_chunks bigint, n_chunks_out bigint"


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in windows of three words that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(reach, i)
            reach = i + 3
    return total


def ratio(data: bytes, compressor: zstandard.ZstdCompressor) -> float:
    return len(compressor.compress(data)) / len(data)


def band(n_bytes: int) -> tuple[float, float]:
    """The limits for a text of so many bytes."""
    return next((low, high) for most, low, high in BANDS if n_bytes <= most)


def chunks_of(data: bytes) -> list[bytes]:
    """Chunks of CHUNK bytes that cover all of data: the last one ends with it and reaches back into the one before. Shorter data is one chunk."""
    if len(data) <= CHUNK:
        return [data] if data else []
    return [data[i : i + CHUNK] for i in (*range(0, len(data) - CHUNK, CHUNK), len(data) - CHUNK)]


def measure(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    joined = b"".join(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    whole = ratio(data, compressor) if data else None
    chunks = [(CHUNK_BAND if len(c) == CHUNK else band(len(c)), ratio(c, compressor) if len(data) > CHUNK else whole) for c in chunks_of(data)]
    out = sum(not low <= r <= high for (low, high), r in chunks)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), whole, len(chunks), out


def in_band(n_bytes, value):
    """Column: whether a ratio is within the limits for a text's length."""
    low, high = F.lit(None), F.lit(None)
    for most, a, b in reversed(BANDS):
        low, high = F.when(n_bytes <= most, a).otherwise(low), F.when(n_bytes <= most, b).otherwise(high)
    return value.between(low, high)


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the measures of SCHEMA, base_failed and kept; columns of these names are replaced.

    base_failed: fewer than min_words words, or more than half of the words in windows of three that occur again.
    kept: not base_failed, and the compression of the whole text lies in the band for its length, and at most half
    of its chunks lie outside the band for theirs. Chunks have CHUNK bytes and cover the whole text; a shorter text is one
    chunk, with the band for its length. A null text counts as empty: it has no words,
    its ratio is null and it is not kept. Rows are judged one by one, however often they are repeated.
    """

    @F.pandas_udf(SCHEMA)
    def measures(text: pd.Series) -> pd.DataFrame:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        out = pd.DataFrame([measure(t, compressor) for t in text], columns=names)
        return out.astype({"zstd_ratio": "float64"})

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    own = free_name(docs, "_measures")
    found = docs.withColumn(own, measures(text_col))
    found = found.withColumns({x: F.col(f"{own}.{x}") for x in names}).drop(own)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = in_band(F.octet_length(text_col), F.col("zstd_ratio")) & (2 * F.col("n_chunks_out") <= F.col("n_chunks"))
    return found.withColumns({"base_failed": failed}).withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False)))
