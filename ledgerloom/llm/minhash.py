"""Near duplicates by MinHash: bands give candidates, odd sketches screen them, full shingle sets decide.

An odd sketch is a bitmap of SKETCH bits in which each of a text's minima flips the bit that its position and value name.
Minima that two texts share cancel out in the XOR of their sketches, so its population count z tells how many differ:
the similarity is about 1 + SKETCH / (4 MINIMA) ln(1 - 2 z / SKETCH). Of the pairs that share a band those with a z above
the limit are left out before any text is fetched; the limit is five deviations or more from what a pair at the threshold
has.
How bands are searched, whatever their size, is near_copies'.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, written
from .near_copies import BLOCK, CROWD, MINIMA, band_keys, components_of, least_hashes, mixed, with_rows

# A pair of similarity 0.85 shares no band with a chance of 0.0000007, whatever the size of the corpus.
BANDS, ROWS = 30, 6
# The same for 0.8: a chance of 0.00003.
WIDE = (20, 4)
# The minima that bands leave over go in more bands of five: together a chance of 2 in 10^11 at 0.8.
MORE = {WIDE: (35, 5)}
SKETCH = 512


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """SKETCH bits, packed in 64-bit words: whether an odd number of minima name a bit."""
    x = mixed(least.astype(np.uint64) + (np.arange(len(least), dtype=np.uint64) << np.uint64(32)))
    flips = np.bincount((x >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(flips.astype(bool), bitorder="little").view(np.int64)


def estimated(apart: int) -> float:
    """The similarity of two texts whose odd sketches differ in so many bits."""
    return 1 + SKETCH / (4 * MINIMA) * math.log(max(1 - 2 * apart / SKETCH, 1e-9))


def bits_apart(similarity: float, deviations: int = 5) -> int:
    """At most so many bits differ between the sketches of two texts of this similarity, but for one pair in a million, or,
    at seven deviations, in 10^11."""
    gone = 2 * MINIMA * (1 - similarity)
    left = math.exp(-2 * gone / SKETCH)
    sampled = 2 * left * math.sqrt(MINIMA * similarity * (1 - similarity))
    folded = math.sqrt(SKETCH / 4 * (1 - left * left * (1 + 4 * gone / SKETCH)))
    return math.ceil(SKETCH / 2 * (1 - left) + deviations * math.hypot(sampled, folded))


def with_sketches(rows: DataFrame, size: int, bands: tuple[int, int] = (BANDS, ROWS)) -> DataFrame:
    """rows with n_shingles, _node, _keys and _bits, from _text."""

    used, more = math.prod(bands), MORE.get(bands, (0, 0))

    @F.pandas_udf("_node bigint, n_shingles bigint, _keys array<bigint>, _bits array<bigint>")
    def found(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            name, n, least = least_hashes(t, size)
            keys = band_keys(least, *bands) + band_keys(least[used:], *more, seed=bands[0]) if n else []
            out.append((name, n, keys, odd_sketch(least).tolist()))
        return pd.DataFrame(out, columns=["_node", "n_shingles", "_keys", "_bits"])

    return rows.withColumn("_m", found("_text")).select("*", "_m.*").drop("_m")


def minhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, similarity: float = 0.85, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs.

    n_shingles is the number of distinct shingles of `size` words, with A-Z in lower case; fewer words are one shingle.
    Texts link when their shingle sets have a Jaccard similarity of `similarity` or more, confirmed on the sets
    themselves; component_id is the smallest id that can be reached over links, the row's own included. Null, empty and
    blank texts have no shingles and link with nothing, not even each other: their component is their own id. Equal texts
    link. Rows without an id link like others; a component of them alone has no id. kept: the
    id is the component's. Other columns are dropped. For similarities below 0.85 bands miss more.
    """
    found = written(with_sketches(with_rows(docs.select(id_col, text_col), id_col, text_col).select("_id", "_text", "_row"), size), "sketches", compression="zstd")
    parts = components_of(found.filter("n_shingles > 0"), size, 5 * similarity, bits_apart(similarity), block, crowd)
    rows = found.select("_id", "_node", "n_shingles").join(parts, "_node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("_id")).otherwise(F.col("component_id"))
    return rows.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bands: tuple[int, int] = WIDE, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """docs with one row of each group of near duplicates: one with the smallest id of the group, or one without an id
    where no row has any. Texts link as in minhash_near_duplicates, and rows are judged by their texts, also where several
    have one id; but null, empty and blank texts are equal. All columns stay, whatever their names. With the bands given
    here and those of MORE, 2 in 10^11 pairs at 0.8 share no band, and sketches screen out less than that."""
    rows, at = numbered(docs)
    found = written(with_sketches(with_rows(rows, at[id_col], at[text_col]), size, bands), "sketches", compression="zstd")
    parts = components_of(found, size, 5 * similarity, bits_apart(similarity, 7), block, crowd)
    return found.join(parts.select(F.col("_first").alias("_row")).distinct(), "_row", "left_semi").select(*at.values()).toDF(*at)
