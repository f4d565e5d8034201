"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written  # noqa: F401

# White space of the word rule: the code points 0x20 and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
# Up to U+024F normal forms, lower case and letter classes are the same in all versions of Unicode.
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """The number of words of a text, as runs of anything but white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class Recent:
    """A bounded cache: when it holds `most` entries it becomes the old part, and what is used again is taken over."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys) -> list:
        """The keys that are not held; the others are in `new` afterwards."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        out, new, old = [], self.new, self.old
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out


def slices(texts: list[str | None], most_chars: int = 2_000_000):
    """Slices of texts of a bounded number of characters, or single long texts."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most_chars:
            yield texts[start:i]
            start, size = i, 0
        size += len(t or "")
    yield texts[start:]


def text_slices(batch: pa.RecordBatch, name: str = "_text", most_bytes: int = 4_000_000) -> Iterator[tuple[int, list]]:
    """(number of the first row, values) of a text or binary column: slices of a bounded number of bytes, or single long values."""
    column = batch.column(name)
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, side="right")))
        yield start, column.slice(start, end - start).to_pylist()
        start = end


def free_name(docs: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., so that none clashes with a helper column, and what each column is called there."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))
