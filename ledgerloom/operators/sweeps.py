"""Joins along a sequence: the last row before each, and the ranges that hold at each, also for keys of any size.

Rows of a key are cut into slices of `width` sequence numbers, so a hot key is spread over as many tasks as it has slices.
What a slice must know of those before it comes from a small table: one row for each key and slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import dealt

# Sequence numbers to a slice, where the sequence is dense in its key, as in a ledger.
SLICE = 1 << 16
# Pairs of events and ranges that are put out at once.
PAIRS = 100_000


def slice_of(seq: str | Column, width: int | None) -> Column:
    """The slice of a sequence number; one slice for all without a width. It grows with the number."""
    column = F.col(seq) if isinstance(seq, str) else seq
    return F.lit(0).cast("long") if width is None else F.call_function("div", column.cast("long"), F.lit(width).cast("long"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_seq: str, right_seq: str, columns: list[str], width: int | None = None) -> DataFrame:
    """left with columns of the last row of right at or before its sequence in the same group; null where there is none.

    Both sides are laid in one order and the last values are carried on, so nothing is multiplied. With a width the order
    is that of a slice of a group: the last row of right in each slice is carried to later slices by a window over slices.
    Groups are null-safe; rows of right without a sequence are left out.
    """
    right_row = F.struct(*[F.col(c).alias(c) for c in columns])
    right = right.filter(F.col(right_seq).isNotNull())
    held_type = right.select(right_row.alias("x")).schema["x"].dataType
    a = left.select(*by, slice_of(left_seq, width).alias("_slice"), F.col(left_seq).alias("_seq"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(held_type).alias("_held"))
    b = right.select(*by, slice_of(right_seq, width).alias("_slice"), F.col(right_seq).alias("_seq"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), right_row.alias("_held"))
    order = Window.partitionBy(*by, "_slice").orderBy("_seq", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_held", ignorenulls=True)
    if width is None:
        carried = a.unionByName(b).withColumn("_last", last.over(order))
    else:
        ends = b.groupBy(*by, "_slice").agg(F.max_by("_held", "_seq").alias("_held")).withColumn("_side", F.lit(1))
        asked = a.select(*by, "_slice").distinct().withColumns({"_held": F.lit(None).cast(held_type), "_side": F.lit(0)})
        slices = Window.partitionBy(*by).orderBy("_slice", "_side").rowsBetween(Window.unboundedPreceding, 0)
        before = asked.unionByName(ends).withColumn("_before", last.over(slices)).filter("_side = 0 and _before is not null")
        before = before.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate([*by, "_slice"])], "_before")
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate([*by, "_slice"])])
        carried = a.unionByName(b).join(before, same, "left").withColumn("_last", F.coalesce(last.over(order), F.col("_before")))
    return carried.filter("_side = 1").select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in columns])


def sliced_ranges(events: DataFrame, ranges: DataFrame, by: list[str], width: int) -> DataFrame:
    """ranges (by, _start, _end, ...) once for each slice that they reach into and that has events (by, _at)."""
    asked = events.select(*by, slice_of("_at", width).alias("_slice")).distinct()
    most = asked.groupBy(*by).agg(F.max("_slice").alias("_most"))
    reach = F.least(F.coalesce(slice_of("_end", width), F.col("_most")), F.col("_most"))
    first = slice_of("_start", width)
    each = ranges.join(most, by).filter(first <= F.col("_most")).withColumn("_slice", F.explode(F.sequence(first, reach))).drop("_most")
    return each.join(asked, [*by, "_slice"], "left_semi")


def valid_at(events: DataFrame, ranges: DataFrame, by: list[str], seq: str, start: str = "valid_from", end: str = "valid_until", width: int | None = None) -> DataFrame:
    """Events joined to the ranges [start, end) of their group that hold at their sequence; an open end is null.

    One sweep over starts, ends and events in order, with the set of open ranges as only state: events and ranges of a
    group are never paired but where they belong together. With a width, slices of a group are swept side by side, and a
    range comes once into each slice that it reaches into. Null keys, sequences and starts join nothing.
    """
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in by])
    kind = events.schema[seq].dataType
    more = [c for c in ranges.columns if c not in by]
    e = events.filter(known & F.col(seq).isNotNull()).select(*by, F.col(seq).alias("_at"), F.struct(*events.columns).alias("_event"))
    r = ranges.filter(known & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    r = r.select(*by, F.col(start).cast(kind).alias("_start"), F.col(end).cast(kind).alias("_end"), F.struct(*more).alias("_range"))
    r = sliced_ranges(e, r, by, width) if width is not None else r.withColumn("_slice", slice_of("_start", None))
    e = e.withColumn("_slice", slice_of("_at", width))
    r = r.withColumn("_id", F.monotonically_increasing_id())
    none = lambda c, frame: F.lit(None).cast(frame.schema[c].dataType).alias(c)
    step = lambda at, kind, held: F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), held.alias("_range"))
    steps = F.array_compact(F.array(step(F.col("_start"), 1, F.col("_range")), F.when(F.col("_end").isNotNull(), step(F.col("_end"), 0, none("_range", r)))))
    turns = r.select(*by, "_slice", "_id", F.explode(steps).alias("_s")).select(*by, "_slice", "_s._at", "_s._kind", "_id", none("_event", e), "_s._range")
    asked = e.select(*by, "_slice", "_at", F.lit(2).alias("_kind"), F.lit(None).cast("long").alias("_id"), "_event", none("_range", r))
    names = [f"c{i}" for i in range(len(events.columns) + len(more))]
    fields = [*e.schema["_event"].dataType.fields, *r.schema["_range"].dataType.fields]
    shape = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)])
    keys = [*by, "_slice"]

    def pairs(table: pa.Table, left: list[int], right: list[int]) -> pa.RecordBatch:
        take = lambda c, at: table.column(c).combine_chunks().take(pa.array(at, pa.int64())).flatten()
        return pa.RecordBatch.from_arrays([*take("_event", left), *take("_range", right)], names=names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch])
            n = len(table)
            changes = [pc.not_equal(table.column(c).slice(1), table.column(c).slice(0, n - 1)) for c in keys] if n > 1 else []
            new = [False, *(reduce(pc.or_, changes).to_pylist() if changes else [])]
            kinds, ids = table.column("_kind").to_pylist(), table.column("_id").to_pylist()
            now: dict[int, int] = {}
            left, right = [], []
            for i in range(n):
                if new[i]:
                    now.clear()
                if kinds[i] == 2:
                    left += [i] * len(now)
                    right += now.values()
                    if len(left) >= PAIRS:
                        yield pairs(table, left, right)
                        left, right = [], []
                elif kinds[i]:
                    now[ids[i]] = i
                else:
                    now.pop(ids[i], None)
            if left:
                yield pairs(table, left, right)
            last = table.slice(n - 1)
            held = table.take(pa.array(list(now.values()), pa.int64())) if now else None
            if held is not None and held.slice(len(held) - 1).select(keys) != last.select(keys):
                held = None

    order = [*keys, "_at", "_kind", "_id"]
    return dealt(asked.unionByName(turns), *keys).sortWithinPartitions(*order).mapInArrow(sweep, shape).toDF(*events.columns, *more)
