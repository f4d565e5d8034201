"""Members of groups in their order, a row each: groups may be of any size, none is gathered in one row or one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import tasks, written

# Items to a part of a long text.
PART = 10_000


def ordinals(df: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """df with the place of each row in order, from 1, within its group; nulls are a group, and come first in an order.

    Rows are put in ranges of (group, order) and numbered within a range, so a hot group is spread over as many tasks as
    it fills. At most one group of a range began in an earlier one: how many of its rows lie before is one number a range,
    which is broadcast. Rows that tie get neighbouring places in no fixed order. A column called `name` is replaced.
    """
    keys, at = [f"_b{i}" for i in range(len(by))], [f"_o{i}" for i in range(len(order))]
    rows = df.select(F.struct(*df.columns).alias("_row"), *[F.col(c).alias(k) for c, k in zip([*by, *order], [*keys, *at], strict=True)])
    # Written, so that numbers and sizes see the same ranges.
    ranged = written(rows.repartitionByRange(tasks(df.sparkSession), *keys, *at).withColumn("_range", F.spark_partition_id()), "ordinals")
    placed = ranged.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*at)))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_size")).filter("_before > 0")
    before = before.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_range").alias("_range_"), "_before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in [*keys, "_range"]])
    joined = placed.join(F.broadcast(before), same, "left")
    return joined.select(*[F.col("_row")[c].alias(c) for c in df.columns if c != name], (F.coalesce("_before", F.lit(0)) + F.col("_n")).cast("long").alias(name))


def member_rows(df: DataFrame, by: list[str], seq: str, member: str) -> DataFrame:
    """(by, ordinal, member): the members of each group by (sequence, member), a row each."""
    return ordinals(df.select(*dict.fromkeys([*by, seq, member])), by, [seq, member]).select(*by, "ordinal", member)


def text_parts(df: DataFrame, by: list[str], order: list[str], item: str, separator: str = ",", most: int = PART) -> DataFrame:
    """(by, part, n, text): the items of each group joined in order, `most` of them to a part, parts from 1.

    The parts of a group in order, joined by the separator, are its whole text. Null items are left out.
    """
    placed = ordinals(df.filter(F.col(item).isNotNull()), by, order, "_place")
    part = F.call_function("div", F.col("_place") - 1, F.lit(most)) + 1
    items = F.sort_array(F.collect_list(F.struct("_place", F.col(item).cast("string").alias("_item"))))
    return placed.groupBy(*by, part.alias("part")).agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x["_item"]), separator).alias("text"))
