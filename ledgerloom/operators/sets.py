"""Aggregates, windows and set operations over ledgers and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_id
from ..sources.shared import written
from .findings import finding
from .members import ordinals


def ordered_members(df: DataFrame, group: str, seq: str, member: str, name: str = "members") -> DataFrame:
    """(group, members): the members of each group by (sequence, id)."""
    items = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(member).alias("m"))))
    return df.groupBy(group).agg(F.transform(items, lambda x: x["m"]).alias(name))


def concat_members(df: DataFrame, group: str, member: str, separator: str = ",", name: str = "members") -> DataFrame:
    return df.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(F.col(member).cast("string"))), separator).alias(name))


def counter_check(ids: DataFrame, counters: DataFrame) -> DataFrame:
    """(namespace, expected, actual) where a counter is not the largest number of its namespace plus one."""
    top = ids.groupBy("namespace").agg((F.max("sequence") + 1).alias("expected"))
    joined = top.join(counters.select("namespace", F.col("next_value").alias("actual")), "namespace", "full_outer")
    return joined.filter(~F.coalesce("expected", F.lit(1)).eqNullSafe(F.col("actual")))


def duplicates(df: DataFrame, keys: list[str], name: str = "n_rows") -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).filter(F.col(name) > 1)


def exactly_one(df: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, n) for targets that do not have exactly one row."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return targets.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 1")


def count_check(log: DataFrame, table: DataFrame) -> DataFrame:
    """One row: how many rows the log and the table have, and whether that is the same."""
    a, b = log.agg(F.count("*").alias("log_rows")), table.agg(F.count("*").alias("table_rows"))
    return a.withColumn("_", F.lit(1)).join(b.withColumn("_", F.lit(1)), "_").select("log_rows", "table_rows", (F.col("log_rows") == F.col("table_rows")).alias("same"))


def latest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the greatest sequence for each key; all columns are kept, and ties go to the greatest row."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq, *[c for c in rest if c != seq])).alias("_row")).select(*keys, "_row.*")


def state_breaks(df: DataFrame, keys: list[str], seq: str, before: str = "from_state", after: str = "to_state") -> DataFrame:
    """Transitions whose from-state is not the to-state of the transition before, as `held`."""
    order = Window.partitionBy(*keys).orderBy(seq)
    rows = df.withColumns({"held": F.lag(after).over(order), "_n": F.row_number().over(order)})
    return rows.filter((F.col("_n") > 1) & ~F.col("held").eqNullSafe(F.col(before))).drop("_n")


def revision_check(revisions: DataFrame, notes: DataFrame, note: str = "note_id", revision: str = "revision", latest_col: str = "latest_revision") -> DataFrame:
    """Findings for notes whose revisions are not 1, 2, 3 and so on, or whose latest pointer is wrong."""
    found = revisions.groupBy(note).agg(F.min(revision).alias("_min"), F.max(revision).alias("_max"), F.count("*").alias("_n"), F.countDistinct(revision).alias("_d"))
    gaps = finding(found.filter("_min <> 1 or _max <> _n or _d <> _n"), F.lit("notes"), "revision-gap", F.col(note), revision, F.col("_n"), F.col("_max"))
    joined = notes.join(found, note, "left").filter(~F.col(latest_col).cast("long").eqNullSafe(F.col("_max").cast("long")))
    return gaps.unionByName(finding(joined, F.lit("notes"), "latest-pointer", F.col(note), latest_col, F.col("_max"), F.col(latest_col)))


def ordinal_refs(df: DataFrame, group: list[str], order: list[str], prefix: str, name: str = "ref") -> DataFrame:
    """df with PREFIX-000001 and so on in order, within each group; a hot group is numbered in many tasks."""
    return ordinals(df, group, order, name).withColumn(name, format_id(prefix, F.col(name)))


def assign_ids(batch: DataFrame, counters: DataFrame, namespace: str, order: list[str], width: int = 6) -> DataFrame:
    """batch with number and identifier, going on after each namespace's counter (namespace, prefix, next_value).

    In two passes: rows are put in ranges of their order and numbered within them; the ranges' sizes, one number for
    each task and namespace, give the offsets. So one namespace may be as large as the whole batch.
    """
    # Written, so that both uses see the same ranges and the same order of ties.
    ranged = written(batch.repartitionByRange(namespace, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("_n", F.row_number().over(Window.partitionBy(namespace, "_part").orderBy(*order)))
    sizes = within.groupBy(namespace, "_part").agg(F.max("_n").alias("_size"))
    before = sizes.select(namespace, "_part", (F.sum("_size").over(Window.partitionBy(namespace).orderBy("_part")) - F.col("_size")).alias("_before"))
    joined = within.join(before, [namespace, "_part"]).join(counters.select(F.col("namespace").alias(namespace), "prefix", "next_value"), namespace, "left")
    number = F.coalesce("next_value", F.lit(1)) - 1 + F.col("_before") + F.col("_n")
    numbered = joined.withColumn("number", number.cast("long"))
    return numbered.withColumn("identifier", F.concat(F.coalesce("prefix", F.upper(namespace)), F.format_string(f"-%0{width}d", "number"))).drop("_part", "_n", "_before", "prefix", "next_value")


def first_match(df: DataFrame, group: str, order: list[str], condition: Column, columns: list[str]) -> DataFrame:
    """The first row of each group, in order, for which the condition holds."""
    return df.filter(condition).groupBy(group).agg(F.min_by(F.struct(*columns), F.struct(*order, *columns)).alias("_row")).select(group, "_row.*")


def distinct_in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *rest)).alias("_row")).select(*keys, "_row.*").select(df.columns) if rest else df.distinct()


def payload_types(df: DataFrame, content: str = "content") -> DataFrame:
    """(media_type, n_payloads, n_bytes) over the first bytes of payloads."""
    from ..functions.text import media_type

    return df.select(media_type(content).alias("media_type"), F.octet_length(content).alias("_n")).groupBy("media_type").agg(F.count("*").alias("n_payloads"), F.sum("_n").cast("long").alias("n_bytes"))


def payload_summary(checked: DataFrame, by: str = "project_id", path: str = "storage_path") -> DataFrame:
    """(by, n_hashed, n_writable): how many payloads were hashed and how many of them may be written to; list them with writable_payloads."""
    return checked.groupBy(by).agg(F.count("content_digest").alias("n_hashed"), F.count(F.when(F.col("writable"), F.col(path))).alias("n_writable"))


def writable_payloads(checked: DataFrame, by: str = "project_id", path: str = "storage_path") -> DataFrame:
    """(by, path) of payloads that may be written to, a row each."""
    return checked.filter("writable").select(by, path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def order_by_sequence(df: DataFrame, seq: str, key: str) -> DataFrame:
    return df.orderBy(seq, key)


def order_by_path(df: DataFrame, path: str, by_parts: bool = False) -> DataFrame:
    """By path as text, or part by part as a tree is walked."""
    return df.orderBy(F.split(path, "/") if by_parts else F.col(path))
