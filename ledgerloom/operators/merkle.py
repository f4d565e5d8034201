"""Trees of digests over tables: equal tables are told by one digest, and a difference is found by going down to it.

A row's place in the tree is the digest of its columns; equal rows are one entry with their number. Entries whose digests
begin with the same hexadecimal digits are a leaf, leaves whose digests share all but their last STEP digits a node, and so
on to the root. A leaf holds at most MOST entries (their number sets how deep the tree is), a node at most 16^STEP others.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written
from .matching import diff, same_keys

STEP = 2
MOST = 4096
# Prefixes up to this number are looked up by value, so that files and row groups without them are not read.
LOOKED_UP = 500


@dataclass(frozen=True)
class Tree:
    """A tree under path: nodes (level, prefix, n, digest), in order of prefixes within a level, and entries (h, times and
    the key columns), in order of h, the first of a leaf with the leaf's n and digest. digits is the length of a leaf's prefix."""

    spark: SparkSession
    path: str
    digits: int

    def nodes(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes/level={level}")

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/entries").select("h", "times", "key")

    def root(self) -> tuple[int, str]:
        """(number of rows, digest) of the whole table; the digest of no rows is that of an empty text."""
        row = self.nodes(0).first()
        return (row["n"], row["digest"]) if row else (0, None)


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def digits_for(n: int, most: int = MOST) -> int:
    """Digits of a leaf's prefix so that of n entries a leaf has a quarter of `most` on average: more than `most` then come by
    no chance that counts."""
    return STEP * math.ceil(max(0.0, math.log(max(n, 1) / (most / 4), 16)) / STEP) if n else 0


def build_tree(df: DataFrame, keys: list[str], name: str = "tree", digits: int | None = None, most: int = MOST) -> Tree:
    """Write the tree of a table. Trees are compared level by level, so two of them need the same digits; by default these
    follow from the number of rows. Nulls, repeated rows and empty tables are as good as any."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    digits = digits_for(df.count(), most) if digits is None else digits
    # Rows are shuffled once, with digests as bytes: a task has whole leaves, so their digests are made where entries are.
    rows = df.select(F.unhex(row_digest(df.columns)).alias("h"), F.struct(*keys).alias("key"))
    dealt = rows.withColumn("leaf", F.substring("h", 1, digits // 2)).repartitionByRange("leaf")
    entries = dealt.groupBy("leaf", "h").agg(F.count("*").alias("times"), F.first("key").alias("key"))
    leaves = entries.groupBy("leaf").agg(F.sum("times").alias("n"), F.sort_array(F.collect_list(F.struct("h", "times", "key"))).alias("own"))
    each = F.transform("own", lambda e: F.concat_ws(":", F.lower(F.hex(e["h"])), e["times"].cast("string")))
    rows = leaves.sortWithinPartitions("leaf").select("n", F.sha2(F.array_join(each, ","), 256).alias("digest"), F.posexplode("own").alias("at", "e"))
    first = F.col("at") == 0
    rows = rows.select(F.lower(F.hex("e.h")).alias("h"), "e.times", "e.key", F.when(first, F.col("n")).alias("n"), F.when(first, F.col("digest")).alias("digest"))
    rows.write.option("compression", "zstd").parquet(f"{path}/entries")
    below = spark.read.parquet(f"{path}/entries").filter("digest is not null").select(F.substring("h", 1, digits).alias("prefix"), "n", "digest")
    for level in range(digits, -1, -STEP):
        if level < digits:
            child = F.concat_ws(":", "prefix", "digest")
            below = spark.read.parquet(f"{path}/nodes/level={level + STEP}").groupBy(F.substring("prefix", 1, level).alias("prefix"))
            below = below.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(child)), ","), 256).alias("digest"))
        below.repartitionByRange("prefix").sortWithinPartitions("prefix").write.parquet(f"{path}/nodes/level={level}")
    return Tree(spark, path, digits)


def below(df: DataFrame, column: str, prefixes: DataFrame, length: int) -> DataFrame:
    """Rows of df whose column begins with one of the prefixes, all of one length."""
    few = [r["prefix"] for r in prefixes.limit(LOOKED_UP + 1).collect()]
    if len(few) > LOOKED_UP:
        return df.join(prefixes.select(F.col("prefix").alias("_p")), F.substring(column, 1, length) == F.col("_p"), "left_semi")
    rule = F.lit(False)
    for p in few:
        rule = rule | F.col(column).startswith(p)
    return df.filter(rule)


def changed_leaves(a: Tree, b: Tree) -> DataFrame:
    """(prefix): the leaves that differ. Of each level only nodes below differing ones are read and compared."""
    if a.digits != b.digits:
        raise ValueError("trees of different depth: build one with the digits of the other")
    differ = a.spark.createDataFrame([("",)], "prefix string")
    for level in range(0, a.digits + 1, STEP):
        own = [below(t.nodes(level), "prefix", differ, max(level - STEP, 0)).select("prefix", "digest", F.lit(s).alias("side")) for s, t in enumerate((a, b))]
        sides = own[0].unionByName(own[1]).groupBy("prefix").agg(F.count("*").alias("n"), F.min("digest").alias("x"), F.max("digest").alias("y"))
        differ = written(sides.filter("n = 1 or x <> y").select("prefix"), "changed-nodes")
        if differ.isEmpty():
            break
    return differ


def changed_keys(a: Tree, b: Tree) -> DataFrame:
    """(key): the keys of the rows that one table has more often than the other, from the leaves that differ alone."""
    leaves = changed_leaves(a, b)
    held = [below(t.entries(), "h", leaves, t.digits).select(F.unhex("h").alias("h"), "key", (F.col("times") * sign).alias("times")) for t, sign in ((a, 1), (b, -1))]
    return held[0].unionByName(held[1]).groupBy("h", "key").agg(F.sum("times").alias("times")).filter("times <> 0").select("key").distinct()


def tree_diff(expected: DataFrame, live: DataFrame, keys: list[str], columns: list[str], target: str, digits: int | None = None) -> DataFrame:
    """As matching.diff over the same columns: findings for rows that are missing, extra or changed. Both tables are read
    and hashed once; only rows of leaves that differ are joined with each other."""
    both = [df.select(*keys, *columns) for df in (expected, live)]
    a = build_tree(both[0], keys, "expected-tree", digits)
    return tree_findings(both[0], both[1], a, build_tree(both[1], keys, "live-tree", a.digits), keys, columns, target)


def tree_findings(expected: DataFrame, live: DataFrame, a: Tree, b: Tree, keys: list[str], columns: list[str], target: str) -> DataFrame:
    """tree_diff of tables whose trees are there already, such as that of a snapshot."""
    found = written(changed_keys(a, b).select(*[F.col(f"key.{k}").alias(f"_k_{k}") for k in keys]), "changed-keys")
    some = [df.join(found, same_keys(keys, [f"_k_{k}" for k in keys]), "left_semi") for df in (expected, live)]
    return diff(some[0], some[1], keys, columns, target)
