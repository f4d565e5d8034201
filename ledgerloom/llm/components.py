"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star round over edges (u, v) with u > v: neighbours are hung below the least node next to theirs."""
    seen = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = (seen if small else seen.filter(F.col("v") > F.col("u"))).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) of type long: root is the least node that can be reached.

    Edges have no direction; repeated ones and loops do no harm, and nodes that only have loops are not returned.
    Every round is written to the shared folder; rounds end when the edge set stays the same, as stars.
    """
    both = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, before = written(both.distinct(), "edges"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark["n"] == 0 or mark == before:
            break
        before = mark
        now = written(_star(_star(now, small=False), small=True), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
