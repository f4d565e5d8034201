"""Findings: one row for each rule that is broken, (target, rule, key, column, expected, actual)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .members import PART, text_parts

COLUMNS = ["target", "rule", "key", "column", "expected", "actual"]


def finding(df: DataFrame, target: Column, rule: str | Column, key: Column, column: str | Column | None = None, expected: Column | None = None, actual: Column | None = None) -> DataFrame:
    text = lambda c: F.lit(c).cast("string") if c is None or isinstance(c, str) else c.cast("string")
    return df.select(*[text(c).alias(n) for c, n in zip((target, rule, key, column, expected, actual), COLUMNS, strict=True)])


def row_findings(df: DataFrame, target: Column, key: Column, checks: list[tuple[str, Column, str | None, Column | None, Column | None]]) -> DataFrame:
    """A finding for each check (rule, where it is broken, column, expected, actual) that a row breaks; all in one pass over df."""
    text = lambda c: F.lit(c).cast("string") if c is None or isinstance(c, str) else c.cast("string")
    items = [F.when(where, F.struct(F.lit(rule).alias("rule"), text(column).alias("column"), text(expected).alias("expected"), text(actual).alias("actual"))) for rule, where, column, expected, actual in checks]
    return df.select(target.cast("string").alias("target"), key.cast("string").alias("key"), F.explode(F.array_compact(F.array(*items))).alias("f")).select("target", "f.rule", "key", "f.column", "f.expected", "f.actual")


def summarise_findings(findings: DataFrame, targets: DataFrame, target: str = "target") -> DataFrame:
    """(target, status, n_findings, rules): one row for each target, verified when nothing was found."""
    found = findings.groupBy("target").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("rule")).alias("rules"))
    joined = targets.select(F.col(target).cast("string").alias("target")).distinct().join(found, "target", "left")
    return joined.select("target", F.when(F.col("n").isNull(), "verified").otherwise("failed").alias("status"), F.coalesce("n", F.lit(0)).alias("n_findings"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


def finding_line() -> Column:
    """A finding as a line of a detailed report."""
    change = F.when(F.col("column").isNotNull(), F.concat(F.lit(": "), F.coalesce("expected", F.lit("-")), F.lit(" -> "), F.coalesce("actual", F.lit("-")))).otherwise("")
    return F.concat(F.lit("  "), F.concat_ws(" ", "rule", "key", "column"), change)


def report_head() -> Column:
    return F.concat(F.lit("Target: "), F.col("target"), F.lit("\nStatus: "), F.upper("status"), F.lit("\nFindings: "), F.col("n_findings").cast("string"))


def report_parts(summary: DataFrame, findings: DataFrame, most: int = PART) -> DataFrame:
    """(target, part, value): detailed reports in parts, for targets with any number of findings. Part 0 is the head, the
    others are `most` lines each; a target's parts in order, joined by line feeds, are what report() says of it."""
    lines = text_parts(findings.withColumn("line", finding_line()), ["target"], ["rule", "key", "column", "line"], "line", "\n", most)
    body = lines.join(summary.select("target"), "target", "left_semi").select("target", "part", F.col("text").alias("value"))
    return summary.select("target", F.lit(0).cast("long").alias("part"), report_head().alias("value")).unionByName(body)


def report(summary: DataFrame, fmt: str = "text", findings: DataFrame | None = None) -> DataFrame:
    """One report for each target of a summary: a line of text or JSON; with findings a detailed text, a line for each finding in order of rule and key."""
    if findings is not None:
        details = findings.groupBy("target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rule", "key", "column", finding_line().alias("line")))), lambda x: x["line"]), "\n").alias("_lines"))
        return summary.join(details, "target", "left").select("target", F.concat_ws("\n", report_head(), "_lines").alias("value"))
    if fmt == "json":
        return summary.select(F.to_json(F.struct("target", "status", "n_findings", "rules")).alias("value"))
    rules = F.when(F.size("rules") > 0, F.concat(F.lit(": "), F.array_join("rules", ", "))).otherwise("")
    return summary.select(F.concat(F.upper("status"), F.lit(" "), F.col("target"), rules).alias("value"))
