"""Joins of a catalogue: membership, content matches, differences, as-of and interval joins, graph closure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import tasks, written
from .findings import COLUMNS, finding, row_findings
from .sweeps import asof_join, valid_at  # noqa: F401


def same_keys(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def known(df: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is in the dimension."""
    return df.join(dimension.select(*on).distinct(), on, "left_semi")


def unknown(df: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is not in the dimension; rows with null keys are unknown."""
    return df.join(dimension.select(*on), on, "left_anti")


def members_with_keys(operators: DataFrame, memberships: DataFrame, keys: DataFrame) -> DataFrame:
    """Operators with their membership and active key."""
    return operators.join(memberships, "operator_id").join(keys.filter("state = 'active'").drop("state"), "operator_id")


def with_active_key(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Events with the signing fingerprint of their actor's active key, null where there is none."""
    active = keys.filter("state = 'active'").select(F.col("operator_id").alias("actor_id"), "signing_fingerprint")
    return events.join(active, "actor_id", "left")


def active_key(keys: DataFrame, operators: DataFrame | None = None) -> DataFrame:
    """The active keys (operator_id, signing_fingerprint, ...), of the operators asked for if these are given."""
    held = keys.filter("state = 'active'")
    return held if operators is None else held.join(operators.select("operator_id").distinct(), "operator_id", "left_semi")


def file_note(files: DataFrame, revisions: DataFrame) -> DataFrame:
    """files with note_id, the note that a file is a revision of (the least one if several name it); null for other files."""
    return files.join(revisions.groupBy("file_id").agg(F.min("note_id").alias("note_id")), "file_id", "left")


def cross_scope_subject(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Findings for notes on unknown files, and for notes of a case on a file of another case. A file without a case suits every note."""
    held = files.select(F.col("file_id").alias("subject_file_id"), F.col("case_id").alias("_case"), F.lit(True).alias("_known"))
    asked = notes.filter("subject_file_id is not null").join(held, "subject_file_id", "left")
    return row_findings(asked, F.lit("notes"), F.col("note_id"), [
        ("unknown-subject", F.col("_known").isNull(), "subject_file_id", None, F.col("subject_file_id")),
        ("other-case", F.col("_case") != F.col("case_id"), "case_id", F.col("_case"), F.col("case_id")),
    ])


def match_content(probe: DataFrame, files: DataFrame, members: DataFrame | None = None, on: tuple[str, str] = ("content_digest", "size_bytes"), probe_id: str = "probe_id", file_id: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(probe_id, on, n_files, matched): how many files have the digest and size of each probe; and (on, file_id,
    artefact_id): the files of each content that a probe has, once, a row for each artefact that holds them.

    All pairs of probes and equal files are these two joined on the content; neither is as long as the pairs are.
    """
    held = files.groupBy(*on).agg(F.count("*").alias("n_files"))
    found = probe.select(probe_id, *on).join(held, list(on), "left").select(probe_id, *on, F.coalesce("n_files", F.lit(0)).alias("n_files"), F.col("n_files").isNotNull().alias("matched"))
    rows = files.select(*on, file_id).join(probe.select(*on).distinct(), list(on), "left_semi")
    return found, rows.join(members.select(file_id, "artefact_id"), file_id, "left") if members is not None else rows.withColumn("artefact_id", F.lit(None).cast("string"))


def first_envelope(probe: DataFrame, completions: DataFrame, digest: str = "output_digest", seq: str = "event_sequence", export: str = "export_id") -> DataFrame:
    """Probes with the first export that recorded their digest."""
    first = completions.groupBy(digest).agg(F.min_by(export, F.struct(seq, export)).alias(export))
    return probe.join(first, digest, "left")


def missing_payloads(files: DataFrame, payloads: DataFrame, allowed: DataFrame, path: str = "storage_path") -> DataFrame:
    """Files without a payload that are not on the list of those allowed to miss."""
    return files.join(payloads.select(path), path, "left_anti").join(allowed.select(path), path, "left_anti")


# What stands for null in a key of a type, beside a mark that it is null.
FILLED = {"string": "", "int": 0, "bigint": 0}


def meeting(a: DataFrame, b: DataFrame, left: list[str], right: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """a and b dealt by their keys, nulls and all, over the tasks of a large shuffle, and the rule by which they join there.

    The rule is what Spark makes of null-safe equality, in the words that the rows are dealt by. Keys of other types than
    those in FILLED, of different types, or that only one side may lack are left to Spark.
    """
    ours, theirs, n = [], [], tasks(a.sparkSession)
    for x, y in zip(left, right, strict=True):
        kind, (p, q) = dict(a.dtypes)[x], (a.schema[x], b.schema[y])
        if kind != dict(b.dtypes)[y] or kind not in FILLED or p.nullable != q.nullable:
            return a, b, same_keys(left, right)
        for name, parts in ((x, ours), (y, theirs)):
            parts += [F.coalesce(name, F.lit(FILLED[kind]).cast(kind)), F.col(name).isNull()] if p.nullable else [F.col(name)]
    return a.repartition(n, *ours), b.repartition(n, *theirs), reduce(lambda x, y: x & y, [x == y for x, y in zip(ours, theirs, strict=True)])


def diff(expected: DataFrame, live: DataFrame, keys: list[str], columns: list[str], target: str) -> DataFrame:
    """Findings for rows that are missing, extra or changed, with a row for each changed column; nulls are equal."""
    a = expected.select(*[F.col(k).alias(f"_a_{k}") for k in keys], *[F.col(c).alias(f"_x_{c}") for c in columns], F.lit(1).alias("_a"))
    b = live.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(c).alias(f"_y_{c}") for c in columns], F.lit(1).alias("_b"))
    a, b, same = meeting(a, b, [f"_a_{k}" for k in keys], [f"_b_{k}" for k in keys])
    both = a.join(b, same, "full_outer")
    text = lambda c: F.col(c).cast("string") if dict(both.dtypes)[c][:5] not in ("array", "struc", "map<s") else F.to_json(c)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), text(f"_x_{c}").alias("expected"), text(f"_y_{c}").alias("actual"), F.col(f"_x_{c}").eqNullSafe(F.col(f"_y_{c}")).alias("same")) for c in columns])
    changed = F.transform(F.filter(rows, lambda x: ~x["same"]), lambda x: F.struct(x["column"].alias("column"), x["expected"].alias("expected"), x["actual"].alias("actual")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual")))
    rule = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("changed")
    key = F.concat_ws("/", *[F.coalesce(F.col(f"_a_{k}"), F.col(f"_b_{k}")).cast("string") for k in keys])
    found = both.select(F.lit(target).alias("target"), rule.alias("rule"), key.alias("key"), F.explode(F.when(F.col("_a").isNull() | F.col("_b").isNull(), whole).otherwise(changed)).alias("f"))
    return found.select("target", "rule", "key", "f.column", "f.expected", "f.actual").select(*COLUMNS)


def set_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def resolve_endpoints(edges: DataFrame, files: DataFrame, path: str = "logical_path", file_id: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """Edges by path as edges by file id, and findings for ends that are no files."""
    by_path = files.select(F.col(path).alias("_path"), F.col(file_id).alias("_id"))
    parent, child = (by_path.select(F.col("_path").alias(f"_{n}_path"), F.col("_id").alias(f"{n}_file_id")) for n in ("parent", "child"))
    ends = edges.join(parent, F.col("parent_path") == F.col("_parent_path"), "left").join(child, F.col("child_path") == F.col("_child_path"), "left").drop("_parent_path", "_child_path")
    found = [finding(ends.filter(F.col(f"{n}_file_id").isNull()), F.lit("relationships"), f"unknown-{n}", F.col(f"{n}_path")) for n in ("parent", "child")]
    return ends, found[0].unionByName(found[1])


def intervals(changes: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Changes with valid_from and valid_until: each holds from its sequence until the next of its group."""
    return changes.withColumns({"valid_from": F.col(seq), "valid_until": F.lead(seq).over(Window.partitionBy(*by).orderBy(seq))})


def contracted(links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_from, _to, _steps) between the nodes of links (_from, _to) that matter, and the others as (_node, _head, _offset).

    Nodes that no link leaves are left to the end: they are `_offset` 1 below each node that leads to them. Of what
    remains, nodes with one link in and one out that are no roots lie on chains: each is `_offset` below the chain's
    head, found by jumping twice as far in each round. Links to what comes after a chain start at its head.
    """
    roots = roots.select(F.col("node").alias("_node")).distinct()
    inner = links.select(F.col("_from").alias("_node")).distinct()
    spine = written(links.join(inner.select(F.col("_node").alias("_to")), "_to", "left_semi").select("_from", "_to"), "spine")
    leaves = links.join(inner.select(F.col("_node").alias("_to")), "_to", "left_anti").select(F.col("_to").alias("_node"), F.col("_from").alias("_head"), F.lit(1).alias("_offset"))
    ins = spine.groupBy(F.col("_to").alias("_node")).agg(F.count("*").alias("_in"), F.min("_from").alias("_head"))
    outs = spine.groupBy(F.col("_from").alias("_node")).agg(F.count("*").alias("_out"))
    jumps = ins.join(outs, "_node").filter("_in = 1 and _out = 1").join(roots, "_node", "left_anti")
    jumps = written(jumps.select("_node", "_head", F.lit(1).alias("_offset")), "chains")
    for _ in range(max(1, jumps.count()).bit_length()):
        on = jumps.select(F.col("_node").alias("_head"), F.col("_head").alias("_next"), F.col("_offset").alias("_more"))
        if jumps.join(on, "_head", "left_semi").isEmpty():
            break
        longer = jumps.join(on, "_head", "left")
        jumps = written(longer.select("_node", F.coalesce("_next", "_head").alias("_head"), (F.col("_offset") + F.coalesce("_more", F.lit(0))).alias("_offset")), "chains")
    # What still points into a chain goes round in a circle that no root leads to.
    jumps = written(jumps.join(jumps.select(F.col("_node").alias("_head")), "_head", "left_anti"), "chains")
    start = jumps.select(F.col("_node").alias("_from"), "_head", "_offset")
    edges = spine.join(jumps.select(F.col("_node").alias("_to")), "_to", "left_anti").join(start, "_from", "left")
    edges = edges.select(F.coalesce("_head", "_from").alias("_from"), "_to", (F.coalesce("_offset", F.lit(0)) + 1).alias("_steps"))
    held = leaves.join(start.withColumnRenamed("_from", "_at").withColumnsRenamed({"_head": "_top", "_offset": "_down"}), F.col("_head") == F.col("_at"), "left")
    leaves = held.select("_node", F.coalesce("_top", "_head").alias("_head"), (F.col("_offset") + F.coalesce("_down", F.lit(0))).alias("_offset"))
    return edges.groupBy("_from", "_to").agg(F.min("_steps").alias("_steps")), jumps.unionByName(leaves)


def descendants(edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child", root: str = "root", max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): every node that can be reached from each root, with its least depth; cycles end.

    Chains are contracted first and leaves left out, so the rounds of the search are not as many as the graph is deep but
    as there are branches on the way: a chain takes as many as its length has binary digits. Each round is written to
    the shared folder, and plans stay short.
    """
    links = edges.select(F.col(parent).alias("_from"), F.col(child).alias("_to")).filter("_from is not null and _to is not null and _from <> _to").distinct()
    links = written(links, "links")
    own = roots.filter(F.col(root).isNotNull()).select(F.col(root), F.col(root).alias("node"), F.lit(0).alias("depth")).distinct()
    reached = written(own, "reached")
    hops, below = contracted(links, reached)
    hops, below = written(hops, "hops"), written(below, "below")
    frontier = reached
    within = F.lit(True) if max_depth is None else F.col("depth") <= max_depth
    while True:
        step = frontier.join(hops, F.col("node") == F.col("_from")).select(root, F.col("_to").alias("node"), (F.col("depth") + F.col("_steps")).alias("depth")).filter(within)
        nearest = step.groupBy(root, "node").agg(F.min("depth").alias("depth"))
        before = reached.select(root, "node", F.col("depth").alias("_depth"))
        frontier = written(nearest.join(before, [root, "node"], "left").filter("_depth is null or depth < _depth").drop("_depth"), "frontier")
        if frontier.isEmpty():
            break
        reached = written(reached.unionByName(frontier).groupBy(root, "node").agg(F.min("depth").alias("depth")), "reached")
    deeper = reached.join(below, F.col("node") == F.col("_head")).select(root, F.col("_node").alias("node"), (F.col("depth") + F.col("_offset")).alias("depth")).filter(within)
    nulls = roots.filter(F.col(root).isNull()).select(F.col(root), F.col(root).alias("node"), F.lit(0).alias("depth")).distinct()
    return reached.unionByName(deeper).groupBy(root, "node").agg(F.min("depth").alias("depth")).unionByName(nulls)
