"""Digests and canonical forms of column values."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import dealt

# Digest profiles and their widths in hexadecimal digits.
WIDTHS = {"sha256": 64, "sha512": 128, "sha3-256": 64, "sha3-512": 128, "blake2b-256": 64, "blake2b-512": 128, "blake2s-256": 64, "blake3-256": 64}
NATIVE = {"sha256": 256, "sha512": 512}


def hasher(algorithm: str) -> Callable:
    """A function that starts a digest, as hashlib's do. blake3-256 needs the package blake3."""
    if algorithm not in WIDTHS:
        raise ValueError(f"unknown digest: {algorithm}")
    if algorithm == "blake3-256":
        import blake3

        return blake3.blake3
    if algorithm.startswith("blake2"):
        return functools.partial(getattr(hashlib, algorithm.split("-")[0]), digest_size=WIDTHS[algorithm] // 2)
    return functools.partial(hashlib.new, algorithm.replace("-", "_"))


def digest(value: str | Column, algorithm: str = "sha256") -> Column:
    """The digest of a text or binary column in lower-case hexadecimal digits; null for null.

    SHA-2 stays in the JVM; the other profiles hash Arrow batches.
    """
    if algorithm not in WIDTHS:
        raise ValueError(f"unknown digest: {algorithm}")
    column = F.col(value) if isinstance(value, str) else value
    if algorithm in NATIVE:
        return F.sha2(column.cast("binary"), NATIVE[algorithm])

    @F.pandas_udf(T.StringType())
    def hashed(values: pd.Series) -> pd.Series:
        new = hasher(algorithm)
        return values.map(lambda v: new(v).hexdigest(), na_action="ignore")

    return hashed(column.cast("binary"))


def genesis(algorithm: str = "sha256") -> Column:
    """What the first event of a chain has in place of a predecessor: zeroes in the digest's width."""
    return F.lit("0" * WIDTHS[algorithm])


def native_json(value: str | Column) -> Column:
    """JSON text with sorted keys, without blanks, in plain UTF-8, nulls kept; null for text that is no JSON.

    In the JVM, for JSON whose numbers are whole and whose strings have no control characters: then it is that of
    canonical_json, which takes all JSON.
    """
    return F.to_json(F.try_parse_json(F.col(value) if isinstance(value, str) else value))


def canonical_json(value: str | Column) -> Column:
    """As native_json for all JSON, in Arrow batches: fractions, exponents and control characters in the forms of the hashed envelopes."""

    @F.pandas_udf(T.StringType())
    def canonical(texts: pd.Series) -> pd.Series:
        def form(text: str | None) -> str | None:
            try:
                return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if text is not None else None
            except ValueError:
                return None

        return texts.map(form)

    return canonical(value)


def json_text(value: Column) -> Column:
    """A JSON string literal, or null in JSON for null."""
    body = F.to_json(F.struct(value.cast("string").alias("v")), {"ignoreNullFields": "false"})
    return F.substring(body, F.lit(6), F.length(body) - 6)


def envelope(schema: str, algorithm: str) -> tuple[Column, Column]:
    """The canonical event before and after the value of its previous_hash. Columns are those of a ledger; details_json is canonical."""
    actor = F.concat(
        F.lit('{"actor":{"authority_basis":'), json_text(F.col("authority_basis")), F.lit(',"credential_fingerprint":'), json_text(F.col("credential_fingerprint")),
        F.lit(',"kind":'), json_text(F.col("actor_kind")), F.lit(',"operator_id":'), json_text(F.col("actor_id")), F.lit(',"operator_uuid":'), json_text(F.col("actor_uuid")),
    )
    head = F.concat(
        actor, F.lit('},"details":'), F.col("details_json"), F.lit(',"event_sequence":'), F.col("event_sequence").cast("string"), F.lit(',"event_type":'), json_text(F.col("event_type")),
        F.lit(f',"hash_algorithm":"{algorithm}","object_id":'), json_text(F.col("object_id")), F.lit(',"object_type":'), json_text(F.col("object_type")),
        F.lit(',"occurred_at":'), json_text(F.col("occurred_at")), F.lit(',"previous_hash":"'),
    )
    return head, F.lit(f'","schema":{json.dumps(schema)}}}')


def event_hash(previous: Column, schema: str = "audit-event/v3", algorithm: str = "sha256") -> Column:
    """The hash of each ledger row over its canonical envelope with the given predecessor."""
    head, tail = envelope(schema, algorithm)
    return digest(F.concat(head, previous, tail), algorithm)


def running_digest(rows: DataFrame, key: str, order: list[str], name: str, algorithm: str, head: str, separator: str, tail: str) -> DataFrame:
    """(key, name): the digest of each group's column `_line`, in order. Lines pass one by one; a task holds a batch and one state."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        new, now, state, first = hasher(algorithm), None, None, True
        for batch in batches:
            done = []
            for k, line in zip(batch["_key"], batch["_line"], strict=True):
                k = None if pd.isna(k) else k
                if state is None or k != now:
                    if state is not None:
                        state.update(tail.encode())
                        done.append((now, state.hexdigest()))
                    now, state, first = k, new(), True
                    state.update(head.encode())
                if line is not None:
                    state.update(line.encode() if first else (separator + line).encode())
                    first = False
            yield pd.DataFrame(done, columns=["_key", name])
        if state is not None:
            state.update(tail.encode())
            yield pd.DataFrame([(now, state.hexdigest())], columns=["_key", name])

    lines = dealt(rows.withColumn("_key", F.col(key).cast("string")), "_key").sortWithinPartitions("_key", *order, "_line").select("_key", "_line")
    out = lines.mapInPandas(digests, f"_key string, {name} string")
    return out.select(F.col("_key").cast(rows.schema[key].dataType).alias(key), name)


def ordered_state_digest(tables: dict[str, tuple[DataFrame, list[str]]], key: str = "project_id", algorithm: str = "sha256") -> DataFrame:
    """(key, state_digest): the digest of {"table":[rows],...} in canonical JSON for each key, tables by name, rows of a
    table (frame, order) in its order. Keys that a table lacks have an empty list there. Rows pass one by one through running_digest.

    Frames have string, whole-number or null columns besides the key, whose JSON is the same in every engine.
    """
    names, parts = sorted(tables), []
    for at, name in enumerate(names):
        df, order = tables[name]
        columns = sorted(c for c in df.columns if c != key)
        body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        parts.append(df.select(key, F.lit(at).alias("_o0"), place.alias("_o1"), body.alias("_row")))
    keys = reduce(lambda a, b: a.unionByName(b), [p.select(key) for p in parts]).distinct()
    heads = keys.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("_o0"), F.lit(0).alias("_o1"), F.lit(json.dumps(n) + ":[").alias("_row")) for i, n in enumerate(names)])).alias("x")).select(key, "x.*")
    ends = heads.select(key, "_o0", F.lit(2147483647).alias("_o1"), F.lit("]").alias("_row"))
    rows = reduce(lambda a, b: a.unionByName(b), [*parts, heads, ends])
    comma = F.when((F.col("_o1") > 1) & (F.col("_row") != "]"), ",").when((F.col("_o1") == 0) & (F.col("_o0") > 0), ",").otherwise("")
    return running_digest(rows.withColumn("_line", F.concat(comma, "_row")).drop("_row"), key, ["_o0", "_o1"], "state_digest", algorithm, "{", "", "}")


def tree_digest(df: DataFrame, key: str, path: str, content: str, algorithm: str = "sha256") -> DataFrame:
    """(key, tree_digest): the digest of each group's inventory of (content digest, path), paths ordered part by part."""
    row = F.concat(F.lit('{"content_digest":'), json_text(F.col(content)), F.lit(',"path":'), json_text(F.col(path)), F.lit("}"))
    rows = df.select(key, F.split(path, "/").alias("_o0"), row.alias("_line"))
    return running_digest(rows, key, ["_o0"], "tree_digest", algorithm, "[", ",", "]")


def lines_digest(df: DataFrame, key: str, order: list[str], parts: list[str], algorithm: str = "sha256") -> DataFrame:
    """(key, lines_digest): the digest of each group's lines, columns joined by colons and lines by line feeds, in order."""
    line = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    rows = df.select(key, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], line.alias("_line"))
    return running_digest(rows, key, [f"_o{i}" for i in range(len(order))], "lines_digest", algorithm, "", "\n", "")


BUCKET_DIGITS = 3


def state_digest(tables: dict[str, DataFrame], digits: int = BUCKET_DIGITS) -> DataFrame:
    """(table, n_rows, digest): a digest of each table that does not depend on the order of rows or partitions.

    Rows are hashed in parallel. Those whose hashes begin with the same `digits` hexadecimal digits are a bucket: their
    hashes are hashed in order, and so are the buckets of a table. Equal rows, which share a bucket however many they
    are, count as one row with their number. Choose digits so that a bucket of 16^-digits of a table fits in a task.
    """
    out = None
    for name, df in sorted(tables.items()):
        row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}), 256)
        hashed = df.select(row.alias("h")).groupBy("h").agg(F.count("*").alias("n"))
        each = F.concat_ws(":", "h", F.col("n").cast("string"))
        ordered = hashed.groupBy(F.substring("h", 1, digits).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(each)), ","), 256).alias("d"), F.sum("n").alias("n"))
        total = ordered.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))
        part = total.select(F.lit(name).alias("table"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "digest")
        out = part if out is None else out.unionByName(part)
    return out
