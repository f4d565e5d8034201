"""Chat formatting: conversations rendered with a template, encoded once with offsets, and masked for training.

Template: each turn is <|turn|> role <|text|> text <|end|>. In roles and texts a backslash becomes two and <| becomes
<\\|, so that no control string can occur in them and reading back is exact. The control strings are special tokens of
the tokenizer, hence tokens never reach over the border of a text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import text_slices

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PARTS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
BLOCK_CHARS = 1 << 20
BATCH_CHARS, BATCH_ROWS = 1 << 19, 512


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], loss_role: str) -> tuple[str, np.ndarray]:
    """The formatted turns, and the sorted spans [start, end) of the texts of loss_role."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == loss_role and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens, given as [start, end) in code points, lie in a span: the last span that begins before a token ends is found by binary search."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 1], side="left") - 1
    return (at >= 0) & (spans[at, 1] > offsets[:, 0]) & (offsets[:, 1] > offsets[:, 0])


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([TURN, TEXT, END])
    return tokenizer


FORMATTED = [("part", T.IntegerType()), ("block", T.IntegerType()), ("whole", T.BooleanType()), ("formatted", T.StringType()), ("ids", T.ArrayType(T.IntegerType())), ("starts", T.ArrayType(T.IntegerType())), ("ends", T.ArrayType(T.IntegerType())), ("loss", T.ArrayType(T.BooleanType()))]


def encoded(encoder: Tokenizer, rendered: list[tuple[str, np.ndarray]]) -> dict[str, pa.Array]:
    """ids, starts, ends and loss of rendered texts, encoded in one call."""
    found = encoder.encode_batch([text for text, _ in rendered], add_special_tokens=False)
    offsets = [np.array(e.offsets, np.int64).reshape(-1, 2) for e in found]
    cuts = pa.array(np.r_[0, np.cumsum([len(o) for o in offsets])], pa.int32())
    flat = np.concatenate(offsets)
    values = {"ids": pa.array(np.concatenate([np.array(e.ids, np.int32) for e in found])), "starts": pa.array(flat[:, 0], pa.int32()), "ends": pa.array(flat[:, 1], pa.int32())}
    values["loss"] = pa.array(np.concatenate([mask(o, spans) for o, (_, spans) in zip(offsets, rendered, strict=True)]), pa.bool_())
    return {name: pa.ListArray.from_arrays(cuts, v) for name, v in values.items()}


def format_conversations(rows: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Formatted conversations: (conv_col, part, block, whole, formatted, ids, starts, ends, loss).

    A conversation is rendered and encoded as a whole, in one row (whole is true). One that a task cannot hold, of over block_chars of
    text or of more than a 512th of all turns, has several rows of whole turns (a longer turn alone); in the order
    (part, block) they are its formatted text. As rows end at control tokens, their ids are those of the conversation
    encoded at once. ids are the tokens, starts and ends their code points within formatted, loss the mask of tokens in
    texts of loss_role. Turns are ordered by turn, then role and text; repeated rows are turns of their own. Null turns
    come first, null roles and texts are empty, rows without an id are one conversation. Other columns are dropped.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number, kind = load(tokenizer), TaskContext.get().partitionId(), 0, None
        held: list[tuple[object, bool, list[tuple[str, str]]]] = []

        def done() -> pa.RecordBatch:
            nonlocal number
            rendered = [render(turns, loss_role) for _, _, turns in held]
            names = {"_conv": pa.array([c for c, _, _ in held], kind), "part": pa.array([part] * len(held), pa.int32()), "block": pa.array(range(number, number + len(held)), pa.int32()), "whole": pa.array([w for _, w, _ in held], pa.bool_()), "formatted": pa.array([t for t, _ in rendered])}
            number += len(held)
            return pa.record_batch(names | encoded(encoder, rendered))

        conv, turns, size, waiting, whole = None, [], 0, 0, True
        for batch in batches:
            kind = batch.column("_conv").type
            for first, texts in text_slices(batch):
                for c, role, long, text in zip(*(batch.column(x).slice(first, len(texts)).to_pylist() for x in ("_conv", "_role", "_is_long")), texts, strict=True):
                    if turns and (c != conv or size + len(text) > block_chars):
                        whole = whole and c != conv
                        held.append((conv, whole, turns))
                        waiting += size
                        turns, size = [], 0
                        if waiting > BATCH_CHARS or len(held) >= BATCH_ROWS:
                            yield done()
                            held, waiting = [], 0
                    if not turns:
                        whole = not long and (whole or c != conv)
                    conv = c
                    turns.append((role, text))
                    size += len(text)
        if turns:
            held.append((conv, whole, turns))
        if held:
            yield done()

    clean = rows.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), *[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((role_col, "_role"), (text_col, "_text"))])
    # A conversation of more than a 512th of all turns would fill one task: there are at most 512, they are broadcast, and their turns are dealt by ranges.
    often = max(1000, rows.count() // 512)
    long = clean.groupBy("_conv").agg(F.count("*").alias("_n")).filter(F.col("_n") > often).select(F.col("_conv").alias("_long"), F.lit(True).alias("_is_long"))
    split = clean.join(F.broadcast(long), F.col("_conv").eqNullSafe(F.col("_long")), "left").drop("_long")
    keys = ["_conv", "_turn", "_role", "_text"]
    whole = split.filter("_is_long is null").repartition("_conv").sortWithinPartitions(*keys)
    dealt = whole.unionByName(split.filter("_is_long").repartitionByRange(*keys).sortWithinPartitions(*keys)).select("_conv", "_role", "_text", "_is_long")
    schema = T.StructType([T.StructField("_conv", rows.schema[conv_col].dataType), *[T.StructField(n, t) for n, t in FORMATTED]])
    return dealt.mapInArrow(blocks, schema).withColumnRenamed("_conv", conv_col)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text. ValueError if it is not what `render` writes."""
    turns, at = [], 0
    for m in PARTS.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text between turns")
    return turns


def loss_text(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The unescaped texts under the mask, one for each run of tokens that touch."""
    a, b = starts[loss], ends[loss]
    if not len(a):
        return []
    new = np.flatnonzero(np.r_[True, a[1:] > np.maximum.accumulate(b)[:-1]])
    return [unescape(formatted[x:y]) for x, y in zip(a[new], np.maximum.reduceat(b, new), strict=True)]


def read_formatted(blocks: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Every turn of formatted blocks again: (conv_col, part, block, position, role, text)."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch, "formatted"):
                own = [read_turns(t) for t in texts]
                of = pa.array(np.repeat(np.arange(first, first + len(texts)), [len(x) for x in own]))
                flat = [t for x in own for t in x]
                names = {c: batch.column(c).take(of) for c in ("_conv", "part", "block")}
                yield pa.record_batch(names | {"position": pa.array([i for x in own for i in range(len(x))], pa.int32()), "role": pa.array([r for r, _ in flat], pa.string()), "text": pa.array([t for _, t in flat], pa.string())})

    rows = blocks.select(F.col(conv_col).alias("_conv"), "part", "block", "formatted")
    fields = [T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("block", T.IntegerType()), ("position", T.IntegerType()), ("role", T.StringType()), ("text", T.StringType()))]
    return rows.mapInArrow(turns, T.StructType([T.StructField("_conv", blocks.schema[conv_col].dataType), *fields])).withColumnRenamed("_conv", conv_col)


DIGESTS = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]


def digest_conversations(blocks: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row a conversation, read back from formatted blocks: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Conversations of one row are read where they are. A digest over one of several is a sequence by nature; its blocks
    pass one after another through one task, which holds a block and the state of the digests, never the conversation.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, kind, out = None, None, None, []

        def row() -> tuple:
            n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def done() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(["_conv", *(n for n, _ in DIGESTS)], columns, kinds, strict=True)})

        for batch in batches:
            kind = batch.column("_conv").type
            alone = batch.column("whole").to_pylist()
            lists = [batch.column(c) for c in ("starts", "ends", "loss")]
            for first, texts in text_slices(batch, "formatted"):
                convs = batch.column("_conv").slice(first, len(texts)).to_pylist()
                for i, (c, text) in enumerate(zip(convs, texts, strict=True), first):
                    if state is None or c != conv or alone[i]:
                        if state:
                            out.append(row())
                        conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, t in read_turns(text):
                        state[0] += 1
                        state[1].update(f"{role}\n{t}\n".encode())
                    for t in loss_text(text, *(x[i].values.to_numpy(zero_copy_only=False) for x in lists)):
                        state[2] += len(t)
                        state[3].update(t.encode())
                    state[4] += len(text)
            if out:
                yield done()
                out = []
        if state:
            out.append(row())
            yield done()

    rows = blocks.select(F.col(conv_col).alias("_conv"), "part", "block", "whole", "formatted", "starts", "ends", "loss")
    several = rows.filter("not whole").repartition("_conv").sortWithinPartitions("_conv", "part", "block")
    dealt = rows.filter("whole").unionByName(several).drop("part", "block")
    schema = T.StructType([T.StructField("_conv", blocks.schema[conv_col].dataType), *[T.StructField(n, t) for n, t in DIGESTS]])
    return dealt.mapInArrow(digests, schema).withColumnRenamed("_conv", conv_col)
