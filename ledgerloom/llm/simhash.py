"""Near-duplicates by SimHash: fingerprints, candidates, pivot distance tables, verified links, components.

Pairs come from keys: fingerprints that agree in some of their bits. Each key's pairs are held against a pivot table,
the Hamming distances of every fingerprint to PIVOTS reference fingerprints: by the triangle inequality a pair whose
distances to one reference differ by more than max_bits can be discarded. The rest is verified bit by bit. (Distances
to references alone can't give the pairs: those of 64-bit fingerprints all lie within 32 plus or minus a few, so cells
of the table hold too large a part of all fingerprints. The keys bound the pairs, the table thins them out.)

A key's links leave a task as a spanning tree. Keys with more than `most` different fingerprints do not get compared
pair by pair, see `crowded_exact`.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

SEED = 42
PIVOTS = 16
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, words: int = 1) -> np.ndarray:
    """`words` unsigned 64-bit words. Word j counts the bits of the XXH64 of every shingle with seed SEED + j."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(words, np.uint64)
    if len(parts) < shingle:
        grams = [b" ".join(parts)]
    else:
        grams = [b" ".join(x) for x in zip(*(parts[i:] for i in range(shingle)), strict=False)]
    ones = np.zeros(64 * words, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(grams), BLOCK):
        block = grams[at : at + BLOCK]
        h = np.fromiter((digest(g, SEED + j) for g in block for j in range(words)), np.uint64, len(block) * words)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(block), 8 * words), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)


def with_fingerprints(docs: DataFrame, text_col: str, shingle: int, words: int) -> DataFrame:
    names = [f"_f{j}" for j in range(words)]

    @F.pandas_udf(", ".join(f"{x} bigint" for x in names))
    def prints(text: pd.Series) -> pd.DataFrame:
        found = np.array([fingerprint(t, shingle, words) for t in text], np.uint64).reshape(len(text), words)
        return pd.DataFrame(found.view(np.int64), columns=names)

    return docs.withColumn("_print", prints(text_col)).select("*", "_print.*").drop("_print")


def references(words: int) -> np.ndarray:
    rng = random.Random(SEED)
    return np.array([[rng.getrandbits(64) for _ in range(words)] for _ in range(PIVOTS)], np.uint64)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints."""
    return np.stack([np.bitwise_count(prints ^ r).sum(axis=1, dtype=np.int16) for r in references(prints.shape[1])], axis=1)


def close_pairs(keys: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Row pairs (i, j) with one key (keys are sorted) whose fingerprints differ in max_bits bits or fewer.

    Also returns how many pairs were looked at, and how many the pivot table left over.
    """
    table = pivot_table(prints)
    left, right, looked, kept = [], [], 0, 0
    i = np.arange(len(keys))
    for step in itertools.count(1):
        i = i[i + step < len(keys)]
        i = i[keys[i] == keys[i + step]]
        if not len(i):
            break
        near = i[np.abs(table[i] - table[i + step]).max(axis=1) <= max_bits]
        looked, kept = looked + len(i), kept + len(near)
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]).sum(axis=1) <= max_bits]
        left.append(near)
        right.append(near + step)
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none]), looked, kept


def spanning(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def exact_masks(max_bits: int) -> list[list[int]]:
    """Masks for 64 bits: any two fingerprints within max_bits agree in one of them. Blocks left alone: max_bits + 2 blocks, any two."""
    blocks = max_bits + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [[a | b] for a, b in itertools.combinations(parts, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masked(prints: list[str], mask: list[int]) -> list[Column]:
    return [F.col(f).bitwiseAND(F.lit(signed(m))) for f, m in zip(prints, mask, strict=True) if m]


def keyed(nodes: DataFrame, prints: list[str], masks: list[list[int]]) -> DataFrame:
    """A row of (_key, _node, fingerprint) for each fingerprint and mask, without keys that only one fingerprint has; _n is how many have it."""
    keys = F.array(*[F.xxhash64(F.lit(j), *masked(prints, m)) for j, m in enumerate(masks)])
    rows = nodes.select(F.explode(keys).alias("_key"), "_node", *prints)
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("_key"))).filter("_n > 1")


def sparse_links(rows: DataFrame, prints: list[str], max_bits: int) -> DataFrame:
    """Links (u, v) within keys of a bounded number of fingerprints."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                batch = batch if carried is None else pd.concat([carried, batch], ignore_index=True)
                key = batch["_key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
                batch, carried = batch.iloc[:cut], batch.iloc[cut:]
            else:
                batch = carried
            if batch is None or not len(batch):
                continue
            node = batch["_node"].to_numpy()
            left, right, _, _ = close_pairs(batch["_key"].to_numpy(), batch[prints].to_numpy().view(np.uint64), max_bits)
            pairs = np.array(spanning(left, right), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"u": node[pairs[:, 0]], "v": node[pairs[:, 1]]})

    dealt = rows.select("_key", "_node", *prints).repartition("_key").sortWithinPartitions("_key", "_node")
    return dealt.mapInPandas(links, "u bigint, v bigint")


def crowded_exact(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links within crowded keys, all of them, for max_bits up to 2 and 64-bit fingerprints.

    Two fingerprints differ in at most 2 bits if and only if some value is within 1 bit of both. Each fingerprint gives
    itself and its 64 neighbours; at most 65 fingerprints share a value, and those form a star below the least of them.
    (For 1 bit: a value and a fingerprint that is the value itself.)
    """
    if max_bits > 2:
        raise ValueError("crowded keys are exact for max_bits up to 2")
    flips = F.array(F.col("_f0"), *[F.col("_f0").bitwiseXOR(F.lit(signed(1 << b))) for b in range(64)]) if max_bits else F.array("_f0")
    near = rows.select("_node", "_f0").distinct().select("_node", F.explode(flips).alias("_value"), "_f0")
    shared = Window.partitionBy("_value")
    own = F.max(F.when(F.col("_f0") == F.col("_value"), F.col("_node"))).over(shared)
    hub = F.min("_node").over(shared) if max_bits == 2 else own
    return near.select(F.col("_node").alias("u"), hub.alias("v")).filter("u <> v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, most: int = 256) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row of docs.

    A fingerprint has 64 bits, shown in hexadecimal digits. Fingerprints link at max_bits (up to 2) or fewer differing
    bits, and no link is missed; component_id is the smallest id that can be reached over links. (Links by the similarity
    of texts are near_copies'.) Null and empty texts, and those of white space only, have fingerprint 0 and link like
    others. Equal texts link. Rows without an id are kept; they count for a component only when none of its rows has an
    id. Other columns are dropped.
    """
    if max_bits > 2:
        raise ValueError("fingerprints link at up to 2 bits")
    prints = ["_f0"]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = written(with_fingerprints(rows, "_text", shingle, 1).drop("_text"), "fingerprints")
    nodes = written(found.groupBy(*prints).agg(F.min("_id").alias("_least")).withColumn("_node", F.col("_f0")), "distinct-fingerprints")
    shared = written(keyed(nodes, prints, exact_masks(max_bits)), "shared-keys")
    links = sparse_links(shared.filter(F.col("_n") <= most), prints, max_bits)
    crowd = shared.filter(F.col("_n") > most)
    if not crowd.isEmpty():
        links = links.unionByName(crowded_exact(crowd, max_bits))
    parts = written(connected_components(links), "components")
    roots = nodes.join(parts, F.col("_node") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_node"))
    least = roots.groupBy("_root").agg(F.min("_least").alias("_component"))
    labels = written(roots.join(least, "_root").select(*prints, "_component"), "labels")
    text = F.lpad(F.lower(F.hex(found["_f0"])), 16, "0")
    return found.join(labels, found["_f0"] == labels["_f0"]).select(found["_id"].alias(id_col), text.alias("fingerprint"), F.col("_component").alias("component_id"))
