"""Near copies by the Jaccard similarity of shingle sets: MinHash bands give pairs, the texts decide, components group them.

Two texts of similarity s agree in one of BANDS bands of ROWS minima with a chance of 1 - (1 - s^ROWS)^BANDS, whatever
the size of the corpus: 0.99997 at s = 0.8. Every pair that shares a band is covered, however many texts share it:

1. Each text is held against the hub of one of its bands, and against the other hubs that are not in its component by
   then. The links that hold give components. Signatures of fixed size screen the pairs before texts are fetched.
2. Pairs within one component need no look. The others have one side outside the band's largest component: that side
   meets the whole band in pairs of blocks of bounded size, thinned out by signatures. A task hashes a block's texts once,
   looks at a text's closest partners first and leaves out those in its component by then; only links that join components
   leave it.
3. Bands of which so many texts lie outside that component that they make more than CROWD pairs of blocks are dealt anew
   where that makes fewer pairs: two sets of similarity s share a shingle among the 1 - s rarest of each, so texts meet
   over their rarest shingles. Texts that have most of a form in common but not s meet few others, and no pair at s is
   lost. Copies of one text with a few words changed have the form's shingles among their rarest and would meet over each
   of them: their bands are compared as they are.

Links come from the exact similarity of the texts' own shingles in both steps.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import tasks
from .common import numbered, slices, written
from .components import connected_components

SEED = 42
BANDS, ROWS = 20, 4
# One-bit minima: 256 bits of which (1 - s) / 2 differ on average. At s = 0.8 that is 26 bits, give or take 4.8; unrelated
# texts differ in 128, give or take 8. The limit is 26 plus five deviations.
MINIMA, BITS_APART = 256, 50
BLOCK = 512
CROWD = 64
CHUNK = 256
# A text's closest partners, looked at before the others.
FIRST = 16


def shingles(text: str | None, size: int) -> set[bytes]:
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if len(parts) < size:
        return {b" ".join(parts)} if parts else set()
    return {b" ".join(x) for x in zip(*(parts[i:] for i in range(size)), strict=False)}


@functools.cache
def mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, MINIMA, np.uint32), rng.integers(0, 1 << 32, MINIMA, np.uint32) | np.uint32(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(text: str | None, size: int) -> np.ndarray:
    """The shingle set of a text as sorted 64-bit hashes: of `size` words' hashes, or of all words where these are fewer."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if len(parts) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED + 1)] if parts else [], np.uint64)
    words = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in parts), np.uint64, len(parts))
    h, n = np.zeros(len(parts) - size + 1, np.uint64), len(parts) - size + 1
    for i in range(size):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return distinct(h)


def distinct(h: np.ndarray) -> np.ndarray:
    """np.unique, which takes five times as long on a text's hashes."""
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def least_hashes(text: str | None, size: int) -> tuple[int, int, np.ndarray]:
    """(name of the shingle set, its size, its MINIMA least hashes)."""
    h = hashes(text, size)
    name = signed(xxhash.xxh64_intdigest(h.tobytes(), SEED))
    flips, factors = mixers()
    short, least = (h >> np.uint64(32)).astype(np.uint32), np.full(MINIMA, (1 << 32) - 1, np.uint32)
    room = np.empty((min(len(h), CHUNK), MINIMA), np.uint32)
    for at in range(0, len(h), CHUNK):
        part = short[at : at + CHUNK, None]
        x = np.bitwise_xor(part, flips, out=room[: len(part)])
        np.minimum(least, np.multiply(x, factors, out=x).min(axis=0), out=least)
    return name, len(h), least


def band_keys(least: np.ndarray, bands: int, rows: int, seed: int = 0) -> list[int]:
    return [signed(xxhash.xxh64_intdigest(least[j * rows : (j + 1) * rows].tobytes(), seed + j)) for j in range(bands)]


def minima(text: str | None, size: int) -> tuple[int, list[int], list[int]]:
    """(name of the shingle set, band keys, one-bit minima); no keys for an empty set."""
    name, n, least = least_hashes(text, size)
    if not n:
        return name, [], [0] * (MINIMA // 64)
    bits = np.packbits((least >> np.uint32(8) & np.uint32(1)).astype(bool), bitorder="little")
    return name, band_keys(least, BANDS, ROWS), bits.view(np.int64).tolist()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_minima(rows: DataFrame, size: int) -> DataFrame:
    @F.pandas_udf("_node bigint, _keys array<bigint>, _bits array<bigint>")
    def found(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([minima(t, size) for t in text], columns=["_node", "_keys", "_bits"])

    return rows.withColumn("_m", found("_text")).select("*", "_m.*").drop("_m")


def linked(pairs: DataFrame, texts: DataFrame, size: int, fifths: float) -> DataFrame:
    """The pairs (u, v) whose texts have a similarity of fifths / 5 or more."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = functools.lru_cache(maxsize=256)(hashes)
        for batch in batches:
            keep = [similar(sets(a, size), sets(b, size), fifths) for a, b in zip(batch["_a"], batch["_b"], strict=True)]
            yield batch.loc[keep, ["u", "v"]]

    # Pairs are small, their texts are not: by bytes alone all pairs may be put in one task.
    pairs = pairs.repartition(tasks(pairs.sparkSession), "u")
    asked = pairs.select(F.col("u").alias("_node")).unionByName(pairs.select(F.col("v").alias("_node"))).distinct()
    held = texts.join(asked, "_node", "left_semi")
    sides = [held.select(F.col("_node").alias(x), F.col("_text").alias(y)) for x, y in (("u", "_a"), ("v", "_b"))]
    return pairs.join(sides[0], "u").join(sides[1], "v").mapInPandas(check, "u bigint, v bigint")


def similar(a: np.ndarray, b: np.ndarray, fifths: float) -> bool:
    """Whether two shingle sets have a similarity of fifths / 5 or more."""
    if 5 * min(len(a), len(b)) < fifths * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= fifths * (len(a) + len(b) - both)


class Forest:
    """Components of whatever names are asked for."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[p]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)


def close_rows(a: dict, b: dict, most: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two blocks of band `key` with at most `most` differing bits and not of one component, closest first.

    A pair that shares several bands is looked at in the first of them only.
    """
    apart = sum(np.bitwise_count(a["bits"][:, None, j] ^ b["bits"][None, :, j]).astype(np.int16) for j in range(a["bits"].shape[1]))
    i, j = np.nonzero((apart <= most) & (np.array(a["root"])[:, None] != np.array(b["root"])[None, :]))
    met, ours = np.zeros(len(i), bool), np.zeros(len(i), bool)
    has = (a["keys"] == key).any(axis=1)[i]
    for x, y in zip(a["keys"].T, b["keys"].T, strict=True):
        same = (x[i] == y[j]) & ~met
        ours |= same & (x[i] == key)
        met |= same
    ours |= ~has
    i, j = i[ours], j[ours]
    order = np.argsort(apart[i, j], kind="stable")
    return i[order], j[order]


class Overlaps:
    """Sizes of intersections with any of the sets held: sorted hashes by name."""

    def __init__(self, sets: dict[int, np.ndarray]):
        self.every = distinct(np.concatenate(list(sets.values())))
        self.places = {k: np.searchsorted(self.every, s) for k, s in sets.items()}
        self.mark = np.zeros(len(self.every), np.uint8)

    def of(self, own: np.ndarray, names: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(how many elements the sets of these names share with own, how many they have)."""
        at = np.searchsorted(self.every, own)
        at = at[self.every[np.minimum(at, len(self.every) - 1)] == own]
        self.mark[at] = 1
        places = [self.places[k] for k in names]
        sizes = np.array([len(p) for p in places])
        both = np.add.reduceat(self.mark[np.concatenate(places)], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.mark[at] = 0
        return both, sizes


def block_links(a: dict, b: dict, size: int, fifths: float, most: int, key: int) -> list[tuple[int, int]]:
    """Links (u, v) between the texts of two blocks that join components.

    A block has lists node, root and text and arrays bits and keys. A text is held against its closest partners first, then
    against those that a link before has not put in its component.
    """
    forest, out = Forest(), []
    i, j = close_rows(a, b, most, key)
    rows, start = np.unique(j).tolist(), 0
    for texts in slices([b["text"][y] for y in rows], 16_000_000) if rows else ():
        held = rows[start : start + len(texts)]
        start += len(texts)
        overlaps = Overlaps({y: hashes(t, size) for y, t in zip(held, texts, strict=True)})
        ours = (j >= held[0]) & (j <= held[-1])
        order = np.argsort(i[ours], kind="stable")
        x, y = i[ours][order], j[ours][order]
        edges = np.flatnonzero(np.diff(x, prepend=-1, append=-1)).tolist()
        for at, end in zip(edges, edges[1:]):
            k, own = int(x[at]), None
            for partners in (y[at : at + FIRST], y[at + FIRST : end]) if end - at > FIRST else (y[at:end],):
                names = [p for p in partners.tolist() if forest.root(a["root"][k]) != forest.root(b["root"][p])]
                if not names:
                    continue
                own = hashes(a["text"][k], size) if own is None else own
                both, sizes = overlaps.of(own, names)
                for p in np.array(names)[5 * both >= fifths * (len(own) + sizes - both)].tolist():
                    if forest.root(a["root"][k]) != forest.root(b["root"][p]):
                        forest.join(a["root"][k], b["root"][p])
                        out.append((a["node"][k], b["node"][p]))
    return out


def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple[list, list]]]:
    """((_key, _r, _c), parts of both sides) of rows sorted by these and _side; pairs that lack a side are left out."""
    now, parts = None, ([], [])
    for batch in batches:
        at = list(zip(*(batch.column(c).to_pylist() for c in ("_key", "_r", "_c", "_side")), strict=True))
        start = 0
        for i in range(1, len(at) + 1):
            if i < len(at) and at[i] == at[start]:
                continue
            if at[start][:3] != now:
                if parts[0] and parts[1]:
                    yield now, parts
                now, parts = at[start][:3], ([], [])
            parts[at[start][3]].append(batch.slice(start, i - start))
            start = i
    if parts[0] and parts[1]:
        yield now, parts


def mixed_bands(rows: DataFrame, root: DataFrame) -> DataFrame:
    """The rows (_key, _node, _root) of the bands that hold several components, with _out, whether a row is outside the
    band's largest component, _n, how many rows the band has, and _m, how many of them are outside."""
    named = rows.join(root, F.col("_node") == F.col("node"), "left").select("_key", "_node", F.coalesce("root", "_node").alias("_root"))
    named = written(named, "band-roots")
    parts = named.groupBy("_key", "_root").agg(F.count("*").alias("_rows"))
    sizes = parts.groupBy("_key").agg(F.max(F.struct("_rows", "_root")).alias("_most"), F.sum("_rows").alias("_n"), F.count("*").alias("_roots")).filter("_roots > 1")
    sizes = sizes.select("_key", "_n", (F.col("_n") - F.col("_most._rows")).alias("_m"), F.col("_most._root").alias("_own"))
    return written(named.join(sizes, "_key").select("_key", "_node", "_root", (F.col("_root") != F.col("_own")).alias("_out"), "_n", "_m"), "mixed-bands")


def rarest(texts: DataFrame, size: int, fifths: float) -> DataFrame:
    """(_key, _node, _texts): the shingles by which texts of similarity fifths / 5 or more meet, and how many texts hold each.

    Of n shingles in order of how many texts hold them, these are the first n - ceil(n fifths / 5) + 1.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column("_node").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                h = hashes(text, size)
                first = len(h) - int(np.ceil(len(h) * fifths / 5)) + 1
                yield pa.record_batch({"_key": pa.array(h.view(np.int64)), "_node": pa.array(np.full(len(h), node, np.int64)), "_first": pa.array(np.full(len(h), first, np.int64))})

    all_held = written(texts.select("_node", "_text").mapInArrow(held, "_key bigint, _node bigint, _first bigint"), "shingles")
    of = all_held.groupBy("_key").agg(F.count("*").alias("_texts"))
    place = F.row_number().over(Window.partitionBy("_node").orderBy("_texts", "_key"))
    return all_held.join(of, "_key").withColumn("_place", place).filter("_place <= _first and _texts > 1").select("_key", "_node", "_texts")


def across(rows: DataFrame, nodes: DataFrame, root: DataFrame, block: int, size: int, fifths: float, most: int, crowd: int) -> DataFrame:
    """Links (u, v) of each band between components of root: each text outside the band's largest component is held against
    all of the band, in pairs of blocks of about `block` texts; crowded bands are dealt anew by rarest shingles first, if
    their texts meet fewer others that way."""
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    mixed = mixed_bands(rows, root)
    crowded = blocks("_n").cast("long") * blocks("_m") > crowd
    asked = mixed.filter(crowded).select("_node").distinct()
    if asked.isEmpty():
        return within_blocks(mixed, nodes, block, size, fifths, most)
    rare = written(rarest(nodes.join(asked, "_node", "left_semi"), size, fifths), "rarest-shingles")
    met = mixed.filter(crowded).join(rare.groupBy("_node").agg(F.sum("_texts").alias("_met")), "_node", "left")
    anew = met.groupBy("_key", "_n", "_m").agg(F.coalesce(F.sum("_met"), F.lit(0)).alias("_met")).filter("_met <= _n * _m").select("_key")
    links = within_blocks(mixed.join(anew, "_key", "left_anti"), nodes, block, size, fifths, most)
    dealt = mixed_bands(rare.join(mixed.join(anew, "_key", "left_semi").select("_node").distinct(), "_node", "left_semi"), root)
    return links.unionByName(within_blocks(dealt, nodes, block, size, fifths, most)).distinct()


def within_blocks(mixed: DataFrame, nodes: DataFrame, block: int, size: int, fifths: float, most: int) -> DataFrame:
    """Links (u, v) of mixed bands. Only links that join components leave a task."""
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    whole = mixed.withColumns({"_rows": blocks("_n"), "_cols": blocks("_m")}).join(nodes.select("_node", "_bits", "_keys"), "_node")
    place = lambda n: F.pmod(F.xxhash64("_node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = ["_node", "_root", "_bits", "_keys"]
    a = whole.select("_key", place("_rows").alias("_r"), every("_cols").alias("_c"), F.lit(0).alias("_side"), *held)
    b = whole.filter("_out").select("_key", every("_rows").alias("_r"), place("_cols").alias("_c"), F.lit(1).alias("_side"), *held)

    def side(part: list[pa.RecordBatch], *lists: str) -> dict:
        t = pa.Table.from_batches(part)
        of = lambda c: t.column(c).combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        return {"bits": of("_bits").view(np.uint64), "keys": of("_keys"), "rows": t} | {c[1:]: t.column(c).to_pylist() for c in lists}

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a pair of blocks that have a partner in the other one: only their texts are looked at."""
        for (key, _, _), parts in block_pairs(batches):
            a, b = (side(p, "_root") for p in parts)
            i, j = close_rows(a, b, most, key)
            for x, rows in ((i, a["rows"]), (j, b["rows"])):
                if len(x):
                    yield from rows.take(pa.array(np.unique(x))).combine_chunks().to_batches()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, _), parts in block_pairs(batches):
            pairs = block_links(*(side(p, "_node", "_root", "_text") for p in parts), size, fifths, most, key)
            yield pa.record_batch({"u": pa.array([max(p) for p in pairs], pa.int64()), "v": pa.array([min(p) for p in pairs], pa.int64())})

    dealt = lambda df: df.repartition(tasks(df.sparkSession), "_key", "_r", "_c").sortWithinPartitions("_key", "_r", "_c", "_side", "_node")
    both = a.unionByName(b)
    close = written(dealt(both).mapInArrow(partners, both.schema), "close-rows")
    return dealt(close.join(nodes.select("_node", "_text"), "_node")).mapInArrow(links, "u bigint, v bigint").distinct()


def screened(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The pairs (u, v) whose signatures differ in at most `most` bits."""
    for c in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("_node").alias(c), F.col("_bits").alias(f"_{c}")), c)
    apart = F.aggregate(F.zip_with("_u", "_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    return pairs.filter(apart <= most).select("u", "v")


def components_of(found: DataFrame, size: int, fifths: float, most: int, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(_node, component_id, _first) for each shingle set of found (_id, _row, _text, _node, _keys, _bits): the smallest id
    that can be reached over links, and the row to keep of all that can be reached, the first of those with that id.

    A written table; found is one too. _node names a shingle set, _keys are its bands and _bits its signature.
    """
    order = F.struct(F.col("_id").isNull().alias("_no"), F.col("_id").alias("_id"), F.col("_row").alias("_row"))
    least = written(found.groupBy("_node").agg(F.min(order).alias("_least"), F.min("_row").alias("_row")), "shingle-sets")
    nodes = found.join(least.select("_row"), "_row", "left_semi").select("_node", "_keys", "_bits")
    bands = nodes.select(F.explode("_keys").alias("_key"), "_node")
    hubs = bands.groupBy("_key").agg(F.min("_node").alias("_hub"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    shared = written(bands.join(hubs, "_key"), "shared-bands")
    some = least.join(shared.select("_node").distinct(), "_node", "left_semi")
    nodes = written(found.join(some.select("_row"), "_row", "left_semi").select("_node", "_text", "_keys", "_bits"), "band-texts", compression="zstd")
    texts = nodes.select("_node", "_text")
    near = written(shared.filter("_node <> _hub").select(F.col("_node").alias("u"), F.col("_hub").alias("v")).distinct(), "hub-pairs")
    first = near.groupBy("u").agg(F.min("v").alias("v"))
    links = written(linked(screened(first, nodes, most), texts, size, fifths), "hub-links")
    root = written(connected_components(links), "hub-components")
    for c in ("u", "v"):
        near = near.join(root.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c, "left")
    other = near.filter(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select("u", "v").join(first, ["u", "v"], "left_anti")
    links = links.unionByName(written(linked(screened(other, nodes, most), texts, size, fifths), "hub-links"))
    links = links.unionByName(across(shared, nodes, connected_components(links), block, size, fifths, most, crowd))
    parts = written(connected_components(links), "components")
    roots = least.join(parts, F.col("_node") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_node"))
    firsts = roots.groupBy("_root").agg(F.min("_least").alias("_least"))
    return written(roots.select("_node", "_root").join(firsts, "_root").select("_node", F.col("_least._id").alias("component_id"), F.col("_least._row").alias("_first")), "node-components")


def with_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select("*", F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, fifths: int = 4, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(id_col, component_id) for each row of docs: component_id is the smallest id that can be reached over links.

    Texts link when the sets of their shingles of `size` words have a Jaccard similarity of fifths / 5 or more; texts
    of fewer words are one shingle, and those without words are equal. For similarities below 0.8 bands miss more.
    """
    found = written(with_minima(with_rows(docs.select(id_col, text_col), id_col, text_col).select("_id", "_text", "_row"), size), "minima")
    parts = components_of(found, size, fifths, BITS_APART, block, crowd)
    return found.select("_id", "_node").join(parts, "_node").select(F.col("_id").alias(id_col), "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, fifths: int = 4, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """docs with one row of each group of near copies, as near_copy_groups links them: one with the smallest id of the
    group, or one without an id where no row has any. Rows are judged by their texts, also where several have one id;
    null, empty and blank texts are equal. All columns stay, whatever their names."""
    rows, at = numbered(docs)
    found = written(with_minima(with_rows(rows, at[id_col], at[text_col]), size), "minima")
    parts = components_of(found, size, fifths, BITS_APART, block, crowd)
    return found.join(parts.select(F.col("_first").alias("_row")).distinct(), "_row", "left_semi").select(*at.values()).toDF(*at)
