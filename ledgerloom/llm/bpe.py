"""Byte-pair encoding and decoding, with merges done for many words at once in numpy."""

from __future__ import annotations

import itertools
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import BEYOND_LATIN, Recent, slices

MOST_WORDS = 100_000
MOST_CACHED = 300_000
MOST_IDS = 1_000_000


def byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BatchBPE:
    """The vocabulary and merges of a tokenizer file of kind BPE whose words hold no white space.

    Normalisation and the split into words are those that the file names. Merging is done for many words at once: their
    symbols lie in one flat array; in each round every word merges all its pairs of lowest rank, found by binary search
    over the sorted pair keys; words without such pairs leave the array. That equals merging one pair after another, as
    any merge that uses a merged symbol has a higher rank (checked when a file is loaded).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.added = {token: i.to_bytes(4, "little") for token, i in added.items()}
        self.size = 1 + max([*vocab.values(), *added.values()])
        self.tokens = np.full(self.size, "", object)
        for token, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = token
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        letters = byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.pattern = self._latin_pattern(spec)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = np.full(self.size, -1, np.int64)
        for rank, i in enumerate(self.made.tolist()):
            born[i] = rank if born[i] < 0 else min(born[i], rank)
        if (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge comes before a merge that makes one of its parts")
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.ranks, self.none = (left * self.size + right)[order], order, len(merges)
        self.words = Recent(MOST_CACHED)

    @staticmethod
    def _latin_pattern(spec: dict):
        """The file's pattern of words, where it asks for NFC, lower case and nothing that is not white space between words."""
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if normal == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and not steps[1].get("add_prefix_space"):
            return regex.compile(steps[0]["pattern"]["Regex"])
        return None

    def _rank(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the given places; none where there is no merge or the word ends."""
        after = np.minimum(at + 1, len(ids) - 1)
        pair = ids[at] * self.size + ids[after]
        found = np.minimum(np.searchsorted(self.keys, pair), self.none - 1)
        return np.where((self.keys[found] == pair) & (word[at] == word[after]) & (at < after), self.ranks[found], self.none)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), lengths)
        ids = self.first[text]
        ends = np.cumsum(lengths) - 1
        ids[ends] = self.last[text[ends]]
        rank = self._rank(ids, word, np.arange(len(ids)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            least = np.minimum.reduceat(rank, starts)
            live = least < self.none
            if not live.all():
                stay = np.repeat(live, sizes)
                done.append((word[~stay], ids[~stay]))
                ids, word, rank, least, sizes = ids[stay], word[stay], rank[stay], least[live], sizes[live]
                if not len(ids):
                    break
            chosen = rank == np.repeat(least, sizes)
            if (chosen[1:] & chosen[:-1]).any():
                # In a run of one symbol every second pair merges, from the left.
                place = np.arange(len(chosen))
                place -= np.maximum.accumulate(np.where(chosen & ~np.r_[False, chosen[:-1]], place, 0))
                chosen &= place % 2 == 0
            first = np.flatnonzero(chosen)
            ids[first] = self.made[rank[first]]
            keep = np.ones(len(ids), bool)
            keep[first + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at = first - np.arange(len(first))
            rank[at] = self._rank(ids, word, at)
            before = at[at > 0] - 1
            rank[before] = self._rank(ids, word, before)
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))] * 4
        raw = ids[order].astype("<i4").tobytes()
        cuts = cuts.tolist()
        return [raw[a:b] for a, b in itertools.pairwise(cuts)]

    def _words(self, text: str) -> list[str]:
        """The words of a text after normalisation; special tokens stand for themselves."""
        if self.split_added and self.split_added.search(text):
            return [w for piece in self.split_added.split(text) if piece for w in ([piece] if piece in self.added else self._words(piece))]
        if self.pattern and (text.isascii() or not BEYOND_LATIN.search(text)):
            return self.pattern.findall(text.lower())
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.pre_tokenizer.pre_tokenize_str(text)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; a null text has none. Each different word is encoded once."""
        split = [self._words(t or "") for t in texts]
        new = [w for w in self.words.missing(set().union(*split)) if w not in self.added]
        held = self.words.new
        held.update(self.added)
        for i in range(0, len(new), MOST_WORDS):
            part = new[i : i + MOST_WORDS]
            held.update(zip(part, self.encode_words([w.encode() for w in part]), strict=True))
        return [b"".join(map(held.__getitem__, s)) for s in split]

    def decode_batch(self, ids: np.ndarray, lengths: list[int]) -> list[str]:
        """Texts of so many ids each: tokens joined by a blank, as the library does where a file names no decoder.

        Numbers that are no ids give an empty token.
        """
        known = (ids >= 0) & (ids < self.size)
        tokens = self.tokens[np.where(known, ids, 0)].tolist()
        if not known.all():
            tokens = [t if k else "" for t, k in zip(tokens, known, strict=True)]
        cuts = [0, *itertools.accumulate(lengths)]
        return [" ".join(tokens[a:b]) for a, b in itertools.pairwise(cuts)]


@lru_cache(maxsize=4)
def load(path: str) -> BatchBPE:
    return BatchBPE(path)


def id_lists(parts: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def bpe_encode(text: str | Column, path: str) -> Column:
    """array<int> of the ids of a text column under the tokenizer file at path; empty for null and empty texts."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        return id_lists([ids for part in slices(texts.to_pylist()) for ids in bpe.encode_batch(part)])

    return encode(text)


def bpe_decode(ids: str | Column, path: str) -> Column:
    """The text of a column of ids; null ids give an empty text."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        bpe = load(path)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
        flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        out, at, start, size = [], 0, 0, 0
        for i, n in enumerate([*lengths, MOST_IDS]):  # a bounded number of ids at a time, or a single long list
            if size and size + n > MOST_IDS:
                out += bpe.decode_batch(flat[at : at + size], lengths[start:i])
                at, start, size = at + size, i, 0
            size += n
        return pa.array(out + [""] * (len(lengths) - len(out)), pa.string())

    return decode(ids)
