"""Media columns in the FLAC format: an encoder for 8-bit mono samples and a decoder for the format at large.

Work is done on the frames of many streams at once: frames of one shape are lanes of numpy arrays, and each step reads
or restores one sample of every lane. Streams that do not hold what their checksums say are refused.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

BLOCK = 576
RATE = 8000
ORDER = 4
PRECISION = 7
MOST_SPLIT = 4
PCM_BLOCK = 1 << 16
# How a table of streams is written: equal frames of copies are close to each other, which zstandard finds.
MEDIA_OPTIONS = {"compression": "zstd", "parquet.compression.codec.zstd.level": "12", "parquet.page.size": str(1 << 24)}
# Fixed values of the format: block sizes, sample sizes and predictors by their codes, and the checksums' polynomials.
BLOCK_SIZES = {1: 192, **{2 + i: 576 << i for i in range(4)}, **{8 + i: 256 << i for i in range(8)}}
SAMPLE_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
CRC8_POLYNOMIAL, CRC16_POLYNOMIAL = 0x07, 0x8005


def crc_table(polynomial: int, width: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        table = np.where(table >> (width - 1) & 1, table << 1 ^ polynomial, table << 1) & ((1 << width) - 1)
    return table


CRC8, CRC16 = crc_table(CRC8_POLYNOMIAL, 8), crc_table(CRC16_POLYNOMIAL, 16)


def crc8(data: bytes) -> int:
    value = 0
    for b in data:
        value = int(CRC8[value ^ b])
    return value


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of each slice of data, one byte of every slice at a time."""
    order = np.argsort(-lengths, kind="stable")
    value, at, left = np.zeros(len(starts), np.int64), starts[order].copy(), lengths[order]
    live = len(at)
    for step in range(int(left[0]) if len(left) else 0):
        while left[live - 1] <= step:
            live -= 1
        v = value[:live]
        value[:live] = (v << 8 & 0xFFFF) ^ CRC16[(v >> 8) ^ data[at[:live] + step]]
    out = np.empty_like(value)
    out[order] = value
    return out


@lru_cache(maxsize=1 << 16)
def frame_header(number: int) -> bytes:
    """The header of a frame of BLOCK mono 8-bit samples at RATE."""
    if number < 0x80:
        coded = bytes([number])
    else:
        n = next(n for n in range(2, 8) if number < 1 << (5 * n + 1 if n < 7 else 36))
        coded = bytes([(0xFF00 >> n & 0xFF) | number >> 6 * (n - 1), *(0x80 | number >> 6 * i & 0x3F for i in range(n - 2, -1, -1))])
    head = bytes([0xFF, 0xF8, 0x24, 0x02]) + coded
    return head + bytes([crc8(head)])


def put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = value >> (width - 1 - j) & 1


def predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors (coefficients, shift) of each row, by Levinson's recursion on whole-number sums."""
    n = x.shape[1]
    r = np.stack([(x[:, : n - j] * x[:, j:]).sum(axis=1) for j in range(ORDER + 1)], axis=1).astype(float)
    a, error = np.zeros((len(x), ORDER)), np.maximum(r[:, 0], 1.0)
    for i in range(ORDER):
        k = (r[:, i + 1] - sum((a[:, j] * r[:, i - j] for j in range(i)), np.zeros(len(x)))) / error
        old = a.copy()
        for j in range(i):
            a[:, j] = old[:, j] - k * old[:, i - 1 - j]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-3)
    top = np.maximum(np.abs(a).max(axis=1), 1e-6)
    most = (1 << PRECISION - 1) - 1
    shift = np.clip(np.floor(np.log2(most / top)), 0, 14).astype(np.int64)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most, most).astype(np.int64), shift


def partitions(folded: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(split, rice, size) of each row of folded residuals, the first `order` of which are not coded: into how many
    partitions, as a power of two, the parameter of each of the 2^MOST_SPLIT smallest parts, and the bits of all."""
    n, parts = len(folded), 1 << MOST_SPLIT
    held = np.full(parts, BLOCK // parts)
    held[0] -= order
    cost = np.stack([(folded >> k).reshape(n, parts, -1).sum(axis=2) + held * (1 + k) for k in range(9)], axis=2)
    split, rice, size = np.zeros(n, np.int64), np.zeros((n, parts), np.int64), np.full(n, np.iinfo(np.int64).max)
    for level in range(MOST_SPLIT, -1, -1):
        bits = cost.min(axis=2).sum(axis=1) + (4 << level)
        better = bits <= size
        size, split = np.where(better, bits, size), np.where(better, level, split)
        rice = np.where(better[:, None], np.repeat(cost.argmin(axis=2), parts >> level, axis=1), rice)
        if level:
            cost = cost[:, 0::2] + cost[:, 1::2]
    return split, rice, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of BLOCK; bytes are samples less 128."""
    counts = [len(p) // BLOCK for p in payloads]
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError(f"payloads must be positive multiples of {BLOCK} bytes")
    if not payloads:
        return []
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int64) - 128
    number = np.concatenate([np.arange(c) for c in counts])
    coef, shift = predictors(x)
    guess = sum(coef[:, j : j + 1] * x[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER)) >> shift[:, None]
    # Kinds: 0 constant, 1 verbatim, 2 fixed predictor of order 1, 3 linear predictor.
    order, head_bits = np.array([0, 0, 1, ORDER]), np.array([0, 0, 8 + 6, 8 * ORDER + 9 + PRECISION * ORDER + 6])
    folded, plans = np.zeros((2, *x.shape), np.int64), []
    for which, residual in ((0, x[:, 1:] - x[:, :-1]), (1, x[:, ORDER:] - guess)):
        folded[which, :, BLOCK - residual.shape[1] :] = (residual << 1) ^ (residual >> 63)
        plans.append(partitions(folded[which], BLOCK - residual.shape[1]))
    use_linear = plans[1][2] + head_bits[3] < plans[0][2] + head_bits[2]
    kind = np.where((x == x[:, :1]).all(axis=1), 0, np.where(use_linear, 3, 2))
    folded = np.where(use_linear[:, None], folded[1], folded[0])
    split, rice, size = (np.where(use_linear[:, None] if u.ndim == 2 else use_linear, v, u) for u, v in zip(*plans, strict=True))
    kind = np.where((kind > 1) & (size + head_bits[kind] >= 8 * BLOCK), 1, kind)
    coded = (np.arange(BLOCK) >= order[kind][:, None]) & (kind > 1)[:, None]
    heads = [frame_header(n) for n in number.tolist()]
    head = np.array([len(h) for h in heads])
    body = 8 + np.select([kind == 0, kind == 1], [8, 8 * BLOCK], head_bits[kind] + size)
    length = head + (body + 7) // 8 + 2
    start = np.r_[0, np.cumsum(length)]
    bits = np.zeros(8 * int(start[-1]), np.uint8)
    at = 8 * (start[:-1] + head)
    put(bits, at, np.array([0b00000000, 0b00000010, 0b00010010, (0b100000 | ORDER - 1) << 1])[kind], 8)
    at = at + 8
    for i in range(ORDER):
        some = np.flatnonzero((order[kind] > i) | (kind == 0) & (i == 0))
        put(bits, at[some] + 8 * i, x[some, i] & 0xFF, 8)
    some = np.flatnonzero(kind == 1)
    if len(some):
        put(bits, (at[some][:, None] + 8 * np.arange(BLOCK)).ravel(), x[some].ravel() & 0xFF, 8)
    at = at + 8 * order[kind]
    some = np.flatnonzero(kind == 3)
    put(bits, at[some], np.full(len(some), PRECISION - 1), 4)
    put(bits, at[some] + 4, shift[some], 5)
    for j in range(ORDER):
        put(bits, at[some] + 9 + PRECISION * j, coef[some, j] & ((1 << PRECISION) - 1), PRECISION)
    at[some] += 9 + PRECISION * ORDER
    some = np.flatnonzero(kind > 1)
    put(bits, at[some] + 2, split[some], 4)  # method 0 is zeros
    span = (BLOCK >> split)[:, None]
    part = np.arange(BLOCK) // span
    k = np.take_along_axis(rice, part << (MOST_SPLIT - split)[:, None], axis=1)
    first = coded & ((np.arange(BLOCK) % span == 0) | (np.arange(BLOCK) == order[kind][:, None]))
    zeros = folded >> k
    width = np.where(coded, zeros + 1 + k + 4 * first, 0)
    spot = (at + 6)[:, None] + np.cumsum(width, axis=1) - width
    put(bits, spot[first], k[first], 4)
    spot = spot + 4 * first
    spot, zeros, k, low = spot[coded], zeros[coded], k[coded], folded[coded]
    one = spot + zeros
    bits[one] = 1
    for j in range(int(k.max()) if len(k) else 0):
        has = k > j
        bits[(one + k - j)[has]] = (low >> j & 1)[has]
    data = np.packbits(bits)
    for s, h in zip(start.tolist(), heads, strict=False):
        data[s : s + len(h)] = np.frombuffer(h, np.uint8)
    check = crc16(data, start[:-1], length - 2)
    data[start[1:] - 2], data[start[1:] - 1] = check >> 8, check & 0xFF
    out, frame = [], 0
    for payload, n in zip(payloads, counts, strict=True):
        sizes = length[frame : frame + n]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        out.append(b"fLaC" + bytes([0x80, 0, 0, 34]) + info + data[start[frame] : start[frame + n]].tobytes())
        frame += n
    return out


@dataclass
class Frame:
    stream: int
    start: int  # of the frame, in bytes
    body: int  # of its subframes
    end: int
    first: int | None  # sample, or None where the header has a frame number
    number: int
    size: int
    channels: int
    assignment: int
    bits: int


def read_frame_header(data: bytes, at: int, info: dict) -> Frame | None:
    """The frame header at a byte position, or None if there is none with a right checksum."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    size_code, rate_code, channel_code, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if size_code == 0 or rate_code == 15 or channel_code > 10 or bits_code == 3:
        return None
    pos, lead = at + 5, data[at + 4]
    more = next((i for i in range(8) if not lead >> 7 - i & 1), 8)
    if more == 1 or more == 8:
        return None
    number = lead & (0x7F >> more)
    for _ in range(max(0, more - 1)):
        if pos >= len(data) or data[pos] >> 6 != 2:
            return None
        number, pos = number << 6 | data[pos] & 63, pos + 1
    size = BLOCK_SIZES.get(size_code, 0)
    if size_code in (6, 7):
        size, pos = int.from_bytes(data[pos : pos + size_code - 5], "big") + 1, pos + size_code - 5
    pos += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if pos >= len(data) or crc8(data[at:pos]) != data[pos]:
        return None
    channels = channel_code + 1 if channel_code < 8 else 2
    return Frame(0, at, pos + 1, 0, number if data[at + 1] & 1 else None, number, size, channels, channel_code, SAMPLE_SIZES.get(bits_code, info["bits"]))


def read_metadata(data: bytes) -> tuple[dict, int]:
    """The stream's STREAMINFO, and where its frames begin."""
    if data[:4] != b"fLaC" or len(data) < 42 or data[4] & 0x7F:
        raise ValueError("not a FLAC stream")
    packed = int.from_bytes(data[18:26], "big")
    info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": data[26:42], "block": int.from_bytes(data[8:10], "big")}
    at = 4
    while True:
        last, length = data[at] >> 7, int.from_bytes(data[at + 1 : at + 4], "big")
        at += 4 + length
        if last:
            return info, at
        if at + 4 > len(data):
            raise ValueError("metadata end too soon")


def find_frames(streams: list[bytes]) -> tuple[list[dict], list[Frame], np.ndarray]:
    """The frames of all streams, each with a right checksum of header and frame, and all bytes in one array."""
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    infos, frames, base = [], [], 0
    chains: list[list[Frame]] = []
    for s, stream in enumerate(streams):
        info, at = read_metadata(stream)
        infos.append(info)
        part = data[base + at : base + len(stream)]
        marks = np.flatnonzero((part[:-1] == 0xFF) & (part[1:] & 0xFE == 0xF8)) + at if len(part) > 1 else []
        own = [f for m in marks for f in [read_frame_header(stream, int(m), info)] if f]
        if not own or own[0].start != at:
            if len(stream) > at:
                raise ValueError("no frame where frames begin")
        for f, g in zip(own, [*own[1:], None], strict=True):
            f.stream, f.end = s, g.start if g else len(stream)
            f.start, f.body, f.end = f.start + base, f.body + base, f.end + base
        chains.append(own)
        base += len(stream)
    every = [f for own in chains for f in own]
    right = crc16(data, np.array([f.start for f in every], np.int64), np.array([f.end - f.start for f in every], np.int64)) == 0 if every else []
    at = 0
    for own in chains:
        flags = right[at : at + len(own)]
        at += len(own)
        i = 0
        while i < len(own):
            f, j = own[i], i
            # A mark within a frame is no frame: the frame goes on to the next mark until its checksum is right.
            ok = bool(flags[i])
            while not ok and j + 1 < len(own):
                j += 1
                f.end = own[j].end
                ok = crc16(data, np.array([f.start]), np.array([f.end - f.start]))[0] == 0
            if not ok:
                raise ValueError("a frame's checksum is wrong")
            frames.append(f)
            i = j + 1
    return infos, frames, data


class Lanes:
    """Bit readers at one position each in a common array."""

    def __init__(self, data: np.ndarray):
        self.data = data
        wide = data.astype(np.int64)
        self.word = (wide[:-7] << 32) | (wide[1:-6] << 24) | (wide[2:-5] << 16) | (wide[3:-4] << 8) | wide[4:-3]
        bits = np.unpackbits(data)
        ones = np.where(bits == 1, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
        self.next_one = np.minimum.accumulate(ones[::-1])[::-1]

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned numbers of up to 32 bits."""
        return self.word[at >> 3] >> (40 - (at & 7) - width) & ((1 << width) - 1 if isinstance(width, int) else np.left_shift(1, width) - 1)

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        value = self.read(at, width)
        return value - (value >> width - 1 << width) if width else value


def read_residual(lanes: Lanes, at: np.ndarray, size: int, order: int, out: np.ndarray) -> np.ndarray:
    """Rice-coded residuals into out[:, order:]; returns where they end."""
    method, parts = lanes.read(at, 2), lanes.read(at + 2, 4)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    at = at + 6
    span, width = size >> parts, 4 + method
    k, raw = np.zeros(len(at), np.int64), np.full(len(at), -1)
    for i in range(order, size):
        new = np.flatnonzero((i % span == 0) | (i == order))
        if len(new):
            k[new] = lanes.read(at[new], width[new])
            at[new] += width[new]
            escaped = k[new] == np.left_shift(1, width[new]) - 1
            raw[new] = -1
            some = new[escaped]
            raw[some] = lanes.read(at[some], 5)
            at[some] += 5
            any_raw = bool((raw >= 0).any())
        one = lanes.next_one[at]
        low = one + 1
        value = (one - at).astype(np.int64) << k | lanes.read(low, k)
        value = (value >> 1) ^ -(value & 1)
        end = low + k
        if any_raw:
            some = raw >= 0
            n = np.maximum(raw, 0)
            plain = lanes.read(at, n)
            plain = np.where(n > 0, plain - (plain >> np.maximum(n - 1, 0) << n), 0)
            value, end = np.where(some, plain, value), np.where(some, at + n, end)
        out[:, i] = value
        at = end
    return at


def read_subframes(lanes: Lanes, at: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One subframe of each lane, lanes of one kind together: samples, and where they end."""
    out, ends = np.zeros((len(at), size), np.int64), np.zeros(len(at), np.int64)
    head = lanes.read(at, 8)
    kind, wasted = head >> 1 & 63, np.zeros(len(at), np.int64)
    at = at + 8
    some = np.flatnonzero(head & 1)
    wasted[some] = lanes.next_one[at[some]] - at[some] + 1
    at[some] += wasted[some]
    for code, waste in sorted(set(zip(kind.tolist(), wasted.tolist(), strict=True))):
        rows = np.flatnonzero((kind == code) & (wasted == waste))
        pos, depth = at[rows], bits - waste
        x = np.zeros((len(rows), size), np.int64)
        if code == 0:
            x[:] = lanes.signed(pos, depth)[:, None]
            pos = pos + depth
        elif code == 1:
            for i in range(size):
                x[:, i] = lanes.signed(pos + depth * i, depth)
            pos = pos + depth * size
        elif 8 <= code <= 12 or code >= 32:
            order = code - 8 if code < 32 else code - 31
            for i in range(order):
                x[:, i] = lanes.signed(pos + depth * i, depth)
            pos = pos + depth * order
            if code < 32:
                coef, shift = np.tile(np.array(FIXED[order], np.int64), (len(rows), 1)), np.zeros(len(rows), np.int64)
            else:
                precision, shift = lanes.read(pos, 4) + 1, lanes.signed(pos + 4, 5)
                if (shift < 0).any() or (precision == 16).any():
                    raise ValueError("unknown predictor")
                pos = pos + 9
                coef = np.zeros((len(rows), order), np.int64)
                for j in range(order):
                    value = lanes.read(pos, precision)
                    coef[:, j] = value - (value >> precision - 1 << precision)
                    pos = pos + precision
            pos = read_residual(lanes, pos, size, order, x)
            if order:
                y = np.ascontiguousarray(x.T)
                turned = np.ascontiguousarray(coef.T[::-1])
                for i in range(order, size):
                    y[i] += (turned * y[i - order : i]).sum(axis=0) >> shift
                x = y.T
        else:
            raise ValueError("reserved kind of subframe")
        out[rows], ends[rows] = x << waste, pos
    return out, ends


def decode(streams: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """(STREAMINFO, samples by channel) of each stream. ValueError when any checksum, length or digest is wrong."""
    infos, frames, data = find_frames(streams)
    lanes = Lanes(data)
    groups = defaultdict(list)
    for i, f in enumerate(frames):
        groups[f.size, f.channels, f.assignment, f.bits].append(i)
    parts: list[np.ndarray | None] = [None] * len(frames)
    for (size, channels, assignment, bits), members in groups.items():
        at = 8 * np.array([frames[i].body for i in members], np.int64)
        got = []
        for c in range(channels):
            side = (assignment, c) in ((8, 1), (9, 0), (10, 1))
            x, at = read_subframes(lanes, at, size, bits + side)
            got.append(x)
        if assignment == 8:
            got[1] = got[0] - got[1]
        elif assignment == 9:
            got[0] = got[0] + got[1]
        elif assignment == 10:
            mid = got[0] << 1 | got[1] & 1
            got = [mid + got[1] >> 1, mid - got[1] >> 1]
        if ((at + 7 >> 3) + 2 != np.array([frames[i].end for i in members])).any():
            raise ValueError("a frame's length is wrong")
        whole = np.stack(got, axis=1)
        for row, i in enumerate(members):
            parts[i] = whole[row]
    own: list[list[np.ndarray]] = [[] for _ in streams]
    for f, part in zip(frames, parts, strict=True):
        have = sum(p.shape[1] for p in own[f.stream]) if f.first is not None else None
        if f.first != have if f.first is not None else f.number != len(own[f.stream]):
            raise ValueError("frames are out of order")
        own[f.stream].append(part)
    out = []
    for info, got in zip(infos, own, strict=True):
        samples = np.concatenate(got, axis=1) if got else np.zeros((info["channels"], 0), np.int64)
        if samples.shape[1] != info["samples"] and info["samples"]:
            raise ValueError("samples are missing")
        width = (info["bits"] + 7) // 8
        if info["md5"] != bytes(16) and hashlib.md5(samples.T.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()).digest() != info["md5"]:
            raise ValueError("the digest is wrong")
        out.append((info, samples))
    return out


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "replace")
    return data + b"\xff" * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def runs(values: list, size, most: int = 1 << 20) -> Iterator[list]:
    """Slices of bounded total size, or single large values."""
    part, total = [], 0
    for v in values:
        if part and total + size(v) > most:
            yield part
            part, total = [], 0
        part.append(v)
        total += size(v)
    if part:
        yield part


@F.arrow_udf(T.BinaryType())
def flac_of_text(texts: pa.Array) -> pa.Array:
    return pa.array([m for part in runs([payload_of(t) for t in texts.to_pylist()], len) for m in encode(part)], pa.binary())


def encode_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, the length of the text in UTF-8, and media, its FLAC stream; columns of these names are replaced.

    A text's bytes are filled up with bytes 255 to a positive multiple of BLOCK. Null counts as empty.
    """
    return docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "media": flac_of_text(text_col)})


def pcm_blocks(table: DataFrame, id_col: str = "doc_id", media_col: str = "media", block: int = PCM_BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep, first_sample, n_samples, pcm) rows: up to `block` samples of each stream, channels interleaved, in
    whole little-endian bytes. The block with sample i starts at i // block * block, so a reader can seek by a filter.
    A stream's blocks come one after another. Null media are left out; keep names columns to carry along with each
    stream's first block, null in the others."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, media in text_slices(batch, "_media", 1 << 20):
                held = [i for i, m in enumerate(media) if m is not None]
                of, starts, sizes, pcm = [], [], [], []
                for i, (info, x) in zip(held, decode([media[i] for i in held]), strict=True):
                    width = (info["bits"] + 7) // 8
                    raw = x.T.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
                    step = block * width * info["channels"]
                    for at in range(0, len(raw), step):
                        of.append(first + i)
                        starts.append(at // step * block)
                        sizes.append(min(block, x.shape[1] - starts[-1]))
                        pcm.append(raw[at : at + step])
                rows = pa.array(of, pa.int64())
                once = pa.array([i if at == 0 else None for i, at in zip(of, starts, strict=True)], pa.int64())
                names = {"_id": batch.column("_id").take(rows)} | {c: batch.column(c).take(once) for c in keep}
                yield pa.record_batch(names | {"first_sample": pa.array(starts, pa.int64()), "n_samples": pa.array(sizes, pa.int64()), "pcm": pa.array(pcm, pa.binary())})

    rows = table.select(F.col(id_col).alias("_id"), *keep, F.col(media_col).alias("_media"))
    carried = [T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]]
    added = [T.StructField("first_sample", T.LongType()), T.StructField("n_samples", T.LongType()), T.StructField("pcm", T.BinaryType())]
    return rows.mapInArrow(blocks, T.StructType([*carried, *added])).withColumnRenamed("_id", id_col)


@dataclass
class Digest:
    """What is known of a stream of 8-bit samples after the blocks so far."""

    sha: object
    n: int = 0
    total: int = 0
    squares: int = 0
    crossings: int = 0
    peak: int = 0
    last: bytes = b""

    def add(self, pcm: bytes) -> None:
        x = np.frombuffer(pcm, np.int8).astype(np.int64)
        if not len(x):
            return
        self.sha.update((np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes())
        signs = x < 0
        before = np.frombuffer(self.last[-1:], np.int8) < 0
        self.crossings += int(np.count_nonzero(signs[1:] != signs[:-1])) + int(len(before) and before[0] != signs[0])
        self.n, self.total, self.squares, self.peak = self.n + len(x), self.total + int(x.sum()), self.squares + int((x * x).sum()), max(self.peak, int(np.abs(x).max()))
        self.last = (self.last + pcm[-32:])[-32:]

    def row(self) -> tuple:
        tail = (np.frombuffer(self.last, np.uint8) ^ 0x80).tobytes()
        return self.n, self.sha.hexdigest(), zlib.crc32(tail), f"n={self.n} sum={self.total} squares={self.squares} crossings={self.crossings} peak={self.peak}"


DIGEST = {"payload_bytes": (T.LongType(), pa.int64()), "payload_sha256": (T.StringType(), pa.string()), "tail_crc32": (T.LongType(), pa.int64()), "feature": (T.StringType(), pa.string())}


def digest_blocks(blocks: DataFrame) -> DataFrame:
    """A row for each stream of 8-bit mono blocks as pcm_blocks gives them, one after another: its own columns, the size,
    SHA-256 and tail's CRC-32 of the payload, and a feature: number of samples, sum, sum of squares, sign changes, peak.

    The blocks of a stream follow one another by first_sample; ValueError where they do not, as after a shuffle.
    """
    keep = [f for f in blocks.schema.fields if f.name not in ("first_sample", "n_samples", "pcm")]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None

        def done(rows: list[tuple], columns: list[pa.Table]) -> pa.RecordBatch:
            held = pa.concat_tables(columns).combine_chunks()
            found = {n: pa.array(c, k) for (n, (_, k)), c in zip(DIGEST.items(), zip(*rows, strict=True), strict=True)}
            return pa.record_batch({f.name: held.column(f.name).chunk(0) for f in keep} | found)

        for batch in batches:
            rows, columns = [], []
            table = pa.Table.from_batches([batch]).select([f.name for f in keep])
            starts, pcm = batch.column("first_sample").to_pylist(), batch.column("pcm")
            for i, start in enumerate(starts):
                if start == 0:
                    if now is not None:
                        rows.append(now.row())
                        columns.append(own)
                    now, own = Digest(hashlib.sha256()), table.slice(i, 1)
                if now is None or start != now.n:
                    raise ValueError(f"a block begins at sample {start}, after {now.n if now else 0} samples of its stream")
                now.add(pcm[i].as_py())
            if rows:
                yield done(rows, columns)
        if now is not None:
            yield done([now.row()], [own])

    return blocks.mapInArrow(digests, T.StructType([*keep, *[T.StructField(n, k) for n, (k, _) in DIGEST.items()]]))


def digest_media(table: DataFrame, media_col: str = "media") -> DataFrame:
    """table with media_bytes and media_sha256 of the stored streams, and what digest_blocks tells of their samples, for 8-bit mono streams; nulls for null media. Columns of these names are replaced."""
    names = [c for c in table.columns if c not in {"media_bytes", "media_sha256", *DIGEST}]
    stored = table.select(*names).withColumns({"media_bytes": F.octet_length(media_col).cast("long"), "media_sha256": F.sha2(media_col, 256)})
    held = stored.filter(F.col(media_col).isNotNull())
    found = digest_blocks(pcm_blocks(held.withColumn("_number", F.lit(0)), "_number", media_col, keep=tuple(stored.columns))).drop("_number")
    none = stored.filter(F.col(media_col).isNull()).select("*", *[F.lit(None).cast(k).alias(n) for n, (k, _) in DIGEST.items()])
    return found.unionByName(none)
