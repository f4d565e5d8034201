import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from ledgerloom.llm import flac as X


class Writer:
    """A plain bit writer, for streams with features that the encoder does not use."""

    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> (width - 1 - i)) & 1 for i in range(width)]

    def bytes(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


def plain_crc(data, polynomial, width):
    value = 0
    for b in data:
        value ^= b << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ polynomial if value >> (width - 1) & 1 else value << 1) & ((1 << width) - 1)
    return value


def subframe(w, x, bits, rng):
    waste = 0
    if all(v % 4 == 0 for v in x) and any(x):
        waste, x, bits = 2, [v // 4 for v in x], bits - 2
    kind = rng.choice(["verbatim", "fixed", "lpc"]) if len(set(x)) > 1 else "constant"
    order = rng.randrange(5) if kind == "fixed" else rng.randrange(1, 9)
    w.put({"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[kind] << 1 | (waste > 0), 8)
    if waste:
        w.put(1, waste)
    if kind == "constant":
        return w.put(x[0], bits)
    if kind == "verbatim":
        return [w.put(v, bits) for v in x]
    for v in x[:order]:
        w.put(v, bits)
    coef, shift = list(X.FIXED[order]) if kind == "fixed" else [rng.randrange(-30, 31) for _ in range(order)], 0
    if kind == "lpc":
        shift = 5
        w.put(9, 4), w.put(shift, 5)
        for c in coef:
            w.put(c, 10)
    residual = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coef)) >> shift) for i in range(order, len(x))]
    method = rng.randrange(2)
    parts = rng.choice([p for p in range(4) if len(x) % (1 << p) == 0 and len(x) >> p > order])
    w.put(method, 2), w.put(parts, 4)
    span = len(x) >> parts
    for p in range(1 << parts):
        own = residual[max(0, p * span - order) : (p + 1) * span - order]
        if rng.random() < 0.3:
            n = max((v.bit_length() + 1 if v >= 0 else (~v).bit_length() + 1) for v in own) if any(own) else 0
            w.put((1 << 4 + method) - 1, 4 + method), w.put(n, 5)
            for v in own:
                w.put(v, n)
            continue
        k = min(14, max(0, int(np.mean(np.abs(own)) + 1).bit_length()))
        w.put(k, 4 + method)
        for v in own:
            u = v << 1 if v >= 0 else (-v << 1) - 1
            w.put(0, u >> k), w.put(1, 1), w.put(u, k)


def plain_stream(channels, bits, size, rng, assignment=None):
    out, at = b"", 0
    number = 0
    n = len(channels[0])
    while at < n:
        own = [c[at : at + size] for c in channels]
        head = Writer()
        head.put(0b111111111111100, 15), head.put(0, 1), head.put(7, 4), head.put(0, 4)
        head.put(len(channels) - 1 if assignment is None else assignment, 4), head.put(0, 4)
        head.put(number, 8) if number < 128 else (head.put(0xC0 | number >> 6, 8), head.put(0x80 | number & 63, 8))
        head.put(len(own[0]) - 1, 16)
        data = head.bytes()
        data += bytes([plain_crc(data, 7, 8)])
        w = Writer()
        extra = [0, 0]
        if assignment is not None:
            left, right = own
            side = [a - b for a, b in zip(left, right, strict=True)]
            mid = [a + b >> 1 for a, b in zip(left, right, strict=True)]
            own, extra = {8: ([left, side], [0, 1]), 9: ([side, right], [1, 0]), 10: ([mid, side], [0, 1])}[assignment]
        for c, x in enumerate(own):
            subframe(w, x, bits + (extra[c] if assignment is not None else 0), rng)
        data += w.bytes()
        out += data + plain_crc(data, 0x8005, 16).to_bytes(2, "big")
        at, number = at + size, number + 1
    width = (bits + 7) // 8
    raw = b"".join(v.to_bytes(width, "little", signed=True) for row in zip(*channels, strict=True) for v in row)
    info = struct.pack(">HH", size, size) + bytes(6) + (44100 << 44 | len(channels) - 1 << 41 | bits - 1 << 36 | n).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC" + bytes([0, 0, 0, 34]) + info + bytes([0x84, 0, 0, 4]) + b"note" + out, raw


@pytest.mark.parametrize("assignment", [None, 8, 9, 10])
@pytest.mark.parametrize("bits", [8, 12, 16, 24])
def test_decoder_reads_streams_of_a_plain_writer(bits, assignment):
    rng = random.Random(bits)
    top = 1 << bits - 1
    for n in (64, 400, 1033):
        wave = [int(0.6 * top * np.sin(i / 9) + rng.randrange(-9, 9)) for i in range(n)]
        other = [4 * (v // 5) for v in wave]
        channels = [wave, other] if assignment else rng.choice([[wave], [wave, other, [3] * n]])
        stream, raw = plain_stream(channels, bits, 64, rng, assignment)
        (info, samples), (_, again) = X.decode([stream, stream])
        assert info["bits"] == bits and info["channels"] == len(channels)
        assert samples.tolist() == channels and again.tolist() == channels


def payloads():
    rng = np.random.default_rng(1)
    text = ("Some plain text, éè 123.\n" * 400).encode()
    out = [b"\xff" * 576, b"\0" * 1152, rng.bytes(576 * 5), text[: 576 * 9], bytes(range(256)) * 9 * 3, b"\xff\xf8\x24\x02" * 144 * 3]
    return [*out, rng.integers(90, 120, 576 * 140, dtype=np.uint8).tobytes()]


def test_round_trip_and_equal_values_in_any_batch():
    items = payloads()
    streams = X.encode(items)
    assert streams == [X.encode([p])[0] for p in items]
    for (info, samples), p, s in zip(X.decode(streams), items, streams, strict=True):
        assert info["samples"] == len(p) and info["bits"] == 8
        assert (samples[0] + 128).astype(np.uint8).tobytes() == p
        assert len(s) < len(p) * 1.05 + 200
    assert X.encode([]) == [] and X.decode([]) == []


def test_damage_is_found():
    stream = X.encode([payloads()[3]])[0]
    rng = random.Random(2)
    for _ in range(60):
        at = rng.randrange(42, len(stream))
        bad = stream[:at] + bytes([stream[at] ^ 1 << rng.randrange(8)]) + stream[at + 1 :]
        with pytest.raises(ValueError):
            X.decode([bad])
    for bad in (stream[:-1], stream[:-400], b"RIFF" + stream[4:], stream + b"x", stream[:26] + bytes([stream[26] ^ 1]) + stream[27:]):
        with pytest.raises(ValueError):
            X.decode([bad])


def test_media_columns(spark, tmp_path):
    texts = [None, "", "short", "é" * 288, "x" * 576, "long text é " * 9000, "short"]
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)] + [(None, "no id", "other")], "doc_id bigint, text string, media string")
    X.encode_media(docs).write.parquet(str(tmp_path / "media"))
    table = spark.read.parquet(str(tmp_path / "media"))
    out = {r["doc_id"]: r for r in X.digest_media(table).collect()}
    blocks = {}
    for r in sorted(X.pcm_blocks(table).collect(), key=lambda r: r["first_sample"]):
        assert r["first_sample"] % X.PCM_BLOCK == 0 and r["n_samples"] == len(r["pcm"])
        blocks[r["doc_id"]] = blocks.get(r["doc_id"], b"") + r["pcm"]
    for i, t in [*enumerate(texts), (None, "no id")]:
        data = (t or "").encode()
        p = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert (np.frombuffer(blocks[i], np.int8).astype(int) + 128).astype(np.uint8).tobytes() == p
    assert out[2]["media_sha256"] == out[6]["media_sha256"] and out[2]["feature"] == out[6]["feature"]
    assert X.digest_media(table.limit(0)).count() == 0
    assert X.digest_media(spark.createDataFrame([(1, None)], "doc_id int, media binary")).first()["payload_bytes"] is None


def test_query_stores_the_media_and_reads_them_back(spark):
    from ledgerloom.llm import queries

    from ..conftest import SF

    files = queries.op9_flac_media(spark, SF).inputFiles()
    assert files and all("/media-" in f for f in files)
