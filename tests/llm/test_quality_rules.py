import base64
import random
import re

import zstandard

from ledgerloom.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def samples():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randrange(2, 9))) for _ in range(600)]
    prose = " ".join(rng.choices(vocabulary, k=400))
    return {
        "null": None, "empty": "", "blank": " \n\t\n", "short": "too few words", "prose": prose, "lines": "one line\none line\n\n one line\n" + prose,
        "looped": " ".join(rng.choices(vocabulary, k=10)) * 30, "few repeats": prose + " " + prose[:200], "symbols": prose.replace(" ", "### "),
        "packed": " ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(120)), "near loop": " ".join(f"{i % 3}aaaa{i}aaaa" for i in range(900)),
        "odd blanks": "a\x0bb\x0cc\x1cd e " * 20, "long": " ".join(rng.choices(vocabulary, k=60_000)),
    }


def test_matches_brute_force(spark):
    cases = samples()
    docs = spark.createDataFrame([(k, v, "x") for k, v in cases.items()] + [("null", None, "y")], "name string, text string, kept string")
    out = {r["name"]: r for r in Q.quality_rules(docs).collect()}
    for name, text in cases.items():
        r = out[name]
        if name != "long":
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), name
        if text:
            data = text.encode()
            assert r["zstd_ratio"] == len(zstandard.ZstdCompressor(level=Q.LEVEL).compress(data)) / len(data)
    kept = {k for k, r in out.items() if r["kept"]}
    assert kept == {"prose", "lines", "few repeats", "symbols", "long"}
    assert Q.quality_rules(docs.limit(0)).count() == 0


def test_chunks_cover_whole_texts_and_decide(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choices(vocabulary, k=4000))
    noise = base64.b85encode(rng.randbytes(9000)).decode()
    texts = {"prose": prose[:9000], "noise in the tail": prose[:4500] + " " + noise[:3500], "one": prose[:4096], "one more": prose[:4097], "short": prose[:900], "noise": (prose[:1000] + " " + noise), "null": None, "empty": ""}
    out = {r["name"]: r for r in Q.quality_rules(spark.createDataFrame(list(texts.items()), "name string, text string")).collect()}
    for name, text in texts.items():
        data = (text or "").encode()
        starts = [0] if 0 < len(data) <= Q.CHUNK else sorted({*range(0, len(data) - Q.CHUNK, Q.CHUNK), len(data) - Q.CHUNK}) if data else []
        parts = [data[i : i + Q.CHUNK] for i in starts]
        assert sum(map(len, parts)) >= len(data) and (not parts or data.endswith(parts[-1]))
        compress = zstandard.ZstdCompressor(level=Q.LEVEL).compress
        limits = [Q.CHUNK_BAND if len(p) == Q.CHUNK else next((a, b) for most, a, b in Q.BANDS if len(p) <= most) for p in parts]
        odd = sum(not a <= len(compress(p)) / len(p) <= b for p, (a, b) in zip(parts, limits, strict=True))
        assert (out[name]["n_chunks"], out[name]["n_chunks_out"]) == (len(parts), odd), name
        whole = next((a, b) for most, a, b in Q.BANDS if len(data) <= most)
        fits = bool(data) and whole[0] <= len(compress(data)) / len(data) <= whole[1]
        assert out[name]["kept"] == (not out[name]["base_failed"] and fits and 2 * odd <= len(parts)), name
    assert out["noise in the tail"]["n_chunks_out"] == 1 and out["noise"]["n_chunks_out"] >= 2 and not out["noise"]["kept"]
    assert out["prose"]["kept"] and out["one"]["kept"] and out["one more"]["n_chunks"] == 2
