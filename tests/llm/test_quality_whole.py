"""Every byte of a text is in a judged chunk."""

from __future__ import annotations

import math
import random

from anchorage.llm import quality
from tests.llm.conftest import awkward, prose


def test_short_last_piece_is_judged():
    r = random.Random(1)
    first = " ".join("".join(r.choice("etaoin shrdlu") for _ in range(6)) for _ in range(800)).encode()[:4096]
    text = first + bytes(r.randrange(256) for _ in range(2000))
    z = quality.zstandard.ZstdCompressor(level=1)
    alone, whole = len(first) / len(z.compress(first)), len(text) / len(z.compress(text))
    assert alone > whole
    assert quality.compression(memoryview(text), quality.Bands(chunk_least=(alone + whole) / 2), z)[1] == 1.0


def judged(text: bytes, bands: quality.Bands) -> tuple[float, float, bool]:
    """The bands by their description, one step after the other."""
    z = quality.zstandard.ZstdCompressor(level=1)

    def ratio(part: bytes) -> float:
        return len(part) / len(z.compress(part))

    def limits(size: int) -> tuple[float, float]:
        rows = bands.whole
        if size <= rows[0][0]:
            return rows[0][1:]
        for (a, low, high), (b, more_low, more_high) in zip(rows, rows[1:], strict=False):
            if a <= size <= b:
                part = math.log(size / a) / math.log(b / a)
                return low + part * (more_low - low), high + part * (more_high - high)
        return rows[-1][1:]

    if not text:
        return 0.0, 0.0, False
    low, high = limits(len(text))
    pieces = [text[k : k + 4096] for k in range(0, len(text), 4096)] if len(text) > 4096 else []
    if len(pieces) > 1 and len(pieces[-1]) <= 2048:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    bad = 0
    for piece in pieces:
        a, b = limits(len(piece))
        bad += not max(bands.chunk_least, 0.85 * a) <= ratio(piece) <= min(bands.chunk_most, 1.15 * b)
    share = bad / len(pieces) if pieces else 0.0
    return ratio(text), share, low <= ratio(text) <= high and share <= 0.5


def planted(r: random.Random) -> dict[str, list[str]]:
    sizes = (80, 200, 700, 2_000, 9_000)
    sentence = prose(r, 12)
    return {
        "prose": [prose(r, n) for n in sizes],
        # No three words come back to back twice in the same order more often than the base rule allows.
        "repetitive": [" ".join(f"{w} item{k % 7}" for k, w in enumerate(r.choices(sentence.split()[:5], k=n // 2))) for n in sizes],
        "random": [" ".join("".join(chr(r.randrange(33, 127)) for _ in range(7)) for _ in range(n)) for n in sizes],
        # Good at both ends and random between.
        "half random": [prose(r, 300) + " " + " ".join("".join(chr(r.randrange(33, 127)) for _ in range(7)) for _ in range(2_000)) + " " + prose(r, 300)],
    }


def test_bands_against_a_plain_version(spark):
    r = random.Random(12)
    kinds = planted(r)
    texts = [(kind, t) for kind, many in kinds.items() for t in many]
    texts += [("any", row[1] or "") for row in awkward()]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in quality.quality_rules(docs).collect()}
    kept = {kind: 0 for kind in (*kinds, "any")}
    for k, (kind, text) in enumerate(texts):
        ratio, share, inside = judged(text.encode(), quality.Bands())
        assert abs(got[k].ratio - ratio) < 1e-9 and abs(got[k].bad_chunk_share - share) < 1e-9
        assert got[k].kept == (inside and not got[k].base_failed)
        kept[kind] += got[k].kept
    assert kept["prose"] == len(kinds["prose"])
    assert kept["repetitive"] == kept["random"] == kept["half random"] == 0
    assert not any(got[k].base_failed for k, (kind, _) in enumerate(texts) if kind == "random")


def test_limits_follow_the_length():
    bands = quality.Bands()
    before = (0.0, 0.0)
    for size in (0, 1, 128, 200, 300, 1_000, 5_000, 50_000, 10**6, 10**8):
        least, most = bands.limits(size)
        assert before[0] <= least < most and before[1] <= most
        before = least, most
    assert bands.chunk_limits(4096)[0] < bands.limits(4096)[0] and bands.chunk_limits(4096)[1] > bands.limits(4096)[1]
