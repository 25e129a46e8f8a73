"""Operators on documents against brute force, on awkward rows and on none."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

from anchorage.llm import bpe, jpeg, minhash, mixing, ngram_lm, quality, sharding, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def key(row) -> tuple:
    return (row[0] is None, row[0] or 0, row[1] or "")


def test_sharding(spark, docs, rows, nothing):
    got = sharding.shard_documents(docs, 4, 64).collect()
    assert len(got) == len(rows)
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(nothing).collect() == []


def test_slot_map_versions(spark, tmp_path):
    sizes = {slot: (slot % 13 + 1) * 1000 for slot in range(512)}
    first = sharding.SlotMap.initial(512, 8)
    second = first.rebalanced(sizes)
    loads = Counter()
    for slot, shard in enumerate(second.current):
        loads[shard] += sizes[slot]
    assert max(loads.values()) - min(loads.values()) <= 1000
    assert second.versions[0] == first.current
    assert sum(a != b for a, b in zip(first.current, second.current, strict=True)) < 200
    third = second.rebalanced(sizes, 9)
    moved = [k for k, (a, b) in enumerate(zip(second.current, third.current, strict=True)) if a != b]
    assert len(moved) < 512 / 9 + 9 * sharding.FINE_SLOTS + 9
    third.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == third


def test_media(docs, rows, nothing):
    got = {(r.doc_id, r.payload_sha256): r for r in jpeg.media_digests(docs).collect()}
    for r in rows:
        text = (r[1] or "").encode()
        payload = text + b"\xff" * ((-len(text)) % 576 if text else 576)
        row = got[r[0], hashlib.sha256(payload).hexdigest()]
        stored = jpeg.encode_payload(text)
        assert (row.n_bytes, row.payload_bytes, row.tail_crc32) == (len(text), len(payload), zlib.crc32(payload[-32:]))
        assert (row.media_bytes, row.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert jpeg.media_digests(nothing).collect() == []


def test_quality(docs, rows, nothing):
    got = defaultdict(list)
    for r in quality.quality_rules(docs).collect():
        got[r.doc_id].append(r)
    for r in rows:
        text = r[1] or ""
        found = WORD.findall(text)
        n = len(found)
        grams = Counter(zip(found, found[1:], found[2:], strict=False))
        covered = {i + j for i in range(n - 2) if grams[tuple(found[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        row = got[r[0]][0]
        assert row.n_words == n and row.word_chars == sum(map(len, found)) and row.n_repeat_words == len(covered)
        assert row.n_dup_lines == len(lines) - len(set(lines)) and row.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        failed = n < 50 or 100 * len(covered) > 50 * n
        assert row.base_failed == failed and not (failed and row.kept)
    assert quality.quality_rules(nothing).collect() == []
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(x.kept for many in got.values() for x in many)
    assert quality.kept_documents(nothing).count() == 0


def test_quality_bands():
    import random

    r = random.Random(1)
    prose = " ".join("".join(r.choice("etaoin shrdlu") for _ in range(6)) for _ in range(2000)).encode()
    packed = bytes(r.randrange(256) for _ in range(12_000))
    z = quality.zstandard.ZstdCompressor(level=1)
    assert quality.compression(memoryview(prose), quality.Bands(), z)[2]
    assert not quality.compression(memoryview(packed), quality.Bands(), z)[2]
    assert not quality.compression(memoryview(b"the same again " * 900), quality.Bands(), z)[2]
    assert quality.compression(memoryview(b""), quality.Bands(), z) == (0.0, 0.0, False)


def shingle_set(text: str | None) -> frozenset:
    found = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*[found[k:] for k in range(5)], strict=False)) if len(found) >= 5 else frozenset([tuple(found)] if found else [])


def components(rows) -> dict:
    sets = sorted({(r[0], shingle_set(r[1])) for r in rows if r[0] is not None}, key=lambda x: x[0])
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in parent}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(docs, rows, nothing, block):
    params = minhash.Params(block_documents=block)
    expected = components(rows)
    got = minhash.near_duplicates(docs, params).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (expected[r.doc_id], r.doc_id == expected[r.doc_id])
    assert sorted((r.doc_id or 0, r.n_shingles) for r in got) == sorted((r[0] or 0, len(shingle_set(r[1]))) for r in rows)
    if block == 1024:
        assert minhash.near_duplicates(nothing).collect() == []
        kept = minhash.kept_documents(docs)
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
        assert sorted(ids) == sorted({d for d, c in expected.items() if d == c})


def test_signatures_estimate_similarity():
    import numpy as np

    r = np.random.default_rng(1)
    both = r.integers(0, 1 << 62, 800).astype(np.uint64)
    a = minhash.signature(np.concatenate((both, r.integers(0, 1 << 62, 200).astype(np.uint64))), 2000)
    b = minhash.signature(np.concatenate((both, r.integers(0, 1 << 62, 200).astype(np.uint64))), 2000)
    assert abs((a == b).mean() - 800 / 1200) < 0.04


def removed(rows):
    texts = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    first: dict[tuple, int] = {}
    for d, w in texts:
        if d is not None:
            for k in range(len(w) - 49):
                run = tuple(w[k : k + 50])
                first[run] = min(first.get(run, d), d)
    for d, w in texts:
        keep = [True] * len(w)
        for k in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[k : k + 50])] < d:
                keep[k : k + 50] = [False] * 50
        yield d, len(w), [x for x, ok in zip(w, keep, strict=True) if ok]


def test_substring_dedup(docs, rows, nothing):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs).collect())
    expected = Counter((d, n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for d, n, kept in removed(rows))
    assert got == expected and sum(c for (_, _, gone, _), c in expected.items() if gone) > 5
    assert substring.digests(nothing).collect() == []
    shorter = substring.deduplicated(docs)
    assert shorter.columns == docs.columns and shorter.schema.simpleString() == docs.schema.simpleString()
    texts = Counter((r.doc_id, r.text) for r in shorter.collect())
    kept = [(r[0], r[1] if n == len(k) else " ".join(k)) for r, (_, n, k) in zip(rows, removed(rows), strict=True)]
    assert texts == Counter(kept)
    assert substring.deduplicated(nothing).count() == 0


def test_lm_scores(docs, rows, nothing):
    counts: Counter = Counter()
    tokens = [(r[0], [*WORD.findall((r[1] or "").translate(LOWER)), None]) for r in rows]
    held = lambda d: zlib.crc32(str(d if d is not None else "").encode()) % 10 == 0
    for d, t in tokens:
        if not held(d):
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for head in (1 << 18, 5):
        got = defaultdict(list)
        for r in ngram_lm.scores(docs, ngram_lm.Params(head_words=head)).collect():
            got[r.doc_id, r.n_tokens].append(r)
        for d, t in tokens:
            base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
            assert any(
                abs(r.base_score - base) < 1e-6 * abs(base) and (r.held_out, r.n_known, r.train_tokens) == (held(d), sum(x in counts for x in t), n)
                for r in got[d, len(t)]
            )
            assert all(r.score <= 0 for r in got[d, len(t)])
    assert ngram_lm.scores(nothing).collect() == []


def test_log_bloom(spark):
    import numpy as np

    keys = np.random.default_rng(3).integers(0, 1 << 62, 20_000) * 2
    n = np.random.default_rng(4).geometric(0.05, 20_000)
    found = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys[:10_000], n, strict=False)], "key long, n long")
    bloom, levels = ngram_lm.build(found, ngram_lm.Params())
    got = bloom.levels(keys.astype(np.uint64))
    least, most = bloom.least(got[:10_000]), bloom.most(got[:10_000])
    assert (most >= n[:10_000]).all()  # never too low
    assert ((least <= n[:10_000]).mean()) > 0.95
    assert (got[10_000:] > 0).mean() < 0.04
    assert sum(c for c, _ in levels.values()) == 10_000
    tight, _ = ngram_lm.build(found, ngram_lm.Params(max_bits=1 << 20, bits_per_event=40))
    assert tight.skip[0] > 0 and len(tight.segments) == 1


def mix_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        share = (total - sum(fixed.values())) / max(sum(weight[s] for s in rest), 1)
        over = [s for s in rest if share * weight[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **{s: share * weight[s] for s in rest}}
        fixed.update({s: 2.0 * sizes[s] for s in over})


def nearest(sizes: list[int], goal: float) -> float:
    """How near to a goal the words of up to two copies of each document can come."""
    able = 1
    for size in sizes:
        able |= able << size | able << 2 * size
    return min(abs(k - goal) for k in range(able.bit_length()) if able >> k & 1)


def test_mixing(docs, rows, nothing):
    got = mixing.mixed(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    goals, taken = mix_targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goals[r.source]) < 1e-6 * max(1, goals[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= max(60, 0.01 * goals[s])
    assert sorted(map(str, mixing.mixed(docs.repartition(2)).collect())) == sorted(map(str, got))
    assert mixing.mixed(nothing).collect() == []
    mixture = mixing.mixture(docs)
    assert mixture.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in mixture.collect()) == sum(taken.values())
    assert mixing.mixture(nothing).count() == 0


def test_bpe(docs, rows, nothing):
    path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {(r.doc_id, r.decoded_sha256): r for r in bpe.encoded(docs, path, public_tokenizers.PATTERN, with_ids=True).collect()}
    for r in rows:
        text = r[1] or ""
        row, ids = got[r[0], hashlib.sha256(text.encode()).hexdigest()], library.encode_ordinary(text)
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest()
    assert bpe.encoded(nothing, path, public_tokenizers.PATTERN).collect() == []
