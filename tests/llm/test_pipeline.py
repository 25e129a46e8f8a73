"""The pipeline's stages one after the other against brute force, and the registered queries."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from anchorage.llm import bpe, quality
from anchorage.llm.queries import ORACLES, QUERIES

from tests.llm.test_documents import WORD, components, mix_targets, nearest, removed


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, docs, rows, tmp_path):
    now, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = as_rows(now)
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert now.columns == columns
        after = as_rows(now)
        if name == "quality_rules":
            z = quality.zstandard.ZstdCompressor(level=1)
            keep = []
            for r in before:
                text = (r[1] or "").encode()
                n, *_, again = quality.text_statistics(memoryview(text))
                keep += [r] if n >= 50 and 100 * again <= 50 * n and quality.compression(memoryview(text), quality.Bands(), z)[2] else []
            assert Counter(after) == Counter(keep) and 0 < len(keep) < len(before)
        elif name == "near_dedup":
            expected = components(before)
            assert Counter(after) == Counter({r for r in before if r[0] is None or expected[r[0]] == r[0]}) and len(after) < len(before)
        elif name == "substring_dedup":
            shorter = [(r[0], " ".join(kept) if len(kept) < n else r[1]) for r, (_, n, kept) in zip(before, removed(before), strict=True)]
            assert Counter((r[0], r[1], len(r[1])) for r in after) == Counter((d, t, len(t)) for d, t in shorter)
        elif name == "mix_sources":
            sizes, taken, copies = Counter(), Counter(), Counter(after)
            for r in before:
                sizes[r[3]] += len(WORD.findall(r[1]))
            for r in after:
                taken[r[3]] += len(WORD.findall(r[1]))
            assert set(copies) <= set(before) and all(n <= 2 * before.count(r) for r, n in copies.items())
            goals = mix_targets(sizes)
            for s in sizes:
                best = nearest([len(WORD.findall(r[1])) for r in before if r[3] == s], goals[s])
                assert abs(taken[s] - goals[s]) <= 1.5 * best + max(60, 0.01 * goals[s])
        else:
            path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
            library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
            want = Counter((r[0], tuple(library.encode_ordinary(r[1])), hashlib.sha256(r[1].encode()).hexdigest()) for r in before)
            assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in now.collect()) == want


def test_stages_on_nothing(spark, nothing):
    now = nothing
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0


def test_run_reads_documents(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("k", range(1, 11))
def test_queries_are_registered(k):
    assert sum(name.startswith(f"op{k}_") for name in QUERIES) == 1
    assert set(ORACLES) <= set(QUERIES)
