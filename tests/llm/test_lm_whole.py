"""The language model holds all counts, whatever fits the filter, and is a probability."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from anchorage.llm import ngram_lm
from tests.llm.conftest import words

FULL = ngram_lm.Params(bits_per_event=400, head_words=5)
TIGHT = ngram_lm.Params(bits_per_event=400, head_words=5, max_bits=1 << 18)


def corpus() -> list[tuple]:
    r = random.Random(5)
    vocabulary = sorted(set(words(r, 1500)))
    texts = [" ".join(vocabulary[min(int(r.expovariate(0.01)), len(vocabulary) - 1)] for _ in range(60)) for _ in range(200)]
    return list(enumerate(texts))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    return [{r.doc_id: r.score for r in ngram_lm.scores(docs, p).collect()} for p in (FULL, TIGHT)]


def test_scores_do_not_depend_on_what_fits_the_filter(scored):
    full, tight = scored
    assert max(abs(tight[k] - full[k]) / abs(full[k]) for k in full) < 1e-3


def test_words_are_a_distribution():
    bloom = ngram_lm.LogBloom(np.zeros((1, 1), np.uint64), (0, 1), 5, 1.5)
    for levels in ({1: (500, 500), 2: (90, 180), 9: (3, 100)}, {1: (2, 2), 2: (5, 10)}, {3: (4, 12)}, {}):
        word, types = ngram_lm.word_probabilities(levels, bloom)
        assert abs(types * word[0] + sum(c * word[lv] for lv, (c, _) in levels.items()) - 1) < 1e-9
        assert word[0] <= word[1] or not levels


def test_scores_by_exact_levels(scored):
    """Brute force, with pairs seen once counted."""
    one, two = Counter(), Counter()
    docs = {k: [None, *t.split(), None] for k, t in corpus()}
    for k, t in docs.items():
        if not held_out(k):
            one.update(t[1:])
            two.update(zip(t, t[1:], strict=False))
    assert sum(n == 1 for n in two.values()) > len(two) / 2
    bloom = ngram_lm.LogBloom(np.zeros((1, 1), np.uint64), (0, 1), 5, 1.5)
    level = lambda n: int(bloom.level_of(np.array(n)))
    levels = {lv: (sum(level(n) == lv for n in one.values()), sum(n for n in one.values() if level(n) == lv)) for lv in set(map(level, one.values()))}
    word, _ = ngram_lm.word_probabilities(levels, bloom)
    for k, t in docs.items():
        score = 0.0
        for a, b in zip(t, t[1:], strict=False):
            p, most = word[level(one[b])], bloom.most(level(one[a]))
            score += math.log10(0.3 * min(1, bloom.least(level(two[a, b])) / most) + 0.7 * p if most else p)
        for got in scored:
            assert abs(got[k] - score) < 1e-3 * abs(score)
