"""Words that a polynomial hash modulo 2**64 cannot tell apart, in the hash and in the operators that use it."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from anchorage.llm import common, minhash, quality, substring


def thue_morse(n: int, letters: str = "ab") -> str:
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [8, 9, 64, 256, 512, 1024, 4096])
def test_thue_morse_words_differ(n):
    one, other = thue_morse(n), thue_morse(n, "ba")
    a, b = common.hashed_words(f"{one} {other}".encode())
    assert a != b and common.hashed_words(other.encode())[0] == b


def test_hash_follows_the_word_alone():
    r = random.Random(4)
    words = ["".join(r.choice("ab\0éz") for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 250, 256, 257, 300, 70_000]))) for _ in range(300)]
    words += ["a", "a\0", "a\0\0", "abcdefgh", "abcdefgh\0", "abcdefg"]
    alone = {w: int(common.hashed_words(w.encode())[0]) for w in words}
    together = common.hashed_words("\n ".join(words).encode())
    assert [alone[w] for w in words] == together.tolist()
    assert len(set(alone.values())) == len(alone)


def test_families_differ():
    words = common.hashed_words(b"one two three four five six seven")
    assert not set(common.gram_hashes(words, 3).tolist()) & set(common.gram_hashes(words, 3, 1).tolist())
    assert (common.gram_hashes(words, 3, 1)[2:] == common.gram_hashes(words[2:], 3, 1)).all()


def test_operators_tell_such_words_apart(spark):
    one, other = thue_morse(1024), thue_morse(1024, "ba")
    around = [[f"w{k}" for k in range(30)], [f"v{k}" for k in range(30)]]
    passages = [" ".join([*around[0], x, *around[1]]) for x in (one, other)]
    lists = [" ".join(f"{c}{k} {x}" for k in range(20)) for c, x in (("p", one), ("p", other))]
    docs = spark.createDataFrame(list(enumerate([*passages, *lists], 1)), "doc_id long, text string")
    for r in substring.digests(docs).collect():
        assert r.n_removed == 0
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert all(r.component_id == d for d, r in got.items())
    words = f"x {one} y x {other} y".encode()
    assert quality.text_statistics(memoryview(words))[4] == 0


def test_surroundings_have_two_hashes(spark):
    """Both tell different surroundings apart, by words and by where the text begins and ends, and are equal for equal ones."""
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(n)) for n in (50, 51, 79, 80, 120, 400)]
    texts.append(texts[4])
    seen: list[dict] = [{}, {}]
    for text in texts:
        words = common.hashed_words(text.encode())
        at, _ = substring.anchors(words)
        for family, hashes in enumerate(substring.surroundings(words, at)):
            for k, h in zip(at.tolist(), hashes.tolist(), strict=True):
                own = (max(30 - k, 0), max(k + 50 - len(words), 0), tuple(words[max(k - 30, 0) : k + 50].tolist()))
                assert seen[family].setdefault(h, own) == own
    assert len(seen[0]) == len(seen[1]) == len(set(seen[0].values())) and not set(seen[0]) & set(seen[1])
    # A word moved, doubled or dropped changes both.
    base = texts[4].split()
    changed = [base[:40] + [base[41], base[40]] + base[42:], base[:40] + [base[40]] + base[40:-1], base[:41] + base[42:] + ["end"]]
    plain = substring.surroundings(common.hashed_words(" ".join(base).encode()), np.array([45]))
    for words in changed:
        other = substring.surroundings(common.hashed_words(" ".join(words).encode()), np.array([45]))
        assert plain[0] != other[0] and plain[1] != other[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in substring.digests(docs).collect()}
    assert [got[k].n_removed for k in range(7)] == [0, 0, 0, 0, 0, 0, 120]
    assert got[6].kept_sha256 == hashlib.sha256(b"").hexdigest()
