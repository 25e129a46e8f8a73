from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, slot int, row int, rank int, key string"


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice(["an", "be", "co", "dé", "er", "fo", "gu"]) for _ in range(r.randrange(1, 5))) for _ in range(n)]


def prose(r: random.Random, n: int) -> str:
    """Words of sixty syllables, which compress like prose."""
    own = random.Random(3)
    consonants, vowels, ends = "bcdfghklmnprstvw", "aeiou", ["", "", "", "", "", "", "n", "r", "s", "l", "t", "m"]
    syllables = [own.choice(consonants) + own.choice(vowels) + own.choice(ends) for _ in range(60)]
    often = [(k + 3) ** -0.5 for k in range(60)]
    return " ".join("".join(r.choices(syllables, often, k=r.choice([1, 2, 2, 3]))) for _ in range(n))


def awkward() -> list[tuple]:
    """Prose with copies, near copies and shared passages, beside nulls, empty, blank, odd and very long texts; clashing columns."""
    r = random.Random(11)
    passage = " ".join(words(r, 70))
    base = words(r, 200)
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two three four", "two one three four", "é" * 30, "a" * 40_000, "la " * 3_000]
    texts += [" ".join(words(r, r.randrange(20, 300))) for _ in range(25)]
    for k in range(14):
        near = list(base)
        for _ in range(k % 5):
            near[r.randrange(len(near))] = "zz" + str(r.randrange(9))
        texts.append(" ".join(near))
    texts += [" ".join(words(r, 40)) + "\n" + passage + "\n" + " ".join(words(r, 30)) for _ in range(6)]
    texts += [" ".join(base), " ".join(base).upper(), "  ".join(base), " ".join(words(r, 20_000)), "\n".join(["same line here"] * 40)]
    texts += ["".join(chr(r.randrange(33, 1200)) for _ in range(3000)), "x\x0by\x0cz\x1cq\x85r s 　t"]
    shared, near = prose(r, 70), prose(r, 180).split(" ")
    texts += [prose(r, r.randrange(60, 400)) for _ in range(12)] + [prose(r, 3_000)]
    texts += [" ".join([*near[:k], f"changed{k}", *near[k + 1 :]]) for k in (0, 50, 100, 150)]
    texts += [f"{prose(r, 60)}\n{shared}\n{prose(r, 50)}" for _ in range(4)]
    rows = [(k * 3 + 1, t, "en", [None, "b", "a", "a", "a"][k % 5], len(t or ""), "k", k, k, k, None) for k, t in enumerate(texts)]
    rows += [rows[20], rows[20], rows[1], (None, texts[15], None, None, None, None, None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
