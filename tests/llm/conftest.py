from __future__ import annotations

import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "stone", "river", "cloud", "amber", "quick", "brown", "fox", "lazy", "dog", "paper", "green", "house", "seven", "eight", "night", "light"]
LONG = "z" * 40_000


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", str(rng.randrange(50))]) for _ in range(n))


def documents() -> list[tuple]:
    """Clean texts, exact and near copies, shared passages, and awkward rows."""
    passage = prose(99, 60)
    rows = [(i, prose(i, 40 + 5 * (i % 17)), "en", "src0") for i in range(40)]
    base = prose(1000, 120).split()
    for i in range(40, 60):  # near copies of one text
        rng = random.Random(i)
        words = list(base)
        for _ in range(rng.randrange(1, 8)):
            words[rng.randrange(len(words))] = f"edit{i}x{rng.randrange(9)}"
        rows.append((i, " ".join(words), "en", "src0"))
    rows += [(60 + i, rows[3][1], "en", "src1") for i in range(5)]
    rows += [(70 + i, prose(500 + i, 20) + " " + passage + "\n" + prose(600 + i, 25), "en", "src2") for i in range(6)]
    rows += [(80, None, None, None), (81, "", "en", None), (82, "  \n\t ", "en", "s"), (83, "single", "en", "s"), (84, "single", "de", "s"), (85, LONG, "en", "s"), (86, "two words", "en", "s"), (87, prose(5, 3000), "en", "s"), (88, "été Übung 日本", "fr", "s")]
    rows += [rows[0], rows[45], (None, rows[7][1], "en", "s"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(d, t, lang, s, len(t) if t is not None else None, "x", 1) for d, t, lang, s in documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tokens string, n int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
