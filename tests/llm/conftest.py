"""Texts with copies, near copies, shared passages, empty and missing values, and clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, row string, score string, class string, lang string, source string, n_chars long"


def words_of(rng, n):
    parts = ["ka", "lo", "mi", "ten", "ru", "é", "sol", "qua", "dir"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    passage = " ".join(words_of(rng, 80))
    base = [words_of(rng, rng.randint(1, 120)) for _ in range(14)]
    out = [" ".join(words) for words in base]
    for words in base[:8]:  # near copies with one and with many changed words
        near, far = list(words), list(words)
        near[len(near) // 2] = "changed"
        for at in range(0, len(far), 6):
            far[at] = f"other{at}"
        out += [" ".join(near), " ".join(far)]
    out += [out[3], out[3].upper(), passage, f"Vor {passage} nach", f"{passage[10:]} {passage}"]
    out += ["", " \t\n", "a", "A\x0bB", " é 日本", "na" * 700, "x y " * 200, None]
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(100 + at, text, "r", "s", "c", "en", "src", len(text or "")) for at, text in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, None, None, None), (100, texts[0], "again", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
