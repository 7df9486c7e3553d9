from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, doc string, spans string, score string, mark string, id string, key string, text_ string, n_words string, copies string"


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), 1, "t", "d", "s", "x", "m", "i", "k", "u", "w", "c")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "on", "er", "in", "ea", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, copies, near copies, repeated rows and columns that clash."""
    base = prose(1, 200)
    near = " ".join(w if i % 60 else "changed" for i, w in enumerate(base.split()))
    return [
        row(1, base), row(2, base), row(3, near), row(4, None), row(5, ""), row(6, " \t\n "), row(7, "one"), row(8, "one"),
        row(9, prose(2, 60_000), None), row(10, "Mixed CASE words é ü 漢字"), row(10, "Mixed CASE words é ü 漢字"), row(None, base), row(None, None, None),
        row(11, prose(3, 80) + " " + " ".join(base.split()[20:120]) + " " + prose(4, 30), "b"), row(12, prose(5, 49)), row(13, prose(5, 49), "c"),
        row(14, "same same same same " * 40, "c"), row(15, "same same same same " * 45, None),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
