from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, node string, size int, label string, key string, group string"


def prose(r: random.Random, n: int, words=WORDS) -> str:
    return " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def hostile_rows():
    """Nulls in each column, empty, blank and very long texts, copies and near copies, repeated rows and ids, no letters, odd characters."""
    r = random.Random(5)
    base = [prose(r, r.randrange(1, 120)) for _ in range(40)]
    texts = [*base, base[0], base[0], base[1].replace(" ", "  \t\n"), base[2].upper(), base[3] + " tail", None, "", " \n\t ", "123 456", "\x00 z\x00", "\U0001f600 é 漢字", "a" * 200_000, prose(r, 20_000), "x " * 30_000]
    for k in range(12):
        words = base[4].split()
        words[k % len(words)] = f"edit{k}"
        texts.append(" ".join(words))
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "s1", "s2", "s1", "s1"][i % 5], len(t or ""), i, 7, "n", 1, "l", "k", "g") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[5], None, None, None, *rows[0][5:]), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def hostile(spark, hostile_rows):
    return spark.createDataFrame(hostile_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
