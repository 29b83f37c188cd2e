import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, comp int, hits int, h int, line string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def edited(text: str, at: int, word: str = "CHANGED") -> str:
    w = text.split(" ")
    w[at] = word
    return " ".join(w)


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    base, long = prose(1, 80), prose(2, 20_000)
    texts = [None, "", " \t\n", base, base.upper(), edited(base, 40), edited(edited(base, 40), 41), long, edited(long, 7), "one", "One", "two words", "é É ÉÉ naïve", prose(3, 60), "1234 !!", "\U0001f600 smile " + prose(4, 30), "line a\nline b\n\nline a"]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], len(t or ""), "x", 1, 2, 3, "l") for i, t in enumerate(texts)]
    out += [out[3], out[3]]  # repeated rows
    out += [(None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    out += [(100 + i, prose(50 + i, 40), "en" if i % 2 else "de", "s1", 0, "", 0, 0, 0, "") for i in range(20)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
