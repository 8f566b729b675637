import random

import pytest

# Names that operators use inside or return.
CLASHING = (
    "id th _id _th _row _spans block key fp node root n shard slot score predicted ids length rank _part "
    "_rank anchor first count place head code word c filter _fp _first"
).split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(
    f"{name} string" for name in CLASHING
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = "ta ri no ka lem ost ünd pra que dis".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def rows_of(pairs):
    return [(i, t, "en", "s", None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in pairs]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text), with further columns whose names clash."""
    return lambda pairs: spark.createDataFrame(rows_of(pairs), SCHEMA)


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and very long texts, ties, repeated rows, a hot group of copies."""
    long = prose(1, 20_000)
    base = prose(2, 200)
    pairs = [
        (None, None),
        (None, base),
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r "),
        (4, "One"),
        (5, "one TWO"),
        (6, long),
        (7, long[: len(long) // 2] + " " + prose(3, 300)),
        (8, base),
        (8, base),
        (8, prose(4, 80) + "\n" + base + "  " + prose(5, 70)),
        (-9, prose(6, 60) + "　\xa0" + base[:900]),
        (2**53 + 1, "é́ \U0001f600 日本語   x"),
        (10, "a" * 5000),
        (11, "a b " * 400),
    ]
    return pairs + [(100 + k, base) for k in range(12)]


@pytest.fixture(scope="session")
def odd_docs(make_docs, odd_pairs):
    return make_docs(odd_pairs)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
