import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "so", "vi", "du") for c in ("", "n", "s", "rt", "lla")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows that every operator must bear: nulls, blanks, repeats, a very long text, non-ASCII."""
    base = prose(1, 160)
    return [
        (0, base), (1, None), (2, ""), (3, " \t\n "), (4, base), (4, base), (5, base.upper()), (6, prose(2, 30_000)), (7, "word"), (8, "word"), (9, "Ünïcode é ß 漢字 " * 12),
        (10, base[: len(base) // 2] + " changed here " + base[len(base) // 2 :]), (11, prose(3, 60) + "\n" + base), (None, base), (12, "a\x00b \x0b c\x85d"), (13, "x" * 5000),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Those rows with further columns whose names the operators use themselves."""
    rows = [(k, t, 1, "g", None, 2.0, [1], "kept") for k, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, g int, id string, lang string, component double, spans array<int>, kept string")
