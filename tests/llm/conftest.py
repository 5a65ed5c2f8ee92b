import random

import pytest

WORDS = "alpha beta gamma delta river stone cloud maple copper signal window garden silver market bridge winter travel number letter music".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


ODD_TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "a b  c\n\nd \u2003 e\u00a0f\u0301 It's DON'T 42% <|endoftext|> \u2581x",
    "\u00c9t\u00e9 \u00df \u0130 \ud55c\uad6d \U0001f642" * 3,
    "x" * 20_000,
    "same line\nsame line\nsame line\nother",
]


@pytest.fixture(scope="session")
def documents(spark):
    """Odd texts, prose, exact copies, near copies, a repeated row, a null id and columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100 + i, prose(i, 60 + 7 * i)) for i in range(30)]
    rows += [(200 + i, prose(3, 81)) for i in range(5)]
    base = prose(500, 400).split()
    for i in range(12):
        copy = list(base)
        copy[7 * i + 5] = f"edit{i}"
        rows.append((300 + i, " ".join(copy)))
    rows += [(400, prose(900, 5000)), (400, prose(900, 5000)), (None, prose(901, 70)), (-7, prose(902, 70))]
    data = [(i, t, ["en", "de", None][k % 3], f"s{k % 2}" if k % 5 else None, len(t or ""), "clash", 1.5, k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, quality string, toxicity double, bucket int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark, documents):
    return spark.createDataFrame([], documents.schema)


@pytest.fixture(scope="session")
def rows(documents):
    return documents.collect()
