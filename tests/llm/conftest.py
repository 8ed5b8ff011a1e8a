import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, start int, score double, level string, registers string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ordinary, empty, missing, very long, repeated and nearly repeated texts, shared passages."""
    rng = random.Random(5)
    base = words(rng, 120)
    passage = words(rng, 60)
    out = [words(rng, rng.randrange(1, 160)) for _ in range(40)]
    out += [None, "", "   \n\t", "one", "one two three", "ONE two three", base, base, base.replace("w1 ", "w2 ", 1), base.upper(), base + " tail end", base[: len(base) // 2]]
    out += [f"{words(rng, 30)} {passage} {words(rng, 20)}" for _ in range(5)]
    out += [words(rng, 20_000, 5000), "x" * 50_000, "same " * 300, "a\nb\na\n" * 40, "é à " * 60, base.replace(" ", "  "), "İK Straße " * 30]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "k", 1, 0.5, "x", "r") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s0", None, None, None, None, None, None)]  # a row twice
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
