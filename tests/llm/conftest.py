import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture
def rng():
    return random.Random(7)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def messy(rng):
    """Texts with everything that must not crash an operator: nulls, blanks, copies, near copies, one very long."""
    base = prose(rng, 120)
    texts = [None, "", " \t\n ", "one", "One", "a b", "é ü", "\x0b x \x0c", "123 456", base, base, base.upper(), base + " tail", " ".join(base.split()[::-1])]
    for k in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    for _ in range(12):
        w = texts[-1].split()
        w[rng.randrange(len(w))] = "y"
        texts.append(" ".join(w))
    texts += [prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    texts.append(prose(rng, 30_000))
    return texts


@pytest.fixture
def texts(rng):
    return messy(rng)


@pytest.fixture
def documents(spark, texts):
    """documents of these texts, with a null and a repeated row, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, i, "k", 1.5) for i, t in enumerate(texts)]
    rows += [(None, texts[9], "en", 0, "k", 1.5), rows[9]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, key string, score double")


@pytest.fixture
def empty(documents):
    return documents.limit(0)
