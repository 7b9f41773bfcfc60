import random

import pytest


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def odd_rows(spark, rng):
    """Rows with null, empty, very long, tied and repeated texts, a null id, and extra
    columns whose names the operators use themselves."""
    words = ["the", "and", "é", "foo.", "bar", "Baz", "x", "#a", "𝛀", "12", "a@b.co"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(90)
    texts = [None, "", " \n\t ", "a", "A", "the " * 3000, "ab" * 900, text(60), text(60)]
    texts += [f"{text(rng.randint(0, 60))}\n{shared} {text(rng.randint(0, 40))}" for _ in range(12)]
    texts += [shared, shared, text(3000)]
    rows = [(i, t, "n", t, -1) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[12], (None, "no id " * 30, "n", None, 0), (900, texts[13], "n", None, 5)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    names = "doc_id long, text string, n_words string, _text string, g int"
    return spark.createDataFrame(odd_rows, names).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
