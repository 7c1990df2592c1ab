import pytest


@pytest.fixture
def docs_frame(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def make(texts, sources=None, langs=None, ids=None):
        n = len(texts)
        rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema) if n else spark.createDataFrame([], schema)

    return make


@pytest.fixture
def prose():
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))
