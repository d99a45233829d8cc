import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, key long, block int, `_keep` long"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "thing", "river", "stone", "Light", "under", "dark", "é"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns of clashing names."""
    rng = random.Random(5)
    texts = [None, "", " ", "a", "A", "a b", "A B", "Plain words here.", "plain words here.", "1234 %% !!", "é É", words(rng, 30000)]
    near = words(rng, 400)
    texts += [near, near + " x", near.replace("river1 ", "river2 ", 1), near, *[words(rng, rng.randrange(1, 300)) for _ in range(30)]]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None, "d", 1, 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[12], (None, "plain words here.", None, None, None, None, None, None, None, None), (None, None, "de", "src1", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
