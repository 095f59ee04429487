import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "and", "house", "river", "over", "small", "green", "walks", "under", "tree", "light", "Stone", "été", "Straße", "mountain", "a"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) + str(seed % 7) * (rng.random() < 0.1) for _ in range(n)).replace("\n ", "\n")


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties, copies, repeated rows, near copies."""
    base = prose(1, 400)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t", "en", "s", 3),
        (4, base, "en", "s", len(base)),
        (5, base.replace(" ", "  "), "en", "s", 1),
        (6, base.replace("house", "hut", 1), "en", "s", 1),
        (7, base, "de", "s", 1),
        (7, base, "de", "s", 1),
        (8, prose(2, 30_000), "de", "t", 1),
        (9, "x" * 200_000 + " y", None, "t", 1),
        (10, "one two", "en", "t", 1),
        (11, "a  b   c  ", "en", "t", 1),
        (12, "12 34 !?", "en", "t", 1),
        (None, prose(3, 50), "en", "t", 1),
        (None, None, None, None, None),
    ]
    return rows + [(20 + i, prose(100 + i, 20 + 5 * i), "en" if i % 2 else "de", "u", 1) for i in range(30)]


@pytest.fixture(scope="session")
def docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def stored(docs, tmp_path_factory):
    """The rows as documents.parquet in a folder, for the registered queries."""
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)
