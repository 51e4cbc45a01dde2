import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row long, key string, block long, kept string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with what operators use inside."""

    def made(rows):
        return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s1" if (i or 0) % 3 else None, len(t or ""), "x", 1, "k", 2, "y") for i, t in rows], DOCS)

    return made


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows, wide characters."""
    long = " ".join(f"word{i % 977} item{i * i % 7919}" for i in range(9000))
    return [(1, "Hello World, this is a test of ten words or more."), (2, "hello world, this is a test of ten words or more."), (3, None), (4, ""), (None, "no identifier here"), (5, long), (5, long), (6, long + " tail"), (7, "É é ß 日本語   x"), (8, " \n\t "), (9, "One."), (9, "Another with the same id")]


@pytest.fixture(scope="session")
def clashing(spark):
    """Documents from (doc_id, text) pairs, with a column for every name that an operator might use inside."""
    names = ["boilerplate", "_lines", "_host", "_key", "_kept", "_digest", "_id", "_quality", "key", "kept", "row", "doc", "class", "node", "score", "host", "lines", "digest", "n_bytes", "keep_id", "keep_row", "copies", "id", "spans", "block", "a.b"]

    def made(rows):
        kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
        return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s1" if (i or 0) % 3 else None, len(t or ""), *names) for i, t in rows], kinds)

    return made
