import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from rows; missing columns at the end are null."""
    def build(rows):
        return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCUMENTS)
    return build


@pytest.fixture(scope="session")
def awkward(documents):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and clashing names."""
    long_text = " ".join(random.Random(1).choices(["stone", "river", "cloud", "idiot,", "Ätna", "a@b.example"], k=30_000))
    rows = [(None, None), (None, "some text", "en", "s"), (1, None, "en", "s"), (2, "", "de", None), (3, " \t\n ", None, "s"),
            (4, "one two three four five six", "en", "t"), (5, "one two three four five six", "en", "t"), (6, long_text, "en", "s"),
            (7, "x" * 50_000, "en", "u"), (8, "日本語 ▁  🎉\x00 é", "ja", "u"), (9, "one", "en", "t"), (9, "one", "en", "t"),
            (10, "you idiot. you are a moron!", "en", "t")]
    df = documents(rows)
    for name in ("node", "n", "size", "_row", "_h", "block", "word", "c", "score", "first", "spans", "ids", "component_id", "weight", "toxic"):
        df = df.withColumn(name, df["doc_id"])
    return df


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
