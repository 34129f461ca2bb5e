import pytest
from pyspark import cloudpickle

import licspark

# as the driver does, so that what cannot travel by value is seen
cloudpickle.register_pickle_by_value(licspark)

#: Extra columns whose names clash with those the operators use inside.
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, set_id string, part int, n_words long, score string"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    base = " ".join(f"w{k % 97} and the word{k}" for k in range(60))
    near = base.replace("word7 ", "changed ")
    texts = [
        (1, base, "en", "a"),
        (2, base.upper(), "en", "a"),
        (3, near, "en", None),
        (4, None, None, None),
        (5, "", "en", "b"),
        (6, " \n\t ", None, "b"),
        (7, "four words are here", "en", "b"),
        (8, "four  words\nare here", None, "c"),
        (9, "1234 !!! ###", "en", "c"),
        (10, "the long text goes on and on " * 30_000, "en", "a"),
        (11, "x" * 400_000, None, "a"),
        (None, base, "en", "a"),
        (None, "a text without an id that is alone in the world", None, None),
        (1, base, "en", "a"),
        (12, "same id, one text of two " * 3, "en", "d"),
        (12, "same id, the other text of two " * 3, "en", "d"),
        (13, "Grüße, élan, niño, 日本語 🙂", "de", "d"),
    ]
    return [(d, t, l, s, len(t or ""), "x", 1, -1, "y") for d, t, l, s in texts]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, EDGE_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
