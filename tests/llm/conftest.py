import os

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    return SF_DIR


DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, long and repeated texts, ties, and columns whose names clash with helpers'."""
    rows = [
        (1, "one two three four five six seven", "en", "a", 33),
        (2, "one two three four five six seven", "en", "a", 33),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, "short", "en", "b", 5),
        (6, "Long. " * 20000, "en", "a", 120000),
        (7, " \t\n", "fr", "b", 3),
        (8, "été à la plage, ça va? ñandú straße", None, "a", 35),
        (None, "no id at all here", "en", None, 17),
    ]
    frame = spark.createDataFrame(rows, DOC)
    clash = {c: "'x'" for c in ("rank", "block", "key", "s", "last", "passes", "score", "d", "epoch", "rep", "row", "gone", "label")}
    return frame.selectExpr("*", *[f"{v} AS `{k}`" for k, v in clash.items()]).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
