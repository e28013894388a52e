"""Small inputs that every operator has to take."""

import pytest

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
#: Nulls, empty and very long texts, ties and repeated rows.
ODD = [(1, "a b c d e", "en", "s1", 9), (1, "a b c d e", "en", "s1", 9), (2, "a b c d e", "en", None, 9),
       (3, None, None, "s2", None), (4, "", "de", "s2", 0), (5, "one", "fr", "s2", 3), (6, LONG, "en", "s1", len(LONG)),
       (7, "  \n\t ", "en", "s2", 5), (8, "é à ü ñ 中文 😀 b c", "es", "s3", 15), (None, "a b c d e", "en", "s1", 9)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def odd(spark):
    """The odd rows with extra columns whose names operators may use themselves."""
    rows = [(*r, "x", 7, "y", 1.5, 0.9, 1, "m", 2, "r") for r in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", fingerprint string, home int, id string, score double, toxicity_score double, "
                                 "kept_key long, mix string, key int, row string")


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)
