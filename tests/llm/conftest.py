import pytest

BASE = "doc_id long, text string, lang string, source string, n_chars long"


def words(*numbers):
    return " ".join(f"word{n}" for n in numbers)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, very long and repeated texts, ties, repeated rows, and extra columns with clashing names."""
    long = words(*[k % 977 for k in range(30_000)])
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", "s", 4),
        (4, words(*range(40)), "en", "s", 300),
        (5, words(*range(40)), "en", "s", 300),
        (5, words(*range(40)), "en", "s", 300),
        (6, words(*range(39)) + " other", "en", None, 300),
        (7, long, "de", "s", len(long)),
        (8, "one two", None, "s", 7),
        (9, "üß é ñ 漢字", "de", "s", 8),
        (None, "no id", "en", "s", 5),
    ]
    docs = spark.createDataFrame(rows, BASE)
    from pyspark.sql import functions as F

    for name in ("label", "score", "h", "n", "key", "bucket", "id", "rank", "held_out"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
