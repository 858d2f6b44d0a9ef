import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """make_docs([(doc_id, text), ...]) -> a documents table with some extra, clashing columns on request."""

    def make(rows, extra=False):
        full = [(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 4 else None, len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", "1 AS kept", "'x' AS row", "2 AS size", "3 AS blob", "4 AS rep", "5 AS target") if extra else df

    return make


#: Nulls, empty and long texts, ties and repeated rows.
HARD = [(1, None), (2, ""), (3, "word"), (4, "a b"), (5, " \t\n\x0b\x0c\r "), (6, "tie tie tie tie tie tie tie tie tie tie"), (7, "tie tie tie tie tie tie tie tie tie tie"), (8, "lorem ipsum dolor " * 4000), (9, "ünï çödé ſ K 日本語 " * 9), (None, "no id here at all, twelve words or so to be long enough"), (10, "same row"), (10, "same row")]


@pytest.fixture
def hard():
    return HARD
