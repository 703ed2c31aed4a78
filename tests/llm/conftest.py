import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names
    the operators use themselves."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60000))
    story = "The harbour was quiet that night and only one lamp burned near the old customs house while rain fell softly on the boats that nobody had used since the summer when the ferry stopped running to the island."
    texts = [None, "", " \n\t ", "one", "four words are here", story, story, story + " Nobody knew why.", "a" * 3000, "x y " * 500, long, long, "Ünïcödé täxt " * 40, "zero\x00byte and \x1f others", "line\n" * 30]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], (None, story, None, None, 0), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "'k' as key", "2 as h", "3 as n", "4L as _row", "true as kept", "5 as runs", "6 as k1", "7 as hits")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
