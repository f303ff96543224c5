import pytest

#: Rows that every operator must take: nulls, blanks, repeats, ties, long texts, non-ASCII.
LINE = "The quick brown fox jumps over the lazy dog near the old river bank at dawn"
ODD = [
    (1, LINE), (2, LINE), (2, LINE), (3, None), (4, ""), (5, " \n\t\n "), (None, LINE + " again"), (6, "É ñ ü " * 60),
    (7, "word " * 3000), (8, "short"), (9, "a\x00b " * 40), (2, "another text under the same id " * 5), (10, "123 456 !!!")]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names operators use themselves."""
    rows = [(i, t, "src1" if (i or 0) % 2 else None, "en" if i and i < 8 else None, len(t or ""), 7, "x", 0.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, size long, id string, tile double")


@pytest.fixture(scope="session")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
