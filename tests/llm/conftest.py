import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing extra columns."""
    long = " ".join(f"word{i % 977} über x{i}" for i in range(20_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", "fr", None, 3), (4, "the cat sat on the mat " * 9, "en", "b", 9), (4, "the cat sat on the mat " * 9, "en", "b", 9),
        (5, "the cat sat on the mat " * 9, None, "b", None), (None, "no id here at all", "en", None, 1), (None, None, None, None, None), (6, long, "de", "c", 1), (7, "123 456 !!", "en", "c", 1),
        (8, "<|endoftext|> 🙂 ñ 漢字", "en", "é", 1), (9, "ha " * 40, "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS score", "'x' AS size", "2 AS tkey", "3 AS entities", "4 AS hits", "5 AS lang_pred", "6 AS ids", "7 AS h")
