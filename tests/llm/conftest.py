import pytest
from pyspark.sql import functions as F

TEXT = "the first line of words\nand a second line, with words of the first"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns that clash with inner names."""
    rows = [(1, TEXT, "en", "src1"), (1, TEXT, "en", "src1"), (2, None, "en", "src2"), (3, "", None, "src2"), (4, " \n\t ", "de", None), (None, TEXT + " more", "en", "src1"),
            (None, None, None, None), (5, "long text " * 40_000, "en", "src3"), (6, "汉字 und ümlaut 😀 ́", "de", "src3"), (7, "x", "fr", "src4")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text"), "_hash": F.lit(1), "row": F.lit("r"), "score": F.lit(0.5), "_counts": F.lit(1), "queue": F.lit("q"), "kept": F.lit(False)})


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 0, 1), (7, None, None), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
