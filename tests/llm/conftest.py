import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeated rows, control characters, and columns with clashing names."""
    long = " ".join(f"word{i % 997}x{i % 31}" for i in range(60_000))
    rows = [(1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "It's  a   test's\r\n\n'S 're we've 12½ ²³ 日本語 naïve <|endoftext|> end<|endoftext|>"), (7, "aaaa aaaaaaaa aaa"), (7, "aaaa aaaaaaaa aaa"), (None, "a text without an id"), (8, "\x00\x85  odd � white　space")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({"id": F.lit("x"), "a": F.lit(1), "label": F.lit(9), "key": F.lit("k"), "row": F.lit(0), "rep": F.lit(2), "words": F.lit(3)})
