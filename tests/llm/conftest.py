import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing names."""
    long = "word%d other, " * 1
    rows = [
        (1, "the cat sat on the mat and then ran", "a", None), (2, "the cat sat on the mat and then ran", "b", None), (2, "the cat sat on the mat and then ran", "b", None),
        (3, None, None, 1), (4, "", "a", 2), (5, "  \n\t ", "a", 3), (None, "no id here at all", None, 4), (None, None, None, None),
        (6, "one", "c", 5), (7, "one two", "c", 5), (8, " ".join(long % i for i in range(30_000)), "c", 5), (9, "x" * 70_000, "c", 5),
        (10, "é\U0001f600 中文 <|endoftext|> tail <|ENDOFTEXT|>", "c", 5), (11, "a\x00b \x85 c d", "c", 5),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, kept bigint").withColumnsRenamed({}).selectExpr("*", "'x' as id", "1 as length", "'y' as sequence_id")


@pytest.fixture(scope="session")
def empty(hostile):
    return hostile.limit(0)
