import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def rows_of(spark, rows):
    """documents with a column that clashes with what the operators add."""
    full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t), k) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long"
    return spark.createDataFrame(full, schema).withColumns({"words": F.lit("x"), "fp": F.lit(1), "batch": F.lit(9)})


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows."""
    r = random.Random(3)
    long = " ".join(r.choice(["alpha", "beta's", "Gamma", "delta.", "é́x", "汉字", "\n", "<|endoftext|>"]) + str(r.randrange(50)) for _ in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two three four five"), (5, "ONE two\tthree four  five"), (6, "one"), (None, "no id here, but a line of some length\nx"), (7, long), (8, "same row"), (8, "same row"),
        (9, "A line that is long enough to count\nshort\nmore"), (10, "  a LINE that is long enough to count\r\nother"), (11, "a line that is long enough to count\n"), (12, "Ünïcode lines of ninetéen!!\n😀 idiot 's <|endoftext|>x\x1cy z"),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def oddities(spark, odd):
    return rows_of(spark, odd)


@pytest.fixture(scope="session")
def nothing(spark):
    return rows_of(spark, [])
