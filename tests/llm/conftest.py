import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, k int"

#: nulls, empty, blank, short, ties, repeats, special tokens, odd code points and clashing extra columns
EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "Word"), (6, "two words"), (None, "two words"), (None, None),
    (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (9, "a b c d e f g h i j k l m n o p q r s t u v w x y z!"),
    (10, "x<|endoftext|>y <|endoftext|>"), (11, "naïve  café — 日本語 \U0001f600‍ ￿ don't I'LL we've  12345 \r\n\r\n  end "), (12, "ab " * 700),
    (12, "ab " * 700), (13, "a" * 3000), (14, " " * 5000 + "x"), (15, "éü" * 150), (16, "password: hunter22x, token=abcdef AKIA" + "A" * 16 + " " + "0f" * 12),
    (17, "the same line\nthe same line\n\nthe same line\nother " + " ".join(f"w{i}" for i in range(40))),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([(d, t, "en" if d and d % 2 else None, None if d == 4 else "web", 0, "x", 1) for d, t in EDGES], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
