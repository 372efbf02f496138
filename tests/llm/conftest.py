import hashlib
import sys
import os

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
#: documents with every odd case: nulls, empty and blank texts, one very long text, repeated rows, no id
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank today again\nA shared line of text\nshort"),
    (2, "  a SHARED line of text \nother words here"),
    (3, None), (4, ""), (5, " \t\n "), (6, "one"),
    (7, "word " * 5000 + "x" * 3000), (8, "été à Noël, 日本語 テキスト\r\nA shared line of text"),
    (9, "the quick brown fox jumps over the lazy dog near the old river bank today again\nA shared line of text\nshort"),
    (9, "the quick brown fox jumps over the lazy dog near the old river bank today again\nA shared line of text\nshort"),
    (None, "the quick brown fox jumps over the lazy dog near the old river bank today again\nA shared line of text\nshort"),
]


def lower(s):
    return (s or "").translate({k: k + 32 for k in range(65, 91)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents, with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"s{k}", len(t or ""), 7, "x", "y") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "n_words int, spans string, rep string")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def empty(small):
    return small.limit(0)
