import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "pages", "benchmark")}


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, a null id, and columns named like our own."""
    long = " ".join(f"word{i % 977} filler{i % 13}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, long), (6, "one two three four five six seven eight nine ten eleven"), (7, "same text here " * 40), (7, "same text here " * 40), (8, "same text here " * 40), (None, "text without an id é <|endoftext|> \U0001f600")]
    clash = ["fp", "h", "score", "n_words", "length", "slice", "shard", "x", "start", "drawer", "kept", "root", "k", "size", "spans", "piece", "th"]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for c in clash:
        frame = frame.selectExpr("*", f"'clash' AS {c}")
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return {
        "documents": spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([], "page_id long, url string, html string"),
        "benchmark": spark.createDataFrame([], "item_id long, text string"),
    }
