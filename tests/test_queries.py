"""Registered queries of the library against the SQL that gives the same rows."""

import glob
import os

import duckdb
import pytest

from lorevane import catalogue

SF = "/root/testdata/sf0.001"
ORACLES = catalogue.oracle_sql()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.sql(ORACLES[name]).df())


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rules_on_passages(spark):
    """Years, levels and kinds of source: what an answer leaves out, and in what order the rest stands."""
    from pyspark.sql import functions as F

    from lorevane.plans import assistant as A

    said = {
        "113 學年度 rules.pdf": "old rules", "114 學年度 rules.pdf": "new rules", "rules.pdf": "rules without a year", "常見問題.pdf": "how to apply",
        "fees.pdf": "管理學院 pays more", "levels.pdf": "全校 pays ten", "department.pdf": "企管系 pays least", "bank.pdf": "匯款帳號 1", "plain.pdf": "nothing named",
    }
    rows = [("q", i, t, {"file_name": f}, i + 1, "x", "企管系", "管理學院") for i, (f, t) in enumerate(said.items())]
    held = spark.createDataFrame(rows, "query_id string, node_id long, text string, metadata map<string,string>, pos int, user_message string, department string, college string")
    got = [r["text"] for r in A.evidence(held, keep=20).orderBy("place").collect()]
    assert got == ["new rules", "企管系 pays least", "nothing named", "how to apply"]
    college = held.withColumn("department", F.lit(None).cast("string"))
    assert "管理學院 pays more" in [r["text"] for r in A.evidence(college, keep=20).collect()]


def test_a_model_that_fails(spark, tmp_path):
    from pyspark.sql import functions as F

    from lorevane.operators.retrieval import FAILED, NOT_FOUND
    from lorevane.plans import assistant as A

    models = A.Models(embed=lambda t: F.when(t.contains("broken"), None).otherwise(A.hashed_words(t)), classify=lambda t: F.lit("ACADEMIC"))
    docs = spark.createDataFrame([(1, "Some text.", {"file_name": "a.pdf"})], "doc_id long, text string, metadata map<string,string>")
    A.index(docs.where("false"), str(tmp_path / "none"), models)
    A.index(docs, str(tmp_path / "one"), models)
    asked = spark.createDataFrame([(1, 0, "broken"), (2, 0, "some")], "thread_id long, turn long, user_message string")
    replies = lambda path: {r["thread_id"]: (r["answer"], r["sources"]) for r in A.chat(asked, str(tmp_path / path), models).collect()}
    assert replies("one") == {1: (FAILED, []), 2: ("Some text.", ["a.pdf"])}
    assert replies("none") == {1: (FAILED, []), 2: (NOT_FOUND, [])}


def test_fetch(spark):
    from lorevane.sources.web import decoded, fetch

    def getter(url):
        if "bad" in url:
            raise OSError("no route")
        return (404 if "gone" in url else 200), "é".encode()

    got = {r["full_url"]: r for r in fetch(spark.createDataFrame([("http://a",), ("http://gone",), ("http://bad",)], "full_url string"), getter).collect()}
    assert got["http://a"]["status"] == 200 and got["http://gone"]["status"] == 404 and got["http://bad"]["error"] == "OSError: no route"
    assert [r["html"] for r in decoded(fetch(spark.createDataFrame([("http://a",), ("http://gone",)], "full_url string"), getter)).collect()] == ["é"]
