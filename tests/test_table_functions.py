"""Table functions called from SQL."""

import pytest
from pyspark.errors import PySparkException

from lorevane.functions import tables
from lorevane.operators import grids as G
from lorevane.operators import links as L

PAGE = "<table id=a><tr><td rowspan=2>x<td colspan=2><a href='/d'><b>deep</b> link</a></tr><tr><td>y<table><tr><td>in</td></tr></table></table><table><tr><td>other</table>"


def test_links_and_cells_as_the_operators_give_them(spark):
    tables.register(spark)
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    pages.createOrReplaceTempView("some_pages")
    rows = lambda df: sorted(map(str, df.collect()))
    got = spark.sql("SELECT page_id, l.* FROM some_pages, LATERAL html_links(html) AS l")
    assert rows(got) == rows(L.anchors(pages.selectExpr("page_id", "'' AS url", "html")).drop("url"))
    assert [tuple(r) for r in got.select("href", "txt", "tr_text").collect()] == [("/d", "deep link", "xdeep link")]
    for table_id in (None, "a"):
        name = "" if table_id is None else ", 'a'"
        cells = spark.sql(f"SELECT page_id, c.* FROM some_pages, LATERAL html_cells(html{name}) AS c")
        assert rows(cells) == rows(G.html_cells(pages, table_id=table_id)) and cells.count() > 3


@pytest.mark.parametrize("kind", ["string", "long"])
def test_grids_of_several_tables(spark, kind):
    tables.register(spark)
    rows = [(t, r, o, 1 + (o + r) % 2, 1 + o % 3, f"{t}{r}{o}") for t in (1, 2, 3) for r in range(4) for o in range(3)]
    cells = spark.createDataFrame(rows, "id long, r int, ord int, rowspan int, colspan int, text string").selectExpr(f"CAST(id AS {kind}) AS id", "r", "ord", "rowspan", "colspan", "text", "'more' AS col")
    cells.repartition(3).createOrReplaceTempView("some_cells")
    got = spark.sql("SELECT * FROM expand_spans(cells => TABLE(some_cells) PARTITION BY id ORDER BY (r, ord), key => 'id')")
    want = G.expand_spans(cells, "id").selectExpr("id", "CAST(row AS BIGINT) AS row", "CAST(col AS BIGINT) AS col", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.schema["id"].dataType == cells.schema["id"].dataType


def test_wrong_arguments_are_told(spark):
    tables.register(spark)
    spark.createDataFrame([(1, 0)], "table_id long, r int").createOrReplaceTempView("no_cells")
    for call, said in (("expand_spans(TABLE(no_cells) PARTITION BY table_id)", "ord"), ("html_links(1)", "text"), ("html_cells(NULL)", "text")):
        with pytest.raises(PySparkException, match=said):
            spark.sql(f"SELECT * FROM {call}").collect()
