import os
import zipfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorevane.operators import conversation as C
from lorevane.operators import grids as G
from lorevane.operators import links as L
from lorevane.operators import retrieval as R
from lorevane.operators.html_links import cells_of, links_of
from lorevane.sources import files as S


def test_merge_keeps_first_place_and_last_score(spark):
    hits = lambda *x: spark.createDataFrame([(n, s, i + 1) for i, (n, s) in enumerate(x)], "node_id string, score double, pos int")
    merged = R.merge_hits(hits(("b", 0.8), ("c", 0.7)), hits(("d", 0.9), ("b", 0.95))).orderBy("pos").collect()
    assert [(r.node_id, r.score) for r in merged] == [("b", 0.95), ("c", 0.7), ("d", 0.9)]


def test_sources_and_answer(spark):
    rows = [(1, "q", {"file_name": "x.pdf", "page_label": "2"}, "A"), (2, "q", {"file_name": "y.pdf"}, "B"), (3, "q", {"file_name": "x.pdf", "page_label": "2"}, "C"), (4, "q", {}, "")]
    nodes = spark.createDataFrame(rows, "rank int, q string, metadata map<string,string>, text string")
    assert R.ordered_sources(nodes, "q").collect()[0].sources == ["x.pdf (第 2 頁)", "y.pdf", "未知文件"]
    assert R.answer(nodes, "q").collect()[0].answer == "A\nB\nC"
    assert R.answer(nodes.where("rank = 4"), "q").collect()[0].answer == R.NOT_FOUND


def test_top_k_in_blocks_and_zero_vectors(spark, monkeypatch):
    monkeypatch.setattr(R, "_AT_ONCE", 4)
    nodes = spark.createDataFrame([(i, [float(i % 3), float(i), 1.0 if i else 0.0]) for i in range(30)], "node_id long, embedding array<float>")
    queries = nodes.select(F.col("node_id").alias("query_id"), "embedding")
    one = {tuple(r) for r in R.top_k(queries, nodes, 3).select("query_id", "node_id", "pos").collect()}
    assert one == {tuple(r) for r in R.top_k(queries, nodes, 3, block=7, slice_=4).select("query_id", "node_id", "pos").collect()}
    assert len(one) == 87  # the zero vector has no neighbours
    assert R.top_k(queries.where("false"), nodes, 3).collect() == R.top_k(queries, nodes.where("false"), 3).collect() == []
    odd = nodes.union(spark.createDataFrame([(99, None)], "node_id long, embedding array<float>"))
    assert one == {tuple(r) for r in R.top_k(odd.select(F.col("node_id").alias("query_id"), "embedding"), odd, 3).select("query_id", "node_id", "pos").collect()}


def test_apology(spark):
    rows = [("a", ["s"], None), ("b", ["s"], "boom")]
    got = R.apologise(spark.createDataFrame(rows, "answer string, sources array<string>, error string")).collect()
    assert (got[0]["answer"], got[0]["sources"]) == ("a", ["s"]) and (got[1]["answer"], got[1]["sources"]) == (R.FAILED, [])


def test_windows_hold_seven_at_most(spark):
    docs = spark.createDataFrame([(1, "A. B! C? D。E\nF. G. H. I."), (2, None), (3, "  ")], "doc_id long, text string")
    got = R.sentence_windows(R.sentences(docs)).orderBy("ord").collect()
    assert [r.sent for r in got] == ["A.", "B!", "C?", "D。", "E", "F.", "G.", "H.", "I."]
    assert got[0].window == "A. B! C? D。" and got[4].window == "B! C? D。 E F. G. H."


def test_windows_of_documents_are_those_of_their_sentences(spark):
    docs = spark.createDataFrame([(1, "A. B! C? D。E\nF. G. H. I."), (2, None), (3, "  "), (4, "one"), (5, "a. b.")], "doc_id long, text string")
    want = {(r.doc_id, r.ord, r.sent, r.window) for r in R.sentence_windows(R.sentences(docs)).collect()}
    made = R.document_windows(docs)
    assert {(r.doc_id, r.ord, r.sent, r.window) for r in made.collect()} == want and len(want) == 12
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_latest_year_wins(spark):
    rows = [("t", "舊規定"), ("t", "114 學年度 b"), ("t", "115 學年度 c")]
    assert R.prefer_latest(spark.createDataFrame(rows, "topic string, text string"), "topic").collect()[0].text == "115 學年度 c"


def test_history_and_intents(spark):
    turns = spark.createDataFrame([(1, i, t) for i, t in enumerate("abcd")], "conv_id long, turn long, text string")
    assert [r.history for r in C.recent(turns).orderBy("turn").collect()] == ["a", "a -> b", "a -> b -> c", "b -> c -> d"]
    labels = spark.createDataFrame([(" action.",), ("CLARIFY or ACADEMIC",), ("TRANSACTION",), ("hello",), (None,)], "x string")
    assert [r[0] for r in labels.select(C.intent_of(F.col("x"))).collect()] == ["Action Agent", "Clarification Agent", "Action Agent", "Fallback Agent", "Fallback Agent"]
    assert spark.range(1).select(C.node_of(F.lit("nobody"))).collect()[0][0] == "end_node"
    out = spark.sql("select array('a','b') r, array() n").select(C.reply(F.col("r"), F.array(F.lit("s")), F.lit("Academic Agent")), C.reply(F.col("n").cast("array<string>"), F.lit(None).cast("array<string>"), F.lit("x"))).collect()[0]
    assert '"response":["b"]' in out[0] and C.NO_RESULT in out[1] and '"sources":[]' in out[1]


def test_links_of_nested_markup():
    page = "<table><tr><td>選課須知<td><a href='/d/a.docx'>1. <b>下載</b></a></tr></table><a>x</a>"
    assert links_of(page) == [("/d/a.docx", "1. 下載", "選課須知1. 下載"), (None, "x", None)]


def test_downloads(spark):
    rows = [
        ("#", "any", None), ("javascript:x", "any", None), ("a.odt", "any", None), ("JavaScript:download()", "A script", None), ("/profile/9", "Member list", None),
        ("/d/a.docx", "1. 下載", "選課須知"), ("/d/b.pdf", "檔案下載", None), ("/d/c.pdf", "某測試用檔案", None), ("/d/e.pdf", "Same name", None), ("/d/e2.pdf", "Same name", None),
        ("/d/f.pdf", "abc", None), ("/d/g.pdf", "pdf", None), ("/d/gone.pdf", "Not there", None), ("/d/h.pdf", "Old one", None),
    ]
    links = spark.createDataFrame([(1, "http://h/p/", i, *r) for i, r in enumerate(rows)], "page_id int, url string, ord int, href string, txt string, tr_text string")
    fetch = lambda df: df.withColumns({"status": F.when(F.col("full_url").contains("gone"), 404).otherwise(200), "content": F.lit("x")})
    existing = spark.createDataFrame([("Old one.pdf",)], "file_name string")
    got = L.downloads(links, existing, fetch, ["page_id", "ord"])
    assert {(r.file_name, r.ord) for r in got.collect()} == {("A script.pdf", 3), ("Member list.pdf", 4), ("選課須知.docx", 5), ("Same name.pdf", 8), ("abc.pdf", 10)}
    titled = L.downloads(links, existing, fetch, ["page_id", "ord"], title=F.lit("From inside"))
    assert ("From inside.pdf", 10) in {(r.file_name, r.ord) for r in titled.collect()}


def test_page_title(spark):
    got = spark.createDataFrame([("\n \n a/b c \nx",), ("ab",), (None,), ("y" * 60,)], "t string").select(L.page_title(F.col("t"))).collect()
    assert [r[0] for r in got] == ["ab c", None, None, "y" * 50]


def test_spans(spark):
    page = "<table id=t><tr><th>h0<th colspan=2>h1</tr><tr><td rowspan=2>a<td>b<td>c</tr><tr><td>d<td>e</tr></table>"
    grid = G.spread(cells_of(page, "t"))
    assert [[grid[r, c] for c in range(3)] for r in range(3)] == [["h0", "h1", "h1"], ["a", "b", "c"], ["a", "d", "e"]]
    pages = spark.createDataFrame([(1, page), (2, None)], "table_id int, html string")
    assert G.expand_spans(G.html_cells(pages, "table_id", table_id="t")).count() == 9


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), min_size=1, max_size=4), min_size=1, max_size=4))
def test_cells_of_a_row_keep_their_order(rows):
    grid = G.spread([(r, o, down, across, f"{r}.{o}") for r, cells in enumerate(rows) for o, (down, across) in enumerate(cells)])
    for r in range(len(rows)):
        order = [int(t.split(".")[1]) for (rr, c), t in sorted(grid.items()) if rr == r and t.startswith(f"{r}.")]
        assert order == sorted(order) and set(order) == set(range(len(rows[r])))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=4), max_size=4), min_size=1, max_size=6))
def test_grids_are_those_of_placing_cell_by_cell(spark, tables):
    """Tables of all kinds, against marking every covered place."""
    cells, want = [], set()
    for k, rows in enumerate(tables):
        grid = {}
        for r, row in enumerate(rows):
            c = 0
            for o, (down, across) in enumerate(row):
                cells.append((k, r, o, down, across, f"{r}.{o}"))
                while (r, c) in grid:
                    c += 1
                grid |= {(r + i, c + j): f"{r}.{o}" for i in range(down) for j in range(across)}
                c += across
        want |= {(k, *place, t) for place, t in grid.items()}
    got = G.expand_spans(spark.createDataFrame(cells, "table_id int, r int, ord int, rowspan int, colspan int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_unpivot(spark):
    head = ["午別", "節次", "時間", "星期一", "", "星期三"]
    body = [["上午", "第一節", "08:00\n08:50", "C1\nMath\nR1", " ", "X"], ["上午", " ", "t", "lost", "", ""]]
    cells = [(1, r, c, t) for r, row in enumerate([head, *body]) for c, t in enumerate(row)]
    got = G.unpivot(spark.createDataFrame(cells, "table_id int, row int, col int, text string")).orderBy("col").collect()
    assert [(r.day, r.period, r.time, r.details) for r in got] == [("星期一", "第一節", "08:00 08:50", ["C1", "Math", "R1"]), ("星期三", "第一節", "08:00 08:50", ["X"])]


def test_timetable(spark):
    rows = [("星期一", "第A節", 1, ["a"]), ("星期二", "第一節", 2, ["b"]), ("星期二 ", "第一節", 3, ["c"]), ("星期日", "第一節", 4, ["no"]), ("星期六", "中午", 5, [])]
    got = {r.period: r for r in G.timetable(spark.createDataFrame(rows, "day string, period string, ord int, details array<string>")).collect()}
    assert got["第Ａ節"]["星期一"] == ["a"] and got["第一節"]["星期二"] == ["b", "c"]
    assert "第九節" not in got and got["第二節"]["星期一"] == [] and got["中午"]["星期六"] == []
    assert "no" not in str(got)


def test_course_cell(spark):
    cell = spark.sql("select array('C','<T>','L','x','y') d").select(G.course_cell(F.col("d"))).collect()[0][0]
    assert cell.count("course-block") == 2 and "&lt;T&gt;" in cell and cell.count("course-divider") == 1 and cell.count("course-code") == 1


def test_density_gate(spark):
    tables = {1: ["x" * 34] * 4, 2: ["x" * 35] * 4, 3: ["a"] * 3, 4: [" "] * 9}
    cells = spark.createDataFrame([(d, 0, 0, t) for d, ts in tables.items() for t in ts], "doc_id int, page int, tbl int, text string")
    docs = spark.createDataFrame([(d, d != 5) for d in range(1, 7)], "doc_id int, readable boolean")
    assert {r.doc_id: r.has_table for r in G.dense_tables(cells, docs).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_parse_list(spark):
    texts = ["[{'day': 'd', 'details': ['a']}]", '[[{"day": "e"}]]', "[broken", "plain", None, "[{'day': None, 'time': 'None, True', 'details': [\"it's\"]}]", "[[[{'day': 'deep', 'period': True}]]]", "[__import__('os')]"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(G.parse_list(F.col("t")).alias("x")).collect()
    assert got[0].x[0].day == "d" and got[0].x[0].details == ["a"] and got[1].x[0].day == "e"
    assert got[3].x is None and got[4].x is None and got[7].x is None
    assert got[5].x[0].day is None and got[5].x[0].time == "None, True" and got[5].x[0].details == ["it's"] and got[6].x[0].day == "deep"


def test_files(spark, tmp_path):
    for name, body in {"a.pdf": "1", "_u.pdf": "1", ".hid/z.pdf": "1", ".b.pdf": "1", "~$c.docx": "1", "e.pdf": "", "K.PDF": "1", "x.doc": "1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
        os.utime(tmp_path / name, (1000, 1000))
    os.utime(tmp_path / "e.pdf", (2000, 2000))
    os.utime(tmp_path / ".b.pdf", (3000, 3000))
    files = S.walk(spark, str(tmp_path))
    assert {r.file_name for r in S.loadable(files).collect()} == {"a.pdf", "_u.pdf", "z.pdf"}
    assert S.latest_mtime(files).collect()[0].latest == 2000
    saved = lambda x: spark.createDataFrame([(x,)], "saved double")
    assert S.stale(files, None) and S.stale(files, saved(1999.0)) and not S.stale(files, saved(2000.0))
    assert {r.file_name for r in S.scan(spark, str(tmp_path), content=False).collect()} <= {"a.pdf", "K.PDF", "x.doc", "~$c.docx"}


def test_parsers_routes_and_index(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "bad.docx").write_text("no zip")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in S.parsed(S.scan(spark, str(tmp_path)), S.docx_pages).collect()}
    assert rows["d.docx"].text == "one\ntwo" and rows["bad.docx"].error
    files = spark.createDataFrame([(p, p) for p in "abcde"], "path string, file_name string")
    cache = spark.createDataFrame([("a", "cached")], "path string, text string")
    table = spark.createDataFrame([("b", True), ("c", False), ("e", False)], "path string, has_table boolean")
    plain = lambda df: df.withColumn("text", F.when(F.col("path") != "e", F.lit("plain")))
    got = S.documents(files, cache, table, plain, lambda df: df.withColumn("text", F.lit("ocr")))
    assert {(r.path, r.route) for r in got.collect()} == {("a", "cache"), ("b", "ocr"), ("c", "plain"), ("d", "ocr")}
    for n in (3, 5):
        S.save_index(spark.range(n), str(tmp_path / "index"), float(n))
        assert S.load_index(spark, str(tmp_path / "index")).count() == n
    assert S.load_marker(spark, str(tmp_path / "index")).collect()[0].saved == 5.0
    os.rename(tmp_path / "index", tmp_path / "index.old")  # as if the swap had stopped half way
    assert S.load_index(spark, str(tmp_path / "index")).count() == 5 and S.load_marker(spark, str(tmp_path / "index")).collect()[0].saved == 5.0
    S.save_index(spark.range(7), str(tmp_path / "index"), 7.0)
    assert S.load_index(spark, str(tmp_path / "index")).count() == 7 and S.load_index(spark, str(tmp_path / "none")) is None


def test_cells_images_and_transcripts(spark, tmp_path):
    files = spark.createDataFrame([("a", b"2"), ("bad", b"x"), ("c", b"1")], "path string, content binary")
    cells = S.table_cells(files, lambda path, body: [[[["r", None], ["s"]]]] * int(body)).collect()
    assert {(r.path, r.page, r.tbl, r.r, r.c, r.text) for r in cells if r.error is None} == {("a", p, 0, *x) for p in (0, 1) for x in ((0, 0, "r"), (0, 1, None), (1, 0, "s"))} | {("c", 0, 0, *x) for x in ((0, 0, "r"), (0, 1, None), (1, 0, "s"))}
    assert [r.path for r in cells if r.error] == ["bad"]
    images = S.page_images(files, lambda path, body: [bytes([65 + i]) * 60 for i in range(int(body))]).orderBy("path", "page").collect()
    assert [(r.path, r.page) for r in images] == [("a", 0), ("a", 1), ("c", 0)] and images[0].url == "data:image/png;base64," + "QUFB" * 20
    cache = str(tmp_path / "cache")
    assert S.read_transcripts(spark, cache).collect() == []
    write = lambda *rows: S.write_transcripts(spark.createDataFrame(rows, "path string, mtime double, text string"), cache)
    write(("a", 1.0, "old"), ("b", 1.0, ""), ("c", 1.0, None))
    write(("a", 2.0, "new"))
    assert [tuple(r) for r in S.read_transcripts(spark, cache).collect()] == [("a", "new")]


def test_docx_and_pdf_in_one_ingest(spark):
    files = spark.createDataFrame([("a.pdf", "a.pdf"), ("b.docx", "b.docx")], "path string, file_name string")
    none = spark.createDataFrame([], "path string, text string"), spark.createDataFrame([("a.pdf", False)], "path string, has_table boolean")
    parts = lambda df: df.select("path", "file_name", F.explode(F.array(F.lit("one"), F.lit("two"), F.lit(""))).alias("text"))
    got = S.documents(files, *none, lambda df: df.withColumn("text", F.lit("plain")), lambda df: df.withColumn("text", F.lit("ocr")), parts)
    assert sorted((r.path, r.text, r.route) for r in got.collect()) == [("a.pdf", "plain", "plain"), ("b.docx", "one", "docx"), ("b.docx", "two", "docx")]


def test_carry(spark):
    pages = spark.createDataFrame([("p", i, bytes([65 + i])) for i in range(3)], "path string, page int, image binary")
    got = S.carry_pages(pages, lambda image, before: image.decode() + before, n=1).orderBy("page").collect()
    assert [r.text for r in got] == ["A", "BA", "CA"]


def test_replies_are_told_apart(spark):
    """Texts, nothing, and course lists of any depth in both notations; records with more, with less and of other types."""
    deep = "[" * 30 + '{"day": "deep"}' + "]" * 30
    cases = {
        None: ("nothing", 0, None), "": ("nothing", 0, None), " 　": ("nothing", 0, None), "hello": ("text", 0, None), "[]": ("nothing", 0, None), "[[], []]": ("nothing", 0, None), "[[]]": ("nothing", 0, None),
        "[{'day': 'a', 'details': ['x', 1]}]": ("courses", 1, "a"), '[[[{"day": "b", "time": null, "more": {"k": 1}}]]]': ("courses", 1, "b"), deep: ("courses", 1, "deep"),
        "[1, 2]": ("text", 0, None), "[{'day': 'c'}, 3]": ("text", 0, None), "[null]": ("text", 0, None), "[broken": ("text", 0, None), "[broken]": ("text", 0, None),
        " [ [ {'day': 'd'}, {'day': None} ], [{'day': 'z'}] ] ": ("courses", 2, "d"),
    }
    rows = spark.createDataFrame([(x,) for x in cases], "c string").select("c", G.read_reply(F.col("c")).alias("r")).collect()
    got = {r["c"]: (r["r"]["kind"], len(r["r"]["courses"] or []), r["r"]["courses"][0]["day"] if r["r"]["courses"] else None) for r in rows}
    assert got == cases and all((r["r"]["text"] == r["c"]) == (r["r"]["kind"] == "text" or r["c"] is None) for r in rows)


def test_cells_come_in_bounded_batches(spark):
    """Tasks put out cells as they go, not those of all pages or files of a batch together; nulls and errors stay."""
    from lorevane.operators import grids as G
    from lorevane.sources import files as S

    import pyarrow as pa

    got = list(G.in_batches(((i, "x" * 50) for i in range(1000)), pa.schema([("i", pa.int64()), ("t", pa.string())]), most=15_000))
    assert max(b.num_rows for b in got) <= 101 and [x for b in got for x in b.column("i").to_pylist()] == list(range(1000))
    sizes = lambda df: {r["n"] for r in df.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long").collect()}
    page = "<table>" + "<tr><td>a<td>b</tr>" * 500 + "</table>"
    pages = spark.createDataFrame([(i, page) for i in range(200)] + [(200, None)], "page_id long, html string").coalesce(1)
    assert sum(sizes(pages)) == 201 and G.html_cells(pages).count() == 200_000
    files = spark.createDataFrame([("a", b"1|2"), ("b", None), ("c", b"3")], "path string, content binary")
    cells = S.table_cells(files, lambda path, content: [[[content.decode().split("|")]]])
    assert sorted((r["path"], r["c"], r["text"], r["error"]) for r in cells.collect())[0] == ("a", 0, "1", None) and cells.count() == 4
