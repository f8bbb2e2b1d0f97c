import datetime

from pyspark.sql import functions as F

from lorevane.operators import conversation as C
from lorevane.streaming import threads as S


def test_ingest_sees_each_file_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    store = lambda batch, number: seen.extend(sorted(r["value"] for r in batch.collect()))
    run = lambda: S.ingest(spark.readStream.text(str(folder)), store, str(tmp_path / "checkpoint")).awaitTermination()
    (folder / "a.txt").write_text("one")
    run()
    (folder / "b.txt").write_text("two")
    run()
    run()
    assert seen == ["one", "two"]


def test_history_crosses_batches(spark, tmp_path):
    turns, folder = "conv_id long, turn long, text string", str(tmp_path / "turns")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for k in range(2):
        rows = [(c, 3 * k + i, f"{c}{3 * k + i}") for c in (1, 2) for i in range(3)]
        spark.createDataFrame(rows, turns).coalesce(1).write.mode("append").parquet(folder)
        stream = S.running_history(spark.readStream.schema(turns).parquet(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()
    got = {(r["conv_id"], r["turn"]): r["history"] for r in spark.read.parquet(out).collect()}
    assert got[1, 0] == "10" and got[1, 3] == "11 -> 12 -> 13" and got[2, 5] == "23 -> 24 -> 25" and len(got) == 12


def test_null_and_late_turns(spark, tmp_path):
    """Stream and batch agree on nulls; a turn that comes after its followers is put in its place."""
    turns, folder, out, checkpoint = "conv_id long, turn long, text string", *(str(tmp_path / x) for x in ("turns", "out", "checkpoint"))
    for rows in ([(1, 0, None), (1, 1, "a"), (1, 2, None), (2, 0, None)], [(1, 4, "c"), (2, 1, "x")], [(1, 3, "b"), (1, 5, "d")]):
        spark.createDataFrame(rows, turns).coalesce(1).write.mode("append").parquet(folder)
        stream = S.running_history(spark.readStream.schema(turns).parquet(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()
    got = {(r["conv_id"], r["turn"]): r["history"] for r in spark.read.parquet(out).collect()}
    batch = {(r["conv_id"], r["turn"]): r["history"] for r in C.recent(spark.read.parquet(folder)).collect()}
    late = {(1, 4)}  # was put out before turn 3 came
    assert {k: v for k, v in got.items() if k not in late} == {k: v for k, v in batch.items() if k not in late}
    assert got[1, 0] == C.NO_HISTORY and got[1, 4] == "a -> c" and batch[1, 4] == "b -> c" and got[1, 5] == "b -> c -> d"


def test_a_stream_reads_its_own_path_only(spark, tmp_path):
    from lorevane.plans.streams import history_to_table

    for name in ("turns.parquet", "turns.parquet.old"):
        spark.createDataFrame([(1, 0, name)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / name))
    assert [r["history"] for r in history_to_table(spark, str(tmp_path / "turns.parquet"), "true").collect()] == ["turns.parquet"]


def test_expansion_of_questions(spark):
    """A condition joins the question before it; a new department replaces the old one; colleges and general terms are added."""
    rows = [(1, 0, "畢業門檻"), (1, 1, "資工系大學部的"), (1, 2, "那企管系呢"), (2, 0, "資工系畢業門檻"), (2, 1, "那客家系呢"), (3, 0, "借大講堂"), (3, 1, "多少錢"), (4, 0, None)]
    colleges = spark.createDataFrame([("資工系", "資電學院"), ("企管系", "管理學院")], "department string, college string")
    got = {(r["conv_id"], r["turn"]): r["expanded"] for r in C.expansion(spark.createDataFrame(rows, "conv_id long, turn long, text string"), colleges).collect()}
    assert got[1, 1] == "畢業門檻 資工系 資電學院 大學部" and got[1, 2] == "畢業門檻 企管系 管理學院 大學部"
    assert got[2, 1] == "畢業門檻 客家系 全校通用 大學部" and got[3, 1] == "多少錢 全校通用 大學部" and got[4, 0] == "全校通用 大學部"


def test_chat_narrows_and_apologises(spark, tmp_path):
    from lorevane.operators import retrieval as R
    from lorevane.plans import assistant as A

    models = A.Models(embed=lambda x: F.when(x.contains("壞"), None).otherwise(A.hashed_words(x)), classify=lambda x: F.when(x.contains("清楚"), "CLARIFY").otherwise("ACADEMIC"))
    A.index(spark.createDataFrame([(1, "rule one", {"file_name": "r.pdf"})], "doc_id long, text string, metadata map<string,string>"), str(tmp_path / "index"), models)
    rows = [("a", 0, "資工系 rule"), ("a", 1, "不清楚 rule"), ("b", 0, "不清楚"), ("c", 0, "壞 rule")]
    got = {(r["thread_id"], r["turn"]): r for r in A.chat(spark.createDataFrame(rows, "thread_id string, turn int, user_message string"), str(tmp_path / "index"), models).collect()}
    assert got["a", 1]["next_agent"] == "Academic Agent" and got["b", 0]["answer"] == A.CLARIFY
    assert got["c", 0]["answer"] == R.FAILED and got["c", 0]["sources"] == [] and got["a", 0]["sources"] == ["r.pdf"]


def test_log_and_clarification(spark, tmp_path):
    rows = [(1, 0, "畢業門檻"), (1, 1, "資工系的"), (1, 2, "多少"), (1, 3, "嗯"), (1, 4, "好"), (2, 0, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = C.needs_clarification(turns).orderBy("conv_id", "turn").collect()
    assert [r["clarify"] for r in got] == [True, False, False, False, True, True]
    for _ in range(2):
        C.append_messages(turns, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 12


def test_default_classifier(spark):
    texts = spark.createDataFrame([("幫我選課",), ("幫我看看多少錢",), ("必修",), ("資工系畢業門檻是什麼",), ("今天天氣真好啊",)], "t string")
    assert [r[0] for r in texts.select(C.intent_of(C.keyword_intent(F.col("t")))).collect()] == ["Action Agent", "Academic Agent", "Clarification Agent", "Academic Agent", "Fallback Agent"]


def test_pages(spark):
    pages = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a"), ("d", 2, None), ("e", 0, "")], "k string, p int, t string")
    got = {r["k"]: r["text"] for r in C.page_concat(pages, "k", "p", "t").collect()}
    assert got == {"d": "a\n\nb\n\n\n\n", "e": "\n\n"}
    assert C.page_concat(pages, "k", "p", "t", ocr=True).where("k = 'd'").collect()[0]["text"] == "\na\n\n---\n\n\nb\n\n---\n\n\n"
    carried = C.page_carry(pages, "k", "p", "t", n=1).where("k = 'd'").orderBy("p").collect()
    assert [r["carry"] for r in carried] == ["", "a", "b"]


def test_late_turns_correct_their_followers(spark, tmp_path):
    """Turns over batches in any order, nulls and one turn twice: the last revisions are the batch history; timers drop old turns."""
    from lorevane.plans import streams

    turns, folder, out, checkpoint = "conv_id long, turn long, text string, at timestamp", *(str(tmp_path / x) for x in ("turns", "out", "checkpoint"))
    at = lambda t: datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=t)
    batches = [[(1, 4, "e"), (1, 0, "a"), (2, 1, None)], [(1, 2, "c"), (1, 1, "wrong")], [(2, 0, "x"), (1, 3, None), (1, 1, "b")], [(1, 5, "f")]]
    read = lambda: {(r["conv_id"], r["turn"]): r["history"] for r in streams.newest_revisions(spark, out).collect()}
    known = {}
    for rows in batches:
        spark.createDataFrame([(c, t, x, at(t)) for c, t, x in rows], turns).coalesce(1).write.mode("append").parquet(folder)
        streams.corrections_to_table(spark, folder, checkpoint, out)
        known |= {(c, t): x for c, t, x in rows}
        batch = C.recent(spark.createDataFrame([(c, t, x) for (c, t), x in known.items()], "conv_id long, turn long, text string"))
        assert read() == {(r["conv_id"], r["turn"]): r["history"] for r in batch.collect()}
    # A watermark of ten minutes and a horizon of none: turns of an hour ago are dropped but for the two before the next.
    folder, out, checkpoint = (str(tmp_path / f"{x}2") for x in ("turns", "out", "checkpoint"))
    for rows in ([(1, t, f"t{t}") for t in range(5)], [(2, 100, "other")], [(2, 101, "other")], [(1, 102, "late")]):
        spark.createDataFrame([(c, t, x, at(t)) for c, t, x in rows], turns).coalesce(1).write.mode("append").parquet(folder)
        streams.corrections_to_table(spark, folder, checkpoint, out, delay="10 minutes", horizon=0)
    assert read()[1, 102] == "t3 -> t4 -> late"
    spark.conf.set(*S.ROCKSDB)
    state = spark.read.format("statestore").option("stateVarName", "turns").load(checkpoint).select("key.conv_id", "list_element.turn").collect()
    spark.conf.unset(S.ROCKSDB[0])
    assert sorted(r["turn"] for r in state if r["conv_id"] == 1) in ([3, 4, 102], [4, 102])


def test_requests_are_answered_once(spark, tmp_path):
    """Replies of a stream equal the plan over all requests; a batch that is repeated writes nothing."""
    from lorevane.plans import assistant as A
    from lorevane.plans import streams

    docs = spark.createDataFrame([(1, "The fee is ten. It is paid in May."), (2, "A degree takes four years."), (3, None)], "doc_id long, text string").withColumn("metadata", F.create_map(F.lit("file_name"), F.concat("doc_id", F.lit(".pdf"))))
    models = A.Models(classify=lambda text: F.lit("ACADEMIC"))
    path, folder, log, out, checkpoint = (str(tmp_path / x) for x in ("index", "requests", "log", "out", "checkpoint"))
    A.index(docs, path, models)
    asked = [(1, 0, "what is the fee"), (1, 1, "when is it paid"), (2, 0, "how many years"), (2, 1, None)]
    schema = "thread_id long, turn long, user_message string"
    run = lambda where: streams.answer_stream(spark.readStream.schema(schema).parquet(folder), path, log, out, where, models=models).awaitTermination()
    for turn in (0, 1):
        spark.createDataFrame([r for r in asked if r[1] == turn], schema).coalesce(1).write.mode("append").parquet(folder)
        run(checkpoint)
    shown = lambda df: sorted(map(str, df.select("thread_id", "turn", "next_agent", "answer", "sources", "reply").collect()))
    got = shown(spark.read.parquet(out))
    assert got == shown(A.chat(spark.createDataFrame(asked, schema), path, models)) and len(got) == 4
    assert any("The fee is ten. It is paid in May." in r and "1.pdf" in r for r in got)
    last = max((p for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()  # as if the driver had stopped before the commit: the batch comes again under its number
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    run(checkpoint)
    assert shown(spark.read.parquet(out)) == got and {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")} == before


def test_few_round_trips_to_the_state(spark):
    """A thread's batch takes two calls for its turns, two for its revision, and one or two for a timer that changes."""
    import pandas as pd

    calls, timers = [], set()

    class Value:
        held: list = []

        def get(self):
            calls.append("get")
            return iter(self.held) if isinstance(self.held, list) else self.held

        def put(self, held):
            calls.append("put")
            self.held = held

        update = put

    class Handle:
        getListState = getValueState = lambda self, name, schema: Value()
        registerTimer = lambda self, t: (calls.append("register"), timers.add(t))
        deleteTimer = lambda self, t: (calls.append("delete"), timers.remove(t))
        listTimers = lambda self: calls.append("list") or iter(sorted(timers))

    for n in (1, 3):
        processor = S._Corrected("turn long, at long, text string", ("conv_id", "turn"), n, 10)
        processor.init(Handle())
        timers.clear()
        for k, turns in enumerate(([2, 4, 6], [8, 10], [1])):
            calls.clear()
            (got,) = processor.handleInputRows((1,), iter([pd.DataFrame({"turn": turns, "at": turns, "text": list(map(str, turns))})]), None)
            assert set(got["revision"]) == {k + 1} and len(calls) <= 6 and len(timers) == 1
        now = type("now", (), {"getCurrentWatermarkInMs": lambda self: 10_000})()
        timers.clear()
        assert list(processor.handleExpiredTimer((1,), now, None)) == [] and not timers and [t for t, _, _ in processor.turns.held] == ([10] if n == 1 else [8, 10])


def test_an_index_holds_texts_once(spark, tmp_path):
    """Windows are not stored; those of sentences that are found equal the documents' windows, whatever goes at once."""
    from lorevane.operators import retrieval as R
    from lorevane.operators import vector_index as V
    from lorevane.plans import assistant as A

    rows = [(i, None if i % 7 == 0 else " ".join(f"Sentence {j} of {i} says {'word ' * (j % 5)}." for j in range(i % 40)), None if i == 5 else {"file_name": f"{i}.pdf", "window": "old"}) for i in range(-3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, metadata map<string,string>")
    path = str(tmp_path / "index")
    A.index(docs, path)
    nodes = V.load(spark, path)
    want = {r["doc_id"] * A.SENTENCES + r["ord"]: (r["sent"], r["window"]) for r in R.document_windows(docs).collect()}
    assert set(nodes.columns) == {"node_id", "embedding", "distance", "cell"} and {r["node_id"] for r in nodes.collect()} == set(want)
    for at_once in (1_000_000, 100):
        got = A.passages(nodes.select("node_id").union(nodes.select("node_id")), path, at_once)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        held = got.collect()
        assert len(held) == len(want) and {r["node_id"]: r["text"] for r in held} == {k: v[0] for k, v in want.items()}
        assert all(r["metadata"] is None if r["node_id"] // A.SENTENCES == 5 else r["metadata"] == {"file_name": f"{r['node_id'] // A.SENTENCES}.pdf", "window": want[r["node_id"]][1]} for r in held)
    assert A.passages(nodes.where("false"), path).collect() == []


def test_batches_leave_no_working_folders(spark, tmp_path):
    """What a batch of requests writes on its way is deleted, also where it fails; folders of others stay."""
    import pathlib

    from lorevane.plans import assistant as A
    from lorevane.plans import folders, streams

    base = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "lorevane-stream"
    other = folders.working_folder(spark)
    spark.range(1).write.parquet(other)
    docs = spark.createDataFrame([(1, "The fee is ten.", {"file_name": "1.pdf"})], "doc_id long, text string, metadata map<string,string>")
    models = A.Models(classify=lambda text: F.lit("ACADEMIC"))
    path, folder, log, out = (str(tmp_path / x) for x in ("index", "requests", "log", "out"))
    A.index(docs, path, models)
    schema = "thread_id long, turn long, user_message string"
    before = set(base.iterdir())
    for turn in (0, 1):
        spark.createDataFrame([(1, turn, "what is the fee")], schema).coalesce(1).write.mode("append").parquet(folder)
        streams.answer_stream(spark.readStream.schema(schema).parquet(folder), path, log, out, str(tmp_path / "checkpoint"), models=models).awaitTermination()
    assert set(base.iterdir()) == before and spark.read.parquet(out).count() == 2 and spark.read.parquet(other).count() == 1
    made = []
    try:
        with folders.cleared(spark), folders.cleared(spark):
            made.append(folders.working_folder(spark))
            spark.range(1).write.parquet(made[0])
            raise KeyError
    except KeyError:
        pass
    spark.range(1).write.parquet(folders.working_folder(spark))
    assert not folders.exists(spark, made[0]) and len(set(base.iterdir()) - before) == 1
