"""The folder data source against walk, and the committing sink under failures and two runs."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lorevane.sources import files as S
from lorevane.sources import folder_source as D


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "files"
    for name, body in {"a.pdf": b"one", ".hidden.pdf": b"two", "_u.pdf": b"three", "sub/empty.pdf": b"", "sub/deep/c.docx": b"four", ".h/z.pdf": b"five", "é 1.pdf": b"six"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    (root / "none").mkdir()
    return root


@pytest.mark.parametrize("scheme", ["", "file://"])
@pytest.mark.parametrize("parts", ["1", "3", "64"])
def test_equals_walk(spark, folder, scheme, parts):
    D.register(spark)
    got = spark.read.format("folder").option("partitions", parts).load(f"{scheme}{folder}")
    rows = lambda df: sorted((r["path"], r["file_name"], r["length"], round(r["mtime"], 3)) for r in df.collect())
    assert rows(got) == rows(S.walk(spark, str(folder))) and got.count() == 7
    assert {r["file_name"]: bytes(r["content"]) for r in got.collect()}["é 1.pdf"] == b"six"
    assert got.rdd.getNumPartitions() == min(int(parts), 5)
    bare = spark.read.format("folder").option("content", "false").load(str(folder))
    assert bare.where("content IS NULL AND error IS NULL").count() == 7


def test_a_pushed_filter_opens_fewer_files(folder, monkeypatch):
    """What the reader is asked for decides which files it opens; other filters are left to Spark."""
    import pyarrow.fs as pafs

    opened = []

    class Watched:
        def __init__(self, fs):
            self.fs = fs

        def get_file_info(self, x):
            return self.fs.get_file_info(x)

        def open_input_stream(self, path):
            opened.append(os.path.basename(path))
            return self.fs.open_input_stream(path)

    monkeypatch.setattr(D, "_store", lambda root: (Watched(pafs.LocalFileSystem()), root))
    reader = D.FolderReader({"path": str(folder), "pushdown": "true"})
    left = list(reader.pushFilters([D.StringEndsWith(("file_name",), ".pdf"), D.GreaterThan(("length",), 3), D.EqualTo(("error",), "x")]))
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert left == [D.EqualTo(("error",), "x")] and sorted(opened) == sorted(r[1] for r in got) == ["_u.pdf", "z.pdf"]


def test_filters_in_a_plan(spark, folder):
    """Pushed or not, each query of a DataFrame has its own filters, whichever came before."""
    D.register(spark)
    for got in (spark.read.format("folder").load(str(folder)), D.files(spark, str(folder), least=0)):
        names = lambda where: sorted(r["file_name"] for r in got.where(where).collect())
        for _ in range(2):
            assert names("length = 0") == ["empty.pdf"] and names("file_name IN ('a.pdf', 'c.docx', 'x')") == ["a.pdf", "c.docx"]
            assert names("file_name LIKE '%.docx' OR length > 4") == ["_u.pdf", "c.docx"] and names("file_name IS NULL") == [] and len(names("true")) == 7
    some = D.files(spark, str(folder), name_starts="_", name_ends=".pdf", least=1, most=5)
    assert [r["file_name"] for r in some.collect()] == ["_u.pdf"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert ">=" not in plan and "StartsWith" not in plan  # the source has taken them


def test_a_file_that_cannot_be_read_is_one_row(spark, folder):
    D.register(spark)
    (folder / "gone.pdf").symlink_to(folder / "nowhere")
    reader = D.FolderReader({"path": str(folder)})
    reader.content = True
    real = D._store

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def get_file_info(self, x):
            return self.fs.get_file_info(x)

        def open_input_stream(self, path):
            if path.endswith("a.pdf"):
                raise OSError("bad sector")
            return self.fs.open_input_stream(path)

    D._store = lambda root: (Broken(real(root)[0]), real(root)[1])
    try:
        got = {r[1]: r for p in reader.partitions() for r in reader.read(p)}
    finally:
        D._store = real
    assert got["a.pdf"][4] is None and got["a.pdf"][5] == "OSError: bad sector" and got["_u.pdf"][4] == b"three" and len(got) == 7


def stored(root):
    return {p.name: p.read_bytes() for p in root.iterdir() if p.is_file()}


def test_names_are_stored_once(spark, tmp_path):
    """Names twice in a run and in two runs: the first file stays; nothing is left staged."""
    D.register(spark)
    root = tmp_path / "out"
    save = lambda rows, n=2: spark.createDataFrame(rows, "file_name string, content binary").repartition(n).write.format("folder").mode("append").save(str(root))
    save([("a", b"1"), ("b", None)])
    save([("a", b"2"), ("c", b"3"), ("d", b""), ("c", b"3")], 4)
    assert stored(root) == {"a": b"1", "b": b"", "c": b"3", "d": b""} and list((root / D.STAGED).iterdir()) == []
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([("a", b"x")], "file_name string, content binary").write.format("folder").mode("overwrite").save(str(root))


def test_a_task_that_fails_after_its_write_leaves_nothing(spark, tmp_path):
    D.register(spark)
    root = tmp_path / "out"
    rows = spark.range(8).repartition(2).select(F.concat(F.lit("f"), "id").alias("file_name"), F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="stop"):
        rows.write.format("folder").mode("append").save(str(root))
    assert not root.exists() or stored(root) == {}
    spark.range(8).select(F.concat(F.lit("f"), "id").alias("file_name"), F.lit("y").cast("binary").alias("content")).write.format("folder").mode("append").save(str(root))
    assert stored(root) == {f"f{i}": b"y" for i in range(8)}


def test_attempts_and_runs_at_once(tmp_path):
    """A task that ran twice names the files of one attempt; two runs that commit after one another keep the first's files."""
    root = tmp_path / "out"
    one, two = (D.FolderWriter({"path": f"file://{root}"}) for _ in range(2))
    rows = lambda body: iter([Row(file_name="a", content=body), Row(file_name="b", content=body)])
    one.write(rows(b"lost attempt"))
    first, second = one.write(rows(b"first")), two.write(iter([Row(file_name="b", content=b"second"), Row(file_name="c", content=b"second")]))
    one.commit([first, None])
    two.commit([second])
    assert stored(root) == {"a": b"first", "b": b"first", "c": b"second"} and list((root / D.STAGED).iterdir()) == []
    third = D.FolderWriter({"path": str(root)})
    third.abort([third.write(rows(b"third"))])
    assert stored(root) == {"a": b"first", "b": b"first", "c": b"second"}
    with pytest.raises(ValueError):
        third.write(iter([Row(file_name="../x", content=b"")]))
