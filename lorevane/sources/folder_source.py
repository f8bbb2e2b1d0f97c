"""Files of a folder as a data source, read with filters that are pushed to the listing, and written once under each name.

    register(spark)
    spark.read.format("folder").load(root)                     path, file_name, length, mtime, content, error
    files(spark, root, name_ends=".pdf", least=1)              the same of some files only; no other one is opened
    files.write.format("folder").mode("append").save(root)     of files(file_name, content)

Reading lists folders in tasks, each of a range of them; hidden folders and empty files count. With the option
pushdown=true filters on file_name and length are applied before a file is opened; content=false opens none. A file that
cannot be read is one row with its error. Any store that pyarrow.fs knows can be read. Spark 4.1 keeps what was pushed into
a DataFrame of a Python source, and a later query of the same DataFrame without filters would get it too: so pushdown is
off by default, and files() switches it on behind filters that every query of its result has.

Writing puts each file under a name of its own into `_staged` first. Only when all tasks have succeeded, commit links the
files of their last attempts to their names; a name that is there already keeps its file, whoever put it there, since making
a link to a name that exists fails. So neither a repeated task nor a second run at the same time leaves a second file, and a
run that fails leaves none. Writing needs a file system with links that driver and executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, file_name string, length bigint, mtime double, content binary, error string"
STAGED = "_staged"
#: What a filter on a column says of a value.
_TESTS = {
    EqualTo: lambda x, y: x == y, In: lambda x, y: x in y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y,
    LessThanOrEqual: lambda x, y: x <= y, StringStartsWith: lambda x, y: x.startswith(y), StringEndsWith: lambda x, y: x.endswith(y), StringContains: lambda x, y: y in x,
}


def _store(root: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


@dataclass
class Folders(InputPartition):
    """Folders whose own files are one task's work."""

    folders: list[str]


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.content = options["path"], options.get("content", "true").lower() != "false"
        self.parts = int(options.get("partitions", "64"))
        self.push, self.tests = options.get("pushdown", "false").lower() == "true", []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if self.push and type(f) in _TESTS and column in ("file_name", "length"):
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Folders]:
        """Every folder under the root; the driver sees folders only."""
        import pyarrow.fs as pafs

        fs, base = _store(self.root)
        level, folders = [base], [base]
        while level:
            level = [f.path for folder in level for f in fs.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.Directory and f.base_name != STAGED]
            folders += level
        size = -(-len(folders) // self.parts)
        folders.sort()
        return [Folders(folders[i : i + size]) for i in range(0, len(folders), size)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs, _ = _store(self.root)
        for folder in partition.folders:
            for f in fs.get_file_info(pafs.FileSelector(folder)):
                given = {"file_name": f.base_name, "length": f.size}
                if f.type != pafs.FileType.File or not all(_TESTS[kind](given[column], value) for column, kind, value in self.tests):
                    continue
                content = error = None
                if self.content:
                    try:
                        with fs.open_input_stream(f.path) as stream:
                            content = stream.read()
                    except Exception as e:  # noqa: BLE001  a bad file must not stop the others
                        error = f"{type(e).__name__}: {e}"
                yield f.path, f.base_name, f.size, f.mtime_ns / 1e9, content, error


@dataclass
class Staged(WriterCommitMessage):
    """The files of a task: their names, and those they have until commit."""

    names: list[tuple[str, str]] = field(default_factory=list)


class FolderWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file://").removeprefix("file:")
        self.staged = f"{self.root}/{STAGED}/{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Staged:
        os.makedirs(self.staged, exist_ok=True)
        out = Staged()
        for row in rows:
            if "/" in row.file_name or row.file_name in ("", ".", ".."):
                raise ValueError(f"no name for a file: {row.file_name!r}")
            own = f"{self.staged}/{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                f.write(row.content or b"")
            out.names.append((row.file_name, own))
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        for m in messages:
            for name, own in m.names if m else ():
                try:
                    os.link(own, f"{self.root}/{name}")
                except FileExistsError:
                    pass  # the first writer's file stays
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        if overwrite:
            raise ValueError("files under names that exist are kept: write in mode append")
        return FolderWriter(dict(self.options))


def files(spark: SparkSession, root: str, name_starts: str | None = None, name_ends: str | None = None, least: int | None = None, most: int | None = None, **options) -> DataFrame:
    """The files under root whose name starts and ends so and whose length is in these bounds; no other file is opened."""
    register(spark)
    asked = [test(F.col(c), x) for test, c, x in (
        (Column.startswith, "file_name", name_starts), (Column.endswith, "file_name", name_ends), (Column.__ge__, "length", least), (Column.__le__, "length", most),
    ) if x is not None]
    out = spark.read.format("folder").options(**options, pushdown=str(bool(asked)).lower()).load(root)
    for test in asked:
        out = out.where(test)
    return out


def register(spark: SparkSession) -> None:
    """Make the format known to this session, with filters pushed to it."""
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
