"""Files as a source: manifest, format dispatch, three-way routes with injected parsers, freshness, index."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grids as G

MANIFEST = "path string, file_name string, length bigint, mtime double"


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path, file_name, length, mtime of every file under a folder that driver and executors see, hidden folders and empty
    files included. Tasks list the folders, one level after the other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for folder in frame["path"]:
                for entry in os.scandir(folder):
                    is_folder = entry.is_dir(follow_symlinks=False)
                    stat = None if is_folder else entry.stat()
                    rows.append((entry.path, entry.name, 0 if is_folder else stat.st_size, 0.0 if is_folder else stat.st_mtime, is_folder))
            yield pd.DataFrame(rows, columns=["path", "file_name", "length", "mtime", "is_folder"])

    level, files = spark.createDataFrame([(root,)], "path string"), spark.createDataFrame([], MANIFEST)
    while not level.isEmpty():
        listed = level.repartition("path").mapInPandas(run, f"{MANIFEST}, is_folder boolean").persist()
        files = files.union(listed.where("NOT is_folder").drop("is_folder"))
        level = listed.where("is_folder").select("path")
    return files


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """The same from any store that Spark reads, with content; Spark leaves out empty files and names that start with . or _."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", (F.unix_micros("modificationTime") / 1e6).alias("mtime"), *(["content"] if content else []))
    return named


def visible(name: Column) -> Column:
    return ~(name.startswith(".") | name.startswith("~$"))


def loadable(files: DataFrame) -> DataFrame:
    """Files to read, with kind: not hidden, not temporary, not empty, .pdf or .docx (in lower case)."""
    kind = F.when(F.col("file_name").endswith(".pdf"), "pdf").when(F.col("file_name").endswith(".docx"), "docx")
    return files.where(visible(F.col("file_name")) & (F.col("length") > 0)).withColumn("kind", kind).where("kind IS NOT NULL")


def latest_mtime(files: DataFrame) -> DataFrame:
    """One row: the newest mtime of all files but hidden and temporary ones, 0 without any."""
    return files.where(visible(F.col("file_name"))).agg(F.coalesce(F.max("mtime"), F.lit(0.0)).alias("latest"))


def freshness(files: DataFrame, markers: DataFrame, by: str) -> DataFrame:
    """by, latest, saved, rebuild: whether each index must be built anew, for files(by, file_name, mtime) and markers(by, saved).

    It must where there is no marker, or a file is newer than it; hidden and temporary files don't count.
    """
    latest = files.groupBy(by).agg(F.coalesce(F.max(F.when(visible(F.col("file_name")), F.col("mtime"))), F.lit(0.0)).alias("latest"))
    return latest.join(markers.groupBy(by).agg(F.max("saved").alias("saved")), by, "left").withColumn("rebuild", F.coalesce(F.col("latest") > F.col("saved"), F.lit(True)))


def stale(files: DataFrame, marker: DataFrame | None) -> bool:
    """The same for one index as a whole."""
    if marker is None:
        return True
    one = lambda df: df.withColumn("__index", F.lit(0))
    found = freshness(one(files), one(marker), "__index").collect()
    return found[0]["rebuild"] if found else marker.agg(F.max("saved")).collect()[0][0] is None


def _read(files: DataFrame, rows_of: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    """The rows of each of files(path, content), as rows_of(path, content) gives them; of a file that it cannot read one row
    of nulls between path and error. A task holds the rows of one file and a bounded number of others."""
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for path, content in zip(batch.column("path"), batch.column("content")):
            path = path.as_py()
            try:
                found = rows_of(path, bytes(content.as_py()))
            except Exception as e:  # noqa: BLE001  a bad file must not stop the others
                found = [(path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")]
            yield from found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, pa.int32() if n in ("page", "tbl", "r", "c") else pa.string()) for n in names])
        for batch in batches:
            yield from G.in_batches(rows(batch), kinds)

    return files.select("path", "content").mapInArrow(run, schema)


def parsed(files: DataFrame, parser: Callable[[str, bytes], list[str]], schema: str = "path string, page int, text string, error string") -> DataFrame:
    """path, page, text, error: an injected parser's pages; a file that it cannot read is one row with its error."""

    return _read(files, lambda path, content: [(path, i, text, None) for i, text in enumerate(parser(path, content))], schema)


def docx_pages(path: str, content: bytes) -> list[str]:
    """The paragraphs of a .docx file as one page."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return ["\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))]


def table_cells(files: DataFrame, parser: Callable[[str, bytes], list]) -> DataFrame:
    """path, page, tbl, r, c, text, error of every cell that an injected parser finds: a list of tables for each page, a
    table being rows of texts. A file that it cannot read is one row with its error."""

    cells = lambda path, content: [(path, p, t, r, c, x, None) for p, page in enumerate(parser(path, content)) for t, table in enumerate(page) for r, row in enumerate(table) for c, x in enumerate(row)]
    return _read(files, cells, "path string, page int, tbl int, r int, c int, text string, error string")


def has_tables(files: DataFrame, parser: Callable[[str, bytes], list]) -> DataFrame:
    """path, has_table of every file: whether table_cells finds a dense table there; true for a file that cannot be read."""
    text = T.strip(F.coalesce("text", F.lit("")))
    one = table_cells(files, parser).groupBy("path", "page", "tbl").agg(F.count_if(text != "").alias("n"), F.sum(F.length(text)).alias("chars"), F.max("error").alias("error"))
    dense = one.groupBy("path").agg(F.bool_or(F.col("error").isNotNull() | ((F.col("n") > 0) & G.dense(F.greatest("n", F.lit(1)), F.col("chars")))).alias("has_table"))
    return files.select("path").join(dense, "path", "left").withColumn("has_table", F.coalesce("has_table", F.lit(False)))


def page_images(files: DataFrame, rasterise: Callable[[str, bytes], list[bytes]]) -> DataFrame:
    """path, page, image, url (the image as base64 text): the pages that an injected function draws. Files that it cannot
    read are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame.itertuples(index=False):
                try:
                    images = rasterise(path, bytes(content))
                except Exception:  # noqa: BLE001
                    continue
                yield pd.DataFrame({"path": path, "page": range(len(images)), "image": images})

    return files.select("path", "content").mapInPandas(run, "path string, page int, image binary").withColumn("url", T.data_url(F.col("image")))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the transcripts cached at `path`: the newest of each file; none where there is no cache yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "path string, text string")
    return spark.read.parquet(path).groupBy("path").agg(F.max_by("text", F.struct("mtime", "text")).alias("text"))


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    """Add transcripts(path, mtime, text) to the cache; null and empty ones are not kept."""
    transcripts.where("text IS NOT NULL AND text <> ''").select("path", "mtime", "text").write.mode("append").parquet(path)


def documents(files: DataFrame, cache: DataFrame, has_table: DataFrame, plain: Callable[[DataFrame], DataFrame], ocr: Callable[[DataFrame], DataFrame], docx: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """path, file_name, text, route of files: .pdf files from the cache(path, text), else by OCR where there is a table, else
    plain; .docx files by docx, which may give several rows for a file.

    The routes are separate branches, so that OCR runs on no other files. Null and empty texts are left out.
    """
    is_docx = F.col("file_name").endswith(".docx")
    keyed = files.where(~is_docx) if docx is not None else files
    keyed = keyed.join(cache.select("path", F.col("text").alias("cached")), "path", "left").join(has_table.select("path", "has_table"), "path", "left")
    hit = keyed.where("cached IS NOT NULL").select("path", "file_name", F.col("cached").alias("text"), F.lit("cache").alias("route"))
    rest = keyed.where("cached IS NULL").drop("cached")
    table = F.coalesce("has_table", F.lit(True))  # a file that could not be probed is treated as having tables
    by_ocr = ocr(rest.where(table)).select("path", "file_name", "text", F.lit("ocr").alias("route"))
    by_text = plain(rest.where(~table)).select("path", "file_name", "text", F.lit("plain").alias("route"))
    out = hit.unionByName(by_ocr).unionByName(by_text)
    if docx is not None:
        out = out.unionByName(docx(files.where(is_docx)).select("path", "file_name", "text", F.lit("docx").alias("route")))
    return out.where("text IS NOT NULL AND text <> ''")


def carry_pages(pages: DataFrame, transcribe: Callable[[bytes, str], str], key: str = "path", n: int = 400) -> DataFrame:
    """key, page, text: pages(key, page, image) transcribed in order, each told the last n characters of the one before."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        before, out = "", []
        for row in frame.sort_values("page").itertuples(index=False):
            before = transcribe(row.image, before[-n:])
            out.append((frame[key].iloc[0], row.page, before))
        return pd.DataFrame(out, columns=[key, "page", "text"])

    return pages.select(key, "page", "image").groupBy(key).applyInPandas(run, f"{key} {kind}, page int, text string")


def save_index(nodes: DataFrame, path: str, latest: float) -> None:
    """Write the index and the marker of what it covers into a new folder, then put it in the old one's place.

    The marker lies inside, so the two always agree. A stop between the two renames leaves the old folder beside the new
    one, and load_index finds whichever is whole.
    """
    spark = nodes.sparkSession
    nodes.write.mode("overwrite").parquet(f"{path}.new/nodes")
    spark.createDataFrame([(latest,)], "saved double").coalesce(1).write.mode("overwrite").parquet(f"{path}.new/marker")
    fs, now, new, old = _folders(spark, path)
    if fs.exists(now):
        fs.delete(old, True)
        fs.rename(now, old)
    fs.rename(new, now)
    fs.delete(old, True)


def _folders(spark: SparkSession, path: str):
    now, new, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}{s}") for s in ("", ".new", ".old"))
    return now.getFileSystem(spark._jsc.hadoopConfiguration()), now, new, old


def _index_part(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    fs, now, _, old = _folders(spark, path)
    for folder in (now, old):
        if fs.exists(folder):
            return spark.read.parquet(f"{folder.toString()}/{part}")
    return None


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The nodes of the index at path; None where there is none."""
    return _index_part(spark, path, "nodes")


def load_marker(spark: SparkSession, path: str) -> DataFrame | None:
    """saved: up to when the index at path covers its files; None where there is none."""
    return _index_part(spark, path, "marker")
