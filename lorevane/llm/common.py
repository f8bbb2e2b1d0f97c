"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word in most contracts: space and the five ASCII controls 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]"
#: bytes.translate table that lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Texts are worked on in slices of about so many bytes inside a Python task.
SLICE_BYTES = 8 << 20


_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where a local session names none. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="lorevane-checkpoint-"))
        found = _OWN_DIR[0]
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lorevane/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lorevane_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialize() result that nothing reads any more."""
    path = getattr(df, "_lorevane_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remainder_of_id(n: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def first_by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows: those whose key has the smallest hashes, the same at every partitioning.

    A bound on the hash, from the number of rows, leaves about half as many again to be sorted, so that a large table
    does not send `most` rows from each partition to one task.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    n = rows.count()
    if n > 2 * most:
        rows = rows.where(place < int((1 << 40) * (1.5 * most + 100) / n))
    return rows.orderBy(place, key).limit(most)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    for x in column:
        yield x.as_py() or b""


def sliced(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes; a single longer text stays whole."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield batch.slice(at)
