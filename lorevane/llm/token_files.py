"""Token ids as flat files of unsigned integers with 64-bit document offsets, read back through memory maps.

A folder holds, for each part, `N.ids` (the ids of its documents one after the other, little-endian, 16 bits wide where
the vocabulary allows and else 32), `N.offsets` (64-bit: where each document begins in it, and its end) and `N.docs`
(64-bit document ids), and one `index` for all parts: Parquet rows (part, file, width, documents, nulls, tokens,
first_document, first_token). The last two are the bases of a part, prefix sums over the parts before it: a document
starts at first_token plus its own offset.

Documents are dealt to parts by ranges of their id and sorted there, so parts are in ascending order of ids, nulls first;
rows with one id are in the order of a hash of their text. A task writes its part under a name of its own and returns that
name in a row; only the names in committed rows enter the index, so that a task which runs twice leaves no second part.
Names that are not in the index are deleted.

A text is encoded run by run between ASCII white space: no pre-token of the tokenizer file reaches over white space, nor
do its normalisers, so the ids of a text are those of its runs, each encoded by the library once and then remembered. In
the same way marks behind an ASCII letter or digit are encoded by themselves, and ASCII runs in lower case.
Null and empty texts are documents of the end id alone. A null id counts as the smallest. Very long texts and runs are
encoded whole. Repeated rows each get their place. Empty tables give an index without parts. Extra columns are dropped.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, sliced, text_bytes

END_ID = 1
#: Runs that a worker remembers with their ids at most, and the longest that it remembers.
REMEMBERED, LONGEST = 1 << 20, 64
#: ASCII marks but the apostrophe, which begins pre-tokens of its own, and what they may stand behind.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ENDS = frozenset(bytes([c]) for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: Documents that a reader passes on at once.
AT_ONCE = 10_000
INDEX = "part int, file string, width int, documents long, nulls long, tokens long"


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return pafs.FileSystem.from_uri(uri) if urlsplit(uri).scheme else (pafs.LocalFileSystem(), uri)


def _pieces(run: bytes) -> tuple[bytes, ...]:
    """What a run is encoded as: itself, or a word and the marks behind it. A special token's string stays whole."""
    if b"<|" in run or len(run) > LONGEST:
        return (run,)
    word = run.rstrip(_MARKS)
    cut = len(word) if word and word[-1:] in _ENDS else len(run)
    if run.isascii():
        run = run.lower()
    return (run,) if cut == len(run) else (run[:cut], run[cut:])


class Encoder:
    """Ids of whole texts as bytes, by the tokenizers library's file at path."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[bytes, bytes] = {}

    def _ids(self, runs: set[bytes]) -> dict[bytes, bytes]:
        """The ids of each run. Only pieces are remembered, and no long ones."""
        made, cut, known = {}, {}, self.known
        for run in runs:
            ids = known.get(run.lower() if run.isalpha() else run)
            if ids is None:
                cut[run] = _pieces(run)
            else:
                made[run] = ids
        new = list({x for pieces in cut.values() for x in pieces if x not in known})
        long, kind = {}, "H" if self.width == 2 else "I"
        for x in new:
            if x.isalpha() and len(x) <= LONGEST:  # ASCII letters, in lower case here: one pre-token as it stands
                known[x] = array(kind, [t.id for t in self.library.model.tokenize(x.decode())]).tobytes()
        new = [x for x in new if x not in known]
        for first in range(0, len(new), AT_ONCE):
            some = new[first : first + AT_ONCE]
            for x, e in zip(some, self.library.encode_batch_fast([x.decode("utf-8", "replace") for x in some], add_special_tokens=False)):
                (self.known if len(x) <= LONGEST else long)[x] = array(kind, e.ids).tobytes()
        for run, pieces in cut.items():
            made[run] = long[run] if run in long else b"".join([known[x] for x in pieces])
        return made

    def texts(self, texts: list[bytes], end: int) -> Iterator[bytes]:
        """The ids of each text and the end id."""
        last = np.array([end], f"<u{self.width}").tobytes()
        if len(self.known) > REMEMBERED:
            self.known = {}
        split = [t.split() for t in texts]
        made = self._ids({run for runs in split for run in runs})
        for runs in split:
            yield b"".join(map(made.__getitem__, runs)) + last


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _writer(folder: str, tokenizer: str, end: int):
    """A function that writes one part from sorted rows (doc_id, text) and yields its row of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = store_of(folder)
        encoder, name = _encoder(tokenizer), uuid.uuid4().hex
        documents = nulls = tokens = 0
        with fs.open_output_stream(f"{base}/{name}.ids") as ids, fs.open_output_stream(f"{base}/{name}.offsets") as offsets, fs.open_output_stream(f"{base}/{name}.docs") as docs:
            for batch in batches:
                for part in sliced(batch):
                    sizes = []
                    for found in encoder.texts(list(text_bytes(part["text"])), end):
                        ids.write(found)
                        sizes.append(len(found) // encoder.width)
                    ends = tokens + np.cumsum(sizes, dtype="<i8")
                    offsets.write(np.concatenate([[tokens], ends[:-1]]).astype("<i8").tobytes())
                    docs.write(part["doc_id"].fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    documents, nulls, tokens = documents + len(sizes), nulls + part["doc_id"].null_count, int(ends[-1])
            offsets.write(np.array([tokens], "<i8").tobytes())
        if documents:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "width": pa.array([encoder.width], pa.int32()), "documents": [documents], "nulls": [nulls], "tokens": [tokens]})

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END_ID) -> None:
    """Write docs(doc_id, text) as token files into a new folder that driver and executors share.

    One shuffle by ranges of the id. The driver sees a row for each part, of which a part's size bounds the number.
    """
    spark = docs.sparkSession
    fs, base = store_of(folder)
    fs.create_dir(base, recursive=True)
    # Ties of one id are spread too: by their text, and equal rows, whose order says nothing, by where they are read.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"__h": F.xxhash64("text"), "__at": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange("doc_id", "__h", "__at").sortWithinPartitions("doc_id", "__h").select("doc_id", "text")
    rows = materialize(dealt.mapInArrow(_writer(folder, tokenizer, end), INDEX)).orderBy("part").collect()
    bases = np.cumsum([[0, 0], *([r["documents"], r["tokens"]] for r in rows)], axis=0).tolist()
    index = [(i, *r[1:], *bases[i]) for i, r in enumerate(rows)]
    spark.createDataFrame(index, f"{INDEX}, first_document long, first_token long").coalesce(1).write.parquet(f"{folder}/index")
    kept = {r["file"] for r in rows}
    for f in fs.get_file_info(pafs.FileSelector(base)):
        if f.is_file and f.base_name.split(".")[0] not in kept:
            fs.delete_file(f.path)


class Part:
    """One part of a folder: nothing is read before it is asked for, and local files are mapped into memory."""

    def __init__(self, folder: str, file: str, width: int, documents: int, nulls: int) -> None:
        fs, base = store_of(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        self._open = lambda kind: pa.memory_map(f"{base}/{file}.{kind}") if local else fs.open_input_file(f"{base}/{file}.{kind}")
        self.width, self.documents, self.nulls = width, documents, nulls
        self._files = {kind: self._open(kind) for kind in ("ids", "offsets", "docs")}

    def _read(self, kind: str, first: int, n: int, dtype: str) -> np.ndarray:
        size = np.dtype(dtype).itemsize
        f = self._files[kind]
        f.seek(first * size)
        return np.frombuffer(f.read_buffer(n * size), dtype)

    def offsets(self, first: int, n: int) -> np.ndarray:
        """Where n documents from the first on begin, and where the last ends."""
        return self._read("offsets", first, n + 1, "<i8")

    def doc_ids(self, first: int, n: int) -> list[int | None]:
        return [None if first + i < self.nulls else x for i, x in enumerate(self._read("docs", first, n, "<i8").tolist())]

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from one offset to another."""
        return self._read("ids", begin, end - begin, f"<u{self.width}")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """part, file, width, documents, nulls, tokens, first_document, first_token of every part."""
    return spark.read.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a folder, from its files.

    start: the ids of all documents before it. A task maps one part and passes over it by AT_ONCE documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                part = Part(folder, r["file"], r["width"], r["documents"], r["nulls"])
                for first in range(0, part.documents, AT_ONCE):
                    n = min(AT_ONCE, part.documents - first)
                    at = part.offsets(first, n)
                    crc = [zlib.crc32(part.ids(a, b).astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(part.doc_ids(first, n), pa.int64()), "start": pa.array(at[:-1] + r["first_token"]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})

    index = read_index(spark, folder)
    parts = index.repartitionByRange(max(1, index.count()), "first_token")
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, written as token files and read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{shared_dir(docs.sparkSession)}/lorevane/{uuid.uuid4().hex}"
    write(docs, folder, tokenizer)
    return read(docs.sparkSession, folder)
