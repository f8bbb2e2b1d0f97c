"""Best-fit packing of tokenised documents into sequences.

A document is its token ids and then the end id. One longer than a sequence is cut into full pieces, its first piece
takes what is left over. A piece asks for a vector of capacities: tokens, one document, and attention cost (the square
of its length). Pieces are placed by falling length; each goes to the open sequence where it fits under every
constraint and that the rule prefers: the smallest weighted norm of what would remain, or the largest weighted dot
product of the request with what remains now.

The vector of a piece follows from its length alone, so pieces of one length are alike, and so are sequences that have
been filled alike. The driver therefore packs a histogram of at most SEQUENCE lengths, with runs of like sequences in
place of single ones, and the result does not depend on the number of documents. Executors number the pieces of each
length and look their places up. One task never sees all pieces.

Null and empty texts are documents of the end id alone. Repeated rows are packed each on its own. Pieces of one length are
numbered by slices of a hash of their document's id, then by the id, so ties between sequences fall the same way each time: to the one opened first. Very long texts are
tokenised whole, and so are very long runs of white space. Empty tables give empty results. Extra columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sliced

SEQUENCE = 1024
END_ID = 2
#: Pieces of a length are numbered in so many slices at once, so that no length is one task's work.
SLICES = 4096
#: A text with this in it goes through the tokenizer file itself, which knows the string as one token.
SPECIAL = "<|endoftext|>"
#: So does a text with so long a run of white space: the quick way backs up over such a run on the machine's stack.
_LONG_SPACE = 10_000
_SPACES = re.compile(r"\s{%d}" % _LONG_SPACE)


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, the weights of their dimensions, and the rule that picks a sequence."""

    tokens: int = SEQUENCE
    documents: int = SEQUENCE
    attention: int = SEQUENCE * SEQUENCE
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"


@dataclass
class Plan:
    """Pieces of length[i] numbered from rank[i] on go to sequences from sequence[i] on, at offset[i]."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0


def best_fit(histogram: dict[int, int], limits: Limits = Limits()) -> Plan:
    """Vector best fit of a histogram of lengths. Runs of sequences with equal residuals move together."""
    plan = Plan()
    caps = np.array([limits.tokens, limits.documents, limits.attention], float)
    weights = np.array(limits.weights, float)
    room = np.zeros((0, 3))  # residual of each run of open sequences
    many: list[int] = []  # how many sequences the run has
    first: list[int] = []  # its first sequence
    for length in sorted(histogram, reverse=True):
        left, rank = int(histogram[length]), 0
        ask = np.array([length, 1, length * length], float)
        if (ask > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")

        def put(run_first: int, n: int, used: int) -> None:
            nonlocal rank, left
            plan.length.append(length), plan.rank.append(rank), plan.sequence.append(run_first), plan.offset.append(used)
            rank, left = rank + n, left - n

        while left:
            after = (room - ask) / caps
            fits = (after >= 0).all(axis=1)
            if not fits.any():
                break
            if limits.rule == "dot":
                worth = np.where(fits, -((ask / caps * room / caps) @ weights), np.inf)
            else:
                worth = np.where(fits, (after * after) @ weights, np.inf)
            i = int(worth.argmin())
            n = min(left, many[i])
            put(first[i], n, limits.tokens - int(room[i, 0]))
            if n < many[i]:  # the rest of the run stays as it was
                room = np.vstack([room, room[i]])
                many.append(many[i] - n), first.append(first[i] + n)
                many[i] = n
            room[i] -= ask
            if room[i, 0] < 1 or room[i, 1] < 1:
                room = np.delete(room, i, axis=0)
                del many[i], first[i]
        while left:  # open new ones; a sequence takes as many of this length as it can
            each = int(min(left, limits.tokens // length, limits.documents, limits.attention // (length * length)))
            n = left // each
            for k in range(each):
                put(plan.sequences, n, k * length)
            rest = caps - ask * each
            if rest[0] >= 1 and rest[1] >= 1:
                room = np.vstack([room, rest])
                many.append(n), first.append(plan.sequences)
            plan.sequences += n
    return plan


_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    """(encode a list of texts to lists of ids) for a tokenizer file; ranks beside it give the same ids faster."""
    if path not in _TOKENIZERS:
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        ranks_file = path.removesuffix(".json") + ".tiktoken"
        quick = None
        if os.path.exists(ranks_file):
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if quick is not None and SPECIAL not in text and not (len(text) >= _LONG_SPACE and _SPACES.search(text)):
                try:
                    return quick.encode_ordinary(text)
                except BaseException as e:  # a panic of the library is no Exception
                    if type(e).__name__ != "PanicException":
                        raise
            return whole.encode(text, add_special_tokens=False).ids

        _TOKENIZERS[path] = encode
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece of docs(doc_id, text)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer)
        for whole in batches:
            for batch in sliced(whole):
                rows: list[list] = [[], [], [], [], [], []]
                for i, text in enumerate(batch.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    start, number = 0, 0
                    while start < len(ids):
                        stop = start + ((len(ids) - start - 1) % sequence + 1 if number == 0 else sequence)
                        part = ids[start:stop]
                        for column, value in zip(rows, (i, number, start, stop - start, zlib.crc32(part.tobytes()), part.astype("i4") if with_ids else None)):
                            column.append(value)
                        start, number = stop, number + 1
                columns = [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(rows[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def place(cut: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """cut (a table that was written) with sequence_id and offset for every row, by its column length."""
    counts = materialize(cut.groupBy("length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)).cast("int").alias("slice")).count())
    plan = best_fit({int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, limits)
    order = np.lexsort((plan.rank, plan.length))
    lengths, ranks, sequences, offsets = (np.array(x, np.int64)[order] for x in (plan.length, plan.rank, plan.sequence, plan.offset))
    keys = lengths * (1 << 46) + ranks

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        i = np.searchsorted(keys, length.to_numpy() * (1 << 46) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[i] + rank.to_numpy() - ranks[i], "offset": offsets[i]})

    # The rank that each slice of each length starts from: at most SEQUENCE * SLICES rows.
    starts = counts.select("length", "slice", (F.sum("count").over(Window.partitionBy("length").orderBy("slice")) - F.col("count")).alias("before"))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece")
    sliced_up = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)).cast("int"))
    # One shuffle serves the numbering and the join.
    numbered = sliced_up.repartition("length", "slice").withColumn("k", F.row_number().over(inside) - 1)
    ranked = numbered.join(starts, ["length", "slice"]).withColumn("to", look_up("length", (F.col("before") + F.col("k")).cast("long")))
    return ranked.select(*cut.columns, F.col("to.sequence_id").alias("sequence_id"), F.col("to.offset").alias("offset"))


def pack(docs: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(), end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of docs with its place; with_ids adds the token ids, from which sequences() builds rows to train on."""
    return place(materialize(pieces(docs, tokenizer, limits.tokens, end_id, with_ids)), limits)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, lengths of every sequence of pack(..., with_ids=True); a sequence has at most `documents` pieces."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return packed.groupBy("sequence_id").agg(held.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def digest(docs: DataFrame) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(docs.select("doc_id", "text"))
