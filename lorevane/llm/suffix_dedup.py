"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. To distribute the sort so that equal
strings meet, every string of `length` bytes is sent to the anchor inside it: the leftmost window of a quarter of that
length with the smallest hash. Equal strings have equal anchors. The strings of neighbouring starts share an anchor, and
so travel together as one stretch. Only anchors that occur twice matter, and equal stretches (192 bits of hash) travel
once, with their number.

Each task then sorts the suffixes of the stretches it got by the difference cover {1, 2} modulo 3: the sampled suffixes
are sorted by triples of symbols and named; where names repeat, the string of names is sorted the same way; the remaining
suffixes are sorted by their first symbol and the sampled suffix after it, and merged into the order. Then neighbours in
the order are compared on their first `length` bytes. Starts whose prefix is found twice are returned as runs.

An anchor with more than CROWD different stretches is not gathered in a task: the hashes (128 bits) of its strings are
counted instead, which is aggregated before the shuffle.

Null and empty texts have no bytes. Repeated rows are occurrences like any other, so a repeated text of `length` bytes or
more goes as a whole. Very long texts are read in overlapping parts. Empty tables give empty results. digest() drops
extra columns; clean() keeps them and drops the rest of a character that a span cuts through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, sliced, text_bytes

LENGTH = 400
CROWD = 1500
#: Bytes that a task hashes at once, and symbols that it sorts at once (an anchor's group stays whole).
PART, SORT = 1 << 19, 1 << 20
_POSITION_BITS = 22
_MULTIPLIER = 0x9E3779B97F4A7C15
_KEY = ["h", "x", "y", "starts", "rel"]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
_KEY_SCHEMA = "h bigint, x bigint, y bigint, starts int, rel int"
#: No byte of UTF-8; what ends each stretch in a task's text.
_END = b"\xff"


def anchor_size(length: int) -> int:
    """Bytes of the window that is a string's anchor."""
    return max(1, length // 4)


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, made once for a worker and as long as was asked for."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            both = []
            for m in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
                p = np.full(n, m, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            cls.up, cls.down = both
        return cls.up, cls.down


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed polynomial hash of every window of `size` bytes."""
    n = len(data)
    up, down = _Powers.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(data * down[:n], out=total[1:])
    h = (total[size:] - total[:-size]) * up[: n - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` neighbours, by running minima of blocks from both sides."""
    n = len(h)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = h
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(data: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """(first start, number of starts, anchor, anchor's hash) of all stretches of texts laid end to end."""
    none, k = np.zeros(0, np.int64), anchor_size(length)
    if len(data) < length:
        return none, none, none, none
    h = window_hashes(data, k)
    place = np.arange(len(h), dtype=np.uint64)
    best = _smallest((h >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | place, length - k + 1)
    anchor = (best & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    ok = np.ones(len(anchor), bool)  # strings must not run from one text into the next
    for e in ends[:-1]:
        ok[max(0, e - length + 1) : e] = False
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(anchor)))
    use = ok[first]
    first, count = first[use], count[use]
    return first, count, anchor[first], h[anchor[first]].view(np.int64)


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th (hash of the text), start, and _KEY of every stretch of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                group: list[tuple[int, int, bytes]] = []  # (row, where the part begins, bytes)
                size = 0
                for row, text in enumerate(text_bytes(batch.column("text"))):
                    for at in range(0, max(1, len(text) - length + 1), PART):
                        part = text[at : at + PART + length - 1]
                        if len(part) < length:
                            continue
                        if size + len(part) > PART and group:
                            yield emit(batch, group)
                            group, size = [], 0
                        group.append((row, at, part))
                        size += len(part)
                if group:
                    yield emit(batch, group)

    def emit(batch: pa.RecordBatch, group: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        joined = b"".join(p for _, _, p in group)
        ends = np.cumsum([len(p) for _, _, p in group])
        first, count, anchor, h = stretches(np.frombuffer(joined, np.uint8), ends, length)
        part = np.searchsorted(ends, first, side="right")
        begin = np.concatenate([[0], ends[:-1]])[part]
        rows, offsets = np.array([g[0] for g in group])[part], np.array([g[1] for g in group])[part]
        digest = xxhash.xxh3_128_digest
        xy = np.frombuffer(b"".join([digest(joined[a : a + c + length - 1]) for a, c in zip(first.tolist(), count.tolist())]), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows)), batch.column("th").take(pa.array(rows)), pa.array(first - begin + offsets, pa.int64()),
             pa.array(h), pa.array(xy[:, 0]), pa.array(xy[:, 1]), pa.array(count, pa.int32()), pa.array(anchor - first, pa.int32())],
            ["doc_id", "th", "start", *_KEY])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th bigint, start bigint, {_KEY_SCHEMA}")


def _key(*columns: np.ndarray) -> np.ndarray:
    """One number for each row of columns, in the order of the rows: exact, since values that need over 63 bits are ranked first."""
    key = columns[0].astype(np.int64)
    held = max(1, int(key.max(initial=0)).bit_length())
    for c in columns[1:]:
        bits = max(1, int(c.max(initial=0)).bit_length())
        if held + bits > 63:
            key = np.unique(key, return_inverse=True)[1]
            held = max(1, int(key.max(initial=0)).bit_length())
        key, held = key << bits | c, held + bits
    return key


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of text (numbers of at least 1) in their order, by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int32)
    t = np.concatenate([text, np.zeros(4, text.dtype)])
    # Where the length is 1 modulo 3, the empty suffix is sampled too, so that triples of the two residues never touch.
    sampled = np.concatenate([np.arange(1, n + (n % 3 == 1), 3, np.int32), np.arange(2, n, 3, np.int32)])
    triples = _key(t[sampled], t[sampled + 1], t[sampled + 2])
    order = np.argsort(triples)
    new = np.empty(len(order), np.int32)
    new[0] = 1
    np.cumsum(np.diff(triples[order]) != 0, out=new[1:], dtype=np.int32)
    new[1:] += 1
    del triples
    if new[-1] < len(sampled):  # some triples are equal: sort the suffixes of the string of their names
        names = np.empty(len(sampled), np.int32)
        names[order] = new
        order = suffix_array(names)
        del names
    sampled = sampled[order]
    rank = np.zeros(n + 4, np.int32)
    rank[sampled] = np.arange(1, len(sampled) + 1, dtype=np.int32)
    sampled = sampled[sampled < n]
    others = np.arange(0, n, 3, np.int32)
    others = others[np.argsort(_key(t[others], rank[others + 1]))]
    # Merge: how many sampled suffixes of each residue come before each other one.
    residue = sampled % 3
    before = np.arange(len(others))
    for r in (1, 2):
        own = sampled[residue == r]
        both = np.concatenate([own, others])
        keys = _key(*(t[both + i] for i in range(r)), rank[both + r])
        before += np.searchsorted(keys[: len(own)], keys[len(own) :])
    out = np.empty(n, np.int32)
    rest = np.ones(n, bool)
    rest[before] = False
    out[before], out[rest] = others, sampled
    return out


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which of the pairs (a, b) of starts have equal strings of `length` bytes; words: the 8 bytes from every place on."""
    live = np.arange(len(a))
    offsets = [*range(0, length - 7, 8), max(0, length - 8)]
    for k in (offsets[-1], *offsets[:-1]):
        live = live[words[a[live] + k] == words[b[live] + k]]
    return live


def repeated_starts(text: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of text (bytes) whether it is `valid` and its string of `length` bytes begins at another such place.

    The string of a valid place must lie inside the text. Neighbours in the suffix order are compared on the bytes
    themselves. Every eighth place is compared on 7 bytes more, which settles the seven places after it.
    """
    n = len(text)
    order = suffix_array(text.astype(np.int16) + 1)
    padded = np.concatenate([text, np.zeros(length + 15, np.uint8)])
    words = np.zeros(n + length + 8, np.uint64)
    for i in range(8):
        words |= padded[i : i + len(words)].astype(np.uint64) << np.uint64(8 * i)
    hit = np.zeros(n + 8, bool)
    fits = np.concatenate([valid, np.zeros(8, bool)])
    if length >= 8:
        own = np.flatnonzero(order[1:] % 8 == 0)
        a, b = order[own].astype(np.int64), order[own + 1].astype(np.int64)
        same = _equal(words, a, b, length + 7)
        a, b = a[same], b[same]
        for i in range(8):
            both = fits[a + i] & fits[b + i]
            hit[a[both] + i] = hit[b[both] + i] = True
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    open_ = np.flatnonzero(fits[a] & fits[b] & ~(hit[a] & hit[b]))
    a, b = a[open_], b[open_]
    if length >= 8:
        same = _equal(words, a, b, length)
    else:
        mask = np.uint64((1 << 8 * length) - 1)
        same = np.flatnonzero((words[a] ^ words[b]) & mask == 0)
    hit[a[same]] = hit[b[same]] = True
    return hit[:n]


def _runs(flags: np.ndarray) -> list[dict]:
    """Runs of true flags as (from, n)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"at": int(a), "n": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]


_RUNS = f"{_KEY_SCHEMA}, runs array<struct<at:int,n:int>>"


def sort_stretches(held: DataFrame, length: int = LENGTH) -> DataFrame:
    """_KEY and runs of repeated starts of held(_KEY, body), whose rows of one h are together and sorted by h."""
    kinds = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in (*_KEY, "body"))):
                if size >= SORT and row[0] != waiting[-1][0]:
                    yield solve(waiting)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[-1]) + 1
        if waiting:
            yield solve(waiting)

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[:-1]: r for r in rows}.values())  # a repeated row of the table gives its stretches twice
        text = np.frombuffer(_END.join(r[-1] for r in rows) + _END, np.uint8)
        sizes = np.array([len(r[-1]) + 1 for r in rows])
        begin = np.cumsum(sizes) - sizes
        counts = np.array([r[3] for r in rows])
        marks = np.zeros(len(text) + 1, np.int8)
        marks[begin] += 1
        marks[begin + counts] -= 1
        hit = repeated_starts(text, np.cumsum(marks[:-1], dtype=np.int8) > 0, length)
        found = [_runs(hit[a : a + c]) for a, c in zip(begin, counts)]
        some = [i for i, f in enumerate(found) if f]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][k] for i in some], t) for k, t in enumerate(_KINDS)] + [pa.array([found[i] for i in some], kinds)], [*_KEY, "runs"])

    return held.mapInArrow(run, _RUNS)


def count_strings(held: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same as sort_stretches for crowded anchors: hashes of strings are counted, no group is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for first in range(0, whole.num_rows, 200):
                batch = whole.slice(first, 200)
                counts = batch.column("starts").to_numpy()
                hashes = [digest(body[a : a + length]) for body, c in zip(batch.column("body").to_pylist(), counts.tolist()) for a in range(c)]
                s = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                at = np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts)
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in _KEY), pa.array(at, pa.int32()), pa.array(s[:, 0]), pa.array(s[:, 1])], [*_KEY, "at", "s1", "s2"])

    strings = held.mapInArrow(run, f"{_KEY_SCHEMA}, at int, s1 bigint, s2 bigint")
    twice = strings.groupBy("h", "s1", "s2").count().where("count > 1").drop("count")
    found = strings.join(twice.hint("merge"), ["h", "s1", "s2"], "left_semi")  # its size is estimated too low for a broadcast
    return found.groupBy(*_KEY).agg(F.transform(F.collect_list("at"), lambda a: F.struct(a.alias("at"), F.lit(1).alias("n"))).alias("runs"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th, spans (array of start and number of starts) for the texts with repeated strings."""
    marked = materialize(anchors(docs, length))
    # Written, so that both sides of the joins below come from plain shuffles, whose hot keys Spark can split.
    twice = materialize(marked.groupBy("h").count().where("count > 1").select("h"))
    shared = materialize(marked.join(twice, "h", "left_semi"))
    discard(marked)
    # Equal stretches once, with one place where each can be read.
    once = materialize(shared.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "start")).alias("p")))
    groups = once.groupBy("h").agg(F.count("*").alias("different"), F.min("n").alias("least")).where("different > 1 AND least = 1").select("h", "different")
    wanted = once.join(groups, "h").select(*_KEY, "different", "p.*")
    by_text = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", *_KEY, "different")).alias("parts"))
    source = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("body"))
    # Stretches are cut out before rows are made of them, so that a text is not copied for each of its stretches.
    body = lambda c: F.substring(F.col("body"), c["start"].cast("int") + 1, c["starts"] + (length - 1))
    parts = F.transform("parts", lambda c: F.struct(*(c[k].alias(k) for k in (*_KEY, "different")), body(c).alias("body")))
    cut = by_text.join(source, by_text["doc_id"].eqNullSafe(source["d"]) & (by_text["th"] == source["t"])).select(F.explode(parts).alias("c")).select("c.*")
    cut = materialize(cut)
    light = cut.where(F.col("different") <= CROWD).repartition("h").sortWithinPartitions("h").select(*_KEY, "body")
    found = sort_stretches(light, length).union(count_strings(cut.where(F.col("different") > CROWD).dropDuplicates(_KEY).select(*_KEY, "body"), length))
    equal = once.where("n > 1").select(*_KEY, F.array(F.struct(F.lit(0).alias("at"), F.col("starts").alias("n"))).alias("runs"))
    found = materialize(found.union(equal).groupBy(*_KEY).agg(F.flatten(F.collect_list("runs")).alias("runs")))
    discard(twice), discard(once), discard(cut)
    spread = shared.join(found, _KEY).select("doc_id", "th", F.explode(F.transform("runs", lambda r: F.struct((F.col("start") + r["at"]).alias("start"), r["n"].alias("n")))).alias("s"))
    # A set: repeated rows of the table bring the same spans again.
    spans = materialize(spread.groupBy("doc_id", "th").agg(F.collect_set("s").alias("spans")))
    discard(shared), discard(found)
    return spans


def _merged(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Byte ranges that runs of starts cover, merged where they touch."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["start"] + s["n"] - 1 + length) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    found = repeated_spans(docs.select("doc_id", "text"), length).select(F.col("doc_id").alias("__span_id"), F.col("th").alias("__span_th"), F.col("spans").alias("__spans"))
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("__span_id")) & (F.xxhash64(docs["text"]) == F.col("__span_th")), "left").drop("__span_id", "__span_th")


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                rows = []
                for text, spans in zip(text_bytes(batch.column("text")), batch.column("__spans")):
                    ranges = _merged(spans.as_py(), length)
                    hashed, at = hashlib.sha256(), 0
                    for a, b in ranges:
                        hashed.update(text[at:a])
                        at = b
                    hashed.update(text[at:])
                    rows.append((len(text), sum(b - a for a, b in ranges), len(ranges), hashed.hexdigest()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, length).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with every repeated string cut from text, and n_chars, where there is one, counted again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                names = [n for n in batch.schema.names if n != "__spans"]
                column = batch.column("text")
                texts = []
                for text, spans, source in zip(text_bytes(column), batch.column("__spans"), column):
                    found = spans.as_py()
                    if not found:
                        texts.append(source.as_py())
                        continue
                    parts, at = [], 0
                    for a, b in _merged(found, length):
                        parts.append(text[at:a])
                        at = b
                    texts.append(b"".join(p.decode("utf-8", "ignore").encode() for p in [*parts, text[at:]]).decode())
                yield pa.RecordBatch.from_arrays([pa.array(texts, column.type) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names], names)

    out = _with_spans(docs, length).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
