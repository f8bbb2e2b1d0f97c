"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of a partition's documents. Its words become symbols; only runs of words that all occur in the
benchmark, and that are long enough for a phrase, can hold one, so the index covers those runs, each ended by a
separator of its own. The index is the Burrows-Wheeler transform of the runs in a wavelet matrix, and positions of
sampled suffixes. All benchmark phrases are searched backward at once; occurrences walk to a sampled suffix. Hit words
are merged into spans.

The benchmark is read in blocks of about BLOCK_WORDS words, kept as arrays; the driver and a task hold one block at a
time. Documents are read once, whatever the number of blocks, and never shuffled. Null and empty texts have no words.
Null item texts never occur. An item with a null id has no name to report: its words are hit, but it is not counted.
Repeated items count under their ids. An empty benchmark leaves every document clean. Repeated rows are judged each on
its own. Very long texts are worked on whole. digest() drops extra columns, clean() keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_bytes

PHRASE = 10
#: About 16 bytes for each word of a block, and its different words once.
BLOCK_WORDS = 2_000_000
SAMPLE_EVERY = 8
#: ASCII bytes but digits and letters end a word; A-Z are lower-cased; other bytes are parts of words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the different pairs (a, b), in their order."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int32)


def _windows(symbols: np.ndarray, size: int) -> np.ndarray:
    """A number for the `size` symbols from each place on, equal for equal symbols: runs of 1, 2, 4 ... are numbered and joined."""
    n = len(symbols)
    shifted = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, n), x.dtype)])
    run, width, out, held = symbols, 1, None, 0
    while size:
        if size & 1:
            out, held = (run, width) if out is None else (_joined(out, shifted(run, held)), held + width)
        size >>= 1
        if size:
            run, width = _joined(run, shifted(run, width)), 2 * width
    return out


@dataclass
class Phrases:
    """Every different window of a block of items. text: the items' words as symbols, shorter items filled up in front
    with 0. first: where each window stands there; lengths: its words; owners[start[i] : start[i + 1]]: numbers of the
    items that have window i."""

    vocabulary: dict[bytes, int]
    text: np.ndarray
    size: int
    first: np.ndarray
    lengths: np.ndarray
    start: np.ndarray
    owners: np.ndarray
    items: list[str | None]

    @staticmethod
    def of(rows: list[tuple[str | None, str | None]], size: int = PHRASE) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        number: dict[str | None, int] = {}
        parts, owner, begin, at = [], [], [], 0
        for item, body in rows:
            found = words((body or "").encode())
            if not found:
                continue
            short = max(0, size - len(found))
            parts.append(np.zeros(short + len(found), np.int32))
            parts[-1][short:] = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found]
            places = len(parts[-1]) - size + 1
            begin.append(np.arange(at, at + places, dtype=np.int32))
            owner.append(np.full(places, number.setdefault(item, len(number)), np.int32))
            at += len(parts[-1])
        none = np.zeros(0, np.int32)
        text, begin, owner = (np.concatenate(x) if x else none for x in (parts, begin, owner))
        _, first, which = np.unique(_windows(text, size)[begin] if len(text) else none, return_index=True, return_inverse=True)
        pairs = np.unique(which.astype(np.int64) * max(1, len(number)) + owner)
        first = begin[first]
        lengths = np.full(len(first), size, np.int32)
        for k in range(size - 1):  # zeros stand in front only
            lengths -= text[first + k] == 0
        start = np.searchsorted(pairs, np.arange(len(first) + 1) * max(1, len(number))).astype(np.int32)
        return Phrases(vocabulary, text, size, first, lengths, start, (pairs % max(1, len(number))).astype(np.int32), list(number))


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of symbols in order, by prefix doubling; symbols that end runs must be unique."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """An FM-index of runs of symbols 1..sigma; each run is followed by 0."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        ends = np.flatnonzero(text == 0)
        unique = text + len(ends)
        unique[ends] = np.arange(1, len(ends) + 1)
        order = suffix_order(unique)
        before = np.where(order > 0, text[order - 1], 0)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.last = before
        self.sampled = (order % SAMPLE_EVERY == 0) | (before == 0)
        self.rank_sampled = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        self.levels = []
        level = before
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            ones = (level >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]).astype(np.int64), int(len(ones) - ones.sum())))
            level = np.concatenate([level[ones == 0], level[ones == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before place `upto`."""
        low, high = np.zeros_like(upto), upto
        for bit, ones, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.below[symbol] + self.rank(symbol, place)

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(which phrase, where in the text) of every occurrence."""
        n = len(phrases.first)
        live = np.arange(n)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.last), np.int64)
        for k in range(1, phrases.size + 1):
            going = live[phrases.lengths[live] >= k]
            symbol = phrases.text[phrases.first[going] + (phrases.size - k)].astype(np.int64)
            low[going], high[going] = self.step(symbol, low[going]), self.step(symbol, high[going])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        count = high[live] - low[live]
        which = np.repeat(live, count)
        place = np.repeat(low[live], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return which, self.locate(place)

    def locate(self, place: np.ndarray) -> np.ndarray:
        out, steps = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        open_ = np.arange(len(place))
        place = place.copy()
        while len(open_):
            done = self.sampled[place[open_]]
            now = open_[done]
            out[now] = self.samples[self.rank_sampled[place[now]]] + steps[now]
            open_ = open_[~done]
            place[open_] = self.step(self.last[place[open_]], place[open_])
            steps[open_] += 1
        return out


def occurrences(ids: np.ndarray, bounds: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(which phrase, first word) in a shard: ids has its words' symbols, 0 for others; bounds the documents' last words."""
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(ids):
        return none, none
    inside = ids > 0
    cut = np.zeros(len(ids) + 1, bool)  # a run ends before a foreign word and at the end of a document
    cut[1:][~inside] = cut[:-1][~inside] = True
    cut[bounds[bounds > 0]] = cut[0] = True
    edges = np.flatnonzero(cut)
    sizes = np.diff(edges)
    fit = (sizes >= phrases.lengths.min()) & inside[np.minimum(edges[:-1], len(ids) - 1)]
    starts, sizes = edges[:-1][fit], sizes[fit]
    if not len(starts):
        return none, none
    offset = np.cumsum(sizes + 1) - (sizes + 1)
    shift = np.repeat(starts - offset, sizes + 1)
    source = np.arange(len(shift)) + shift
    text = np.where(np.arange(len(shift)) == np.repeat(offset + sizes, sizes + 1), 0, ids[np.minimum(source, len(ids) - 1)])
    which, at = FMIndex(text, len(phrases.vocabulary)).search(phrases)
    return which, at + shift[at]


def _shard(texts: list[bytes], phrases: Phrases) -> tuple[list[np.ndarray], list[set[str]]]:
    """For each text which of its words are hit, and the items that have windows in it."""
    get = phrases.vocabulary.get
    parts = [np.array([get(w, 0) for w in words(t)], np.int64) for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    which, at = occurrences(ids, ends, phrases)
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + phrases.lengths[which] if len(at) else at, -1)
    hit = np.cumsum(marks)[:-1] > 0
    items: list[set] = [set() for _ in texts]
    pairs = np.unique(np.stack([np.searchsorted(ends, at, side="right"), which]), axis=1)
    for doc, phrase in pairs.T:
        items[doc].update(phrases.items[k] for k in phrases.owners[phrases.start[phrase] : phrases.start[phrase + 1]])
    for found in items:
        found.discard(None)
    return [hit[e - len(p) : e] for p, e in zip(parts, ends)], items


def remove(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words and what stands between hit words that follow each other."""
    found = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_WORDS))]
    out, at, i = [], 0, 0
    while i < len(found):
        if hit[i]:
            j = i
            while j + 1 < len(found) and hit[j + 1]:
                j += 1
            out.append(text[at : found[i][0]])
            at, i = found[j][1], j
        i += 1
    return b"".join(out) + text[at:]


def _blocks(benchmark: DataFrame) -> Iterator[Phrases]:
    held = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    # Every run of characters that are no ASCII letters or digits is taken for one break, which counts the words or a few more.
    total = held.agg(F.sum(F.regexp_count("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).collect()[0][0] or 0
    count = -(-total // BLOCK_WORDS)
    for b in range(count):
        part = held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b) if count > 1 else held
        yield Phrases.of([(r["item_id"], r["text"]) for r in part.toLocalIterator()])


_HIT, _ITEMS = "__contaminated_words", "__contaminating_items"


def mark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with two columns: the hit words as a byte for each word, and the items that have windows in the text; null
    where there is no benchmark."""
    marked = docs.withColumns({_HIT: F.lit(None).cast("binary"), _ITEMS: F.lit(None).cast("array<string>")})
    blocks = [docs.sparkSession.sparkContext.broadcast(phrases) for phrases in _blocks(benchmark)]
    if not blocks:
        return marked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                names = batch.schema.names
                texts = list(text_bytes(batch.column("text")))
                hits, items = None, [set() for _ in texts]
                for shared in blocks:
                    # Of several blocks none is kept, so that a task's memory does not grow with their number.
                    phrases = shared.value if len(blocks) == 1 else shared.load_from_path(shared._path)
                    found, more = _shard(texts, phrases)
                    hits = found if hits is None else [a | b for a, b in zip(hits, found)]
                    items = [a | b for a, b in zip(items, more)]
                columns = {_HIT: pa.array([h.astype(np.uint8).tobytes() for h in hits], batch.schema.field(_HIT).type),
                           _ITEMS: pa.array([sorted(i) for i in items], batch.schema.field(_ITEMS).type)}
                yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(k)) for k, n in enumerate(names)], names)

    return marked.mapInArrow(run, marked.schema)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                hits, items = batch.column(_HIT).to_pylist(), batch.column(_ITEMS).to_pylist()
                texts = text_bytes(batch.column("text"))
                n_words = [len(words(t)) if h is None else len(h) for t, h in zip(texts, hits)]
                n_hit = [sum(h or b"") for h in hits]
                digests = [hashlib.sha256(",".join(sorted(i or [])).encode()).hexdigest() for i in items]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i or []) for i in items], pa.int64()), pa.array(digests), pa.array([n > 0 for n in n_hit], pa.bool_())],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return mark(docs.select("doc_id", "text"), benchmark).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with every hit span cut from text, and n_chars, where there is one, counted again."""
    marked = mark(docs, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                hits = batch.column(_HIT).to_pylist()
                column = batch.column("text")
                texts = [remove(t, np.frombuffer(h, np.uint8)).decode("utf-8", "ignore") if h and any(h) else s.as_py() for t, h, s in zip(text_bytes(column), hits, column)]
                names = [n for n in batch.schema.names if n not in (_HIT, _ITEMS)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, column.type) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names], names)

    out = marked.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS ws FROM benchmark),
k AS (
  SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(list_slice(ws, p, p + least(10, len(ws)) - 1), ' ') AS s
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0)
), w AS (
  SELECT doc_id, p, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS s
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM k) WHERE len(ws) >= n)
), m AS (SELECT doc_id, p, n, item FROM w JOIN k USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM (SELECT doc_id, p, unnest(range(n)) AS o FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
