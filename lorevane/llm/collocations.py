"""Collocations: phrases of two to four words that occur often, scored by how much their parts occur without each other.

The first pass finds a superset of the frequent phrases with Misra-Gries summaries. A phrase and its language are hashed to
one of `parts` partitions and a key of 32 bits there. Tasks count each slice of text by itself and send each partition its
keys and, ahead of them, their mass; the summary of a partition has more counters than its mass divided by the threshold,
and summaries merge by adding counts and taking the largest that is over capacity from all. So what is taken from a key in
all is less than the threshold, and no frequent phrase is lost, whatever the order. Keys that can still be frequent are set
in a bit table of a fixed size (`BITS`), which is all that the driver collects and broadcasts: a fuller table lets more
phrases through to be counted, and never drops one.

The second pass counts the phrases that the table lets through exactly, by their text, and all single words, each slice
first by itself. Counts are 64-bit; scores and comparisons of counts are decimals. Parts of phrases are looked up by joins.

Everything is for each language; a null one is `und`. Null and empty texts have no words. Words that are very long and
texts that are very long are read whole. Repeated rows count each. Ties are ordered by the phrase's bytes. Empty tables
give no rows. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, materialize, sliced, text_bytes

LONGEST, LEAST, TOP, SHARE = 4, 30, 2000, 80
#: Size of the bit table: 16 MB.
BITS = 1 << 27
#: Texts are read in slices of about so many bytes: a task holds some fifty times as much while it hashes one.
SLICE = 2 << 20
#: Keys in one row between tasks, and keys that wait to be merged at least.
ROW_KEYS, WAITING = 1 << 12, 1 << 20
#: The phrases of a language are ranked in so many deals, and then the best of each.
DEALT = 64
#: 0: part of a word; 1: between words; 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts: where they lie in `data`, the number of their piece, and hashes by two bases."""

    data: bytes
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    lang: np.ndarray  # number of each word's language
    langs: list[str]
    hashes: list[np.ndarray]

    def phrases(self, k: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash, with the language, of each run of k words in one piece."""
        n = len(self.begin) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1 :])
        of = np.array([int.from_bytes(blake2b(f"{base}{x}".encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        h = of[self.lang[at]]
        for i in range(k):
            h = _mix((h ^ self.hashes[base][at + i]) * _ODD[3] + np.uint64(k))
        return at, h

    def text(self, at: int, k: int) -> bytes:
        return b" ".join([self.data[b:e] for b, e in zip(self.begin[at : at + k].tolist(), self.end[at : at + k].tolist())])


def words_of(texts: list[bytes], langs: list[str | None], bases: int = 1) -> Words:
    data = b"\n".join(texts).translate(LOWER)
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    inside = np.concatenate([[False], kind == 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin]
    of_text = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts)]), begin, side="right") - 1
    names = sorted({"und" if x is None else x for x in langs})
    number = {x: i for i, x in enumerate(names)}
    lang = np.array([number["und" if x is None else x] for x in langs], np.int32)[of_text] if langs else np.zeros(0, np.int32)
    hashes = []
    if len(begin):
        size = end - begin
        first = np.cumsum(size) - size
        chars = raw[inside[1:-1]].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(chars), dtype=np.int32) - np.repeat(first, size).astype(np.int32)
        for base in range(bases):
            power = np.concatenate([[np.uint64(1)], np.full(int(size.max()) - 1, _ODD[base] | np.uint64(1))]).cumprod(dtype=np.uint64)
            hashes.append(_mix(np.add.reduceat(chars * power[place], first) + size.astype(np.uint64)))
    return Words(data, begin, end, piece, lang, names, hashes or [np.zeros(0, np.uint64)] * bases)


def _slices(batches: Iterator[pa.RecordBatch], bases: int = 1) -> Iterator[Words]:
    for batch in batches:
        for part in sliced(batch, limit=SLICE):
            yield words_of(list(text_bytes(part["text"])), part["lang"].to_pylist(), bases)


def _placed(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition and key of each hash."""
    return (h >> np.uint64(32)) % np.uint64(parts), h & np.uint64(0xFFFFFFFF)


def _bit(part: np.ndarray, key: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """The place of a key in the bit table, of which each partition has one run of whole bytes."""
    run = np.uint64(bits // parts // 8 * 8)
    return (part * run + (key * run >> np.uint64(32))).astype(np.int64)


class Summary:
    """A Misra-Gries summary of keys with more counters than mass / least."""

    def __init__(self, mass: int, least: int) -> None:
        self.capacity, self.least, self.taken = mass // least + 1, least, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._n += len(keys)
        if self._n > max(self.capacity, WAITING):
            self.merge()

    def merge(self) -> None:
        """Add what waits, then take the first count beyond capacity from all."""
        keys = np.concatenate([self.keys, *(k for k, _ in self._waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self._waiting)])
        self._waiting, self._n = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            take = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.taken += take
            keys, counts = keys[counts > take], counts[counts > take] - take
        self.keys, self.counts = keys, counts

    def survivors(self) -> np.ndarray:
        """The keys that can have occurred `least` times."""
        self.merge()
        return self.keys[self.counts + self.taken >= self.least]


def _count_keys(parts: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _slices(batches):
            part, key = _placed(np.concatenate([words.phrases(k, 0)[1] for k in range(2, longest + 1)]), parts)
            both = np.sort(part << np.uint64(32) | key)
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(both)))
            both = both[first]
            cut = np.searchsorted(both, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            rows: list[tuple] = []
            for p in range(parts):
                a, b = int(cut[p]), int(cut[p + 1])
                if a < b:
                    rows.append((p, int(n[a:b].sum()), None, None, None))
                for i in range(a, b, ROW_KEYS):
                    keys, many = both[i : min(i + ROW_KEYS, b)].astype("<u4"), n[i : min(i + ROW_KEYS, b)]
                    rows.append((p, None, keys[many == 1].tobytes(), keys[many > 1].tobytes(), many[many > 1].astype("<i8").tobytes()))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), _SENT.values())], names=list(_SENT))

    return run


_SENT = {"part": pa.int32(), "mass": pa.int64(), "once": pa.binary(), "keys": pa.binary(), "times": pa.binary()}


def _summarise(parts: int, least: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(b.columns))))
        for part, held in groupby(rows, key=lambda r: r[0]):
            mass, summary = 0, None
            for _, some, once, keys, times in held:
                if some is not None:  # all masses come before all keys
                    mass += some
                    continue
                summary = summary or Summary(mass, least)
                one, more = (np.frombuffer(x.as_buffer(), "<u4") for x in (once, keys))
                summary.add(np.concatenate([one, more]), np.concatenate([np.ones(len(one), np.int64), np.frombuffer(times.as_buffer(), "<i8")]))
            table = np.zeros(bits // parts // 8 * 8, bool)
            table[_bit(np.uint64(0), summary.survivors().astype(np.uint64), parts, bits)] = True
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    return run


def survivors(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, parts: int | None = None, bits: int = BITS) -> np.ndarray:
    """The bit table of phrases of docs(lang, text) that can occur `least` times."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select("lang", "text").mapInArrow(_count_keys(parts, longest), "part int, mass bigint, once binary, keys binary, times binary")
    dealt = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("mass").isNull())
    out = np.zeros((parts, bits // parts // 8), np.uint8)
    for r in dealt.mapInArrow(_summarise(parts, least, bits), "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _count_phrases(table, longest: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value.reshape(-1)
        parts = len(table.value)
        for words in _slices(batches, 2):
            total = np.bincount(words.lang, minlength=len(words.langs)).tolist()
            yield _counted(words.langs, [""] * len(total), [0] * len(total), total)
            for k in range(1, longest + 1):
                at, h = words.phrases(k, 0)
                check = words.phrases(k, 1)[1]
                if k > 1:
                    place = _bit(*_placed(h, parts), parts, bits)
                    may = known[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
                    at, h, check = at[may], h[may], check[may]
                if not len(at):
                    continue
                order = np.lexsort((check, h))
                at, h, check = at[order], h[order], check[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])]))
                n = np.diff(np.append(first, len(at)))
                for i in range(0, len(first), 50_000):
                    some = at[first[i : i + 50_000]]
                    yield _counted([words.langs[x] for x in words.lang[some].tolist()], [words.text(x, k).decode("utf-8", "replace") for x in some.tolist()], [k] * len(some), n[i : i + 50_000].tolist())

    return run


def _counted(langs: list, phrases: list, k: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "k", "f"])


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, parts: int | None = None, bits: int = BITS) -> DataFrame:
    """lang, phrase, k, f of every run of k words, 1 to `longest`, that occurs `least` times; k = 0 counts all words."""
    docs = docs.select("lang", "text")
    table = docs.sparkSession.sparkContext.broadcast(survivors(docs, longest, least, parts, bits))
    found = docs.mapInArrow(_count_phrases(table, longest, bits), "lang string, phrase string, k int, f bigint")
    return found.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _part(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(counts: DataFrame, share: int = SHARE, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, a, l, r, score of frequent() phrases of two words or more at their worst cut, without those of which
    `share` of a hundred occurrences lie in one longer phrase."""
    words = F.split("phrase", " ")
    phrases = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"))
    parts = counts.where("k BETWEEN 1 AND %d" % (longest - 1)).select(F.col("lang").alias("__lang"), F.col("phrase").alias("__part"), "f")
    of = lambda df, part, name: df.join(parts.withColumnRenamed("f", name).hint("merge"), (df["lang"] == F.col("__lang")) & (df[part] == F.col("__part"))).drop("__lang", "__part")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select("lang", "phrase", "a", "cut", _part(words, 1, F.col("cut")).alias("__first"), _part(words, F.col("cut") + 1, F.col("k")).alias("__rest"))
    both = of(of(cuts, "__first", "l"), "__rest", "r")
    score = F.expr("CAST(2000000 AS DECIMAL(8,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    worst = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    inner = phrases.where("k >= 3").select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: _part(words, i, n))))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("__longer"))
    left = worst.join(longer.hint("merge"), ["lang", "phrase"], "left").where(F.col("__longer").isNull() | (_exact(F.col("__longer")) * 100 < _exact(F.col("a")) * share))
    return left.select("lang", "phrase", "a", "w.l", "w.r", "w.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, longest: int = LONGEST, parts: int | None = None, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by score, occurrences and bytes."""
    counts = materialize(frequent(docs, longest, least, parts, bits))
    order = F.desc("score"), F.desc("a"), "phrase"
    best = scored(counts, share, longest).withColumn("__deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    for by in (("lang", "__deal"), ("lang",)):  # the best of each deal first: a language's last window is bounded
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def digest(docs: DataFrame) -> DataFrame:
    return collocations(docs)


_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM p WHERE len(w) >= {k}" for k in range(1, LONGEST + 1))
_CUTS = " UNION ALL ".join(f"SELECT lang, phrase, a, {c} AS cut, array_to_string(w[1:{c}], ' ') AS first, array_to_string(w[{c + 1}:], ' ') AS rest FROM c WHERE k > {c}" for c in range(1, LONGEST))
_INNER = " UNION ALL ".join(f"SELECT lang, a, array_to_string(w[{i}:{i + n - 1}], ' ') AS phrase FROM c WHERE k > {n} AND k >= {i + n - 1}" for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2))
#: The same rows in DuckDB's SQL.
ORACLE = f"""
WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
s AS (SELECT x.lang, x.phrase, x.a, l.f AS l, r.f AS r, CAST((2000000 * x.a::HUGEINT) // (l.f::HUGEINT + r.f::HUGEINT) AS BIGINT) AS score
  FROM ({_CUTS}) x JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest
  QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM ({_INNER}) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s LEFT JOIN i USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer::HUGEINT < {SHARE} * a::HUGEINT
QUALIFY rank <= {TOP}
"""
