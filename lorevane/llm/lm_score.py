"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the two words on either side, by a two-level hierarchy over the vocabulary. The network
predicts the word's class: the FREQUENT most frequent words have one each, the others belong to TAIL classes, which are
learned from the corpus (endings of words with alike neighbours share a class). Within its class a word's probability
comes from its count over all documents, or, if it was not counted, from the bytes of the word. The sum over all words of
the logarithms of both is the document's score. The counts of the most frequent words (VOCABULARY of them at most) are
broadcast; those of the others are a table that the words of each document are joined with.

Counts cover all documents, and so does training: documents are dealt to shards of about SHARD_BYTES by a hash of their id
and text. A shard learns to predict all of its words, each once, in an order that its hashes give; the mean of the shards'
parameters, weighted by their words and summed in whole numbers, is the network. So neither depends on how the input is
partitioned. Tasks send parameters, whose number is fixed, never texts.

Words are looked up once, after they are counted: encode() writes a byte for each word, its class, and what does not depend
on the network. Training and scoring read that.

Null and empty texts have no words: their sum is 0 and their mean null. Repeated rows are scored each on its own. Very
long texts are scored whole. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialize, sliced, text_bytes

FREQUENT, TAIL, VOCABULARY = 95, 32, 20_000
#: Words' endings (three bytes) and their neighbours are told apart by so many values of a hash, to find the TAIL classes.
ENDINGS, NEIGHBOURS = 1024, 64
#: Class 0 stands for places before the first and after the last word.
CLASSES = 1 + FREQUENT + TAIL
SIDES, HIDDEN = (-2, -1, 1, 2), 16
SHARD_BYTES, BATCH, RATE = 16 << 20, 2048, 0.15
#: A shard learns from so many words of texts laid end to end at a time.
LEARNED_AT_ONCE = 1 << 18
_COUNTED, _CACHE, _CHUNK, _LOOKED_AT = 200_000, 400_000, 1024, 10_000
_SHAPES = ((len(SIDES), CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))
#: Parameters are summed over shards as multiples of 1 / _UNIT.
_UNIT, _PAIRS = 1 << 16, 1000


def words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


@dataclass
class Vocabulary:
    """Class and log probability within the class of frequent words; the log probability that a count of 1 has in each
    class; log odds of bytes; the TAIL class of each ending; the bytes of all words; and the counts of the other words: a
    table word, n, which tasks do not get."""

    known: dict[bytes, tuple[int, float]]
    unknown: list[float]
    of_byte: list[float]
    tails: list[int]
    size: int = 0
    others: DataFrame | None = None

    def tail_class(self, word: bytes) -> int:
        return 1 + FREQUENT + self.tails[ending(word)]

    def spelt(self, words: list[bytes]) -> np.ndarray:
        """Log odds of the bytes of each word."""
        if not words:
            return np.zeros(0)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        odds = np.array(self.of_byte)
        return np.add.reduceat(odds[np.frombuffer(b"".join(words), np.uint8)], np.cumsum(sizes) - sizes) + odds[256]


def numbers_of(words: Iterable[bytes] = ()) -> defaultdict[bytes, int]:
    """Numbers of words, in this order and then in that in which they are first asked for."""
    found = {word: i for i, word in enumerate(words)}
    return defaultdict(count(len(found)).__next__, found)


def numbered(numbers: defaultdict[bytes, int], texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words of all texts one after another, and how many words each text has."""
    number, found = numbers.__getitem__, []
    for text in texts:
        split = words(text)
        found.append(np.fromiter(map(number, split), np.int64, len(split)))
    return np.concatenate([*found, np.zeros(0, np.int64)]), np.fromiter(map(len, found), np.int64, len(found))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all documents; rows (null, byte, n) for bytes, and for pairs of an ending and a neighbour: columns
    word, byte, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, codes, counts = numbers_of(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        others = np.zeros(257 + _PAIRS + ENDINGS * NEIGHBOURS, np.int64)
        for whole in batches:
            for batch in sliced(whole, limit=2 << 20):
                of_word, lengths = numbered(numbers, text_bytes(batch.column("text")))
                if len(of_word):
                    more = np.bincount(of_word, minlength=len(numbers))
                    more[: len(counts)] += counts
                    counts = more
                    new = islice(numbers, len(codes), None)
                    codes = np.concatenate([codes, np.array([ending(w) * NEIGHBOURS + zlib.crc32(w) % NEIGHBOURS for w in new], np.int64)])
                    code = codes[of_word]
                    inner = np.ones(len(code), bool)
                    inner[np.cumsum(lengths)[lengths > 0] - 1] = False  # the last words of texts
                    left, right = code[:-1][inner[:-1]], code[1:][inner[:-1]]
                    low = NEIGHBOURS - 1
                    for near, other in ((left, right), (right, left)):
                        others[257 + _PAIRS :] += np.bincount(near & ~low | other & low, minlength=ENDINGS * NEIGHBOURS)
                if len(numbers) > _COUNTED:
                    yield rows(numbers, counts, others)
                    numbers, codes, counts = numbers_of(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield rows(numbers, counts, others)
        some = np.flatnonzero(others)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(others[some])], ["word", "byte", "n"])

    def rows(numbers: defaultdict[bytes, int], counts: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
        """The counts of words; those of their bytes and ends are added to `others`."""
        names = list(numbers)
        for k in range(0, len(names), _LOOKED_AT):
            some = names[k : k + _LOOKED_AT]
            each = np.repeat(counts[k : k + _LOOKED_AT], np.fromiter(map(len, some), np.int64, len(some)))
            others[:256] += np.bincount(np.frombuffer(b"".join(some), np.uint8), each, 256).astype(np.int64)
        others[256] += counts.sum()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.nulls(len(names), pa.int32()), pa.array(counts)], ["word", "byte", "n"])

    return docs.select("text").mapInArrow(run, "word binary, byte int, n bigint").groupBy("word", "byte").agg(F.sum("n").alias("n"))


def alike(pairs: np.ndarray, groups: int = TAIL) -> np.ndarray:
    """The group of each row of pairs (counts by neighbour): rows with alike shares of neighbours come together."""
    n = pairs.sum(axis=1)
    if not n.any():
        return np.zeros(len(pairs), np.int64)
    shares = np.sqrt((pairs + 0.5 * pairs.sum(axis=0) / n.sum()) / (n + 0.5)[:, None])
    centres = shares[[int(n.argmax())]]
    far = ((shares - centres[0]) ** 2).sum(axis=1)
    for _ in range(groups - 1):
        i = int((far * n).argmax())
        centres = np.vstack([centres, shares[i]])
        far = np.minimum(far, ((shares - shares[i]) ** 2).sum(axis=1))
    for _ in range(30):
        group = np.stack([((shares - c) ** 2).sum(axis=1) for c in centres]).argmin(axis=0)
        for k in range(groups):
            own = (group == k) & (n > 0)
            if own.any():
                centres[k] = n[own] @ shares[own] / n[own].sum()
    return group


def vocabulary(docs: DataFrame) -> Vocabulary:
    counted = materialize(count_words(docs))
    # Words above the count at which there would be more than VOCABULARY of them; few counts occur, so these are few rows.
    room, least = VOCABULARY, 0
    for r in counted.where("word IS NOT NULL").groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(VOCABULARY + 1).collect():
        room -= r["words"]
        if room < 0:
            least = r["n"]
            break
    top = sorted(counted.where(f"word IS NOT NULL AND n > {least}").collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    numbers = np.zeros(257 + _PAIRS + ENDINGS * NEIGHBOURS)
    for r in counted.where("byte IS NOT NULL").collect():
        numbers[r["byte"]] = r["n"]
    tails = alike(numbers[257 + _PAIRS :].reshape(ENDINGS, NEIGHBOURS))
    v = Vocabulary({}, [], [], tails.tolist(), int(numbers[:257].sum()))
    totals = np.zeros(CLASSES)
    last = F.expr("CASE WHEN octet_length(word) <= 3 THEN word ELSE substring(word, octet_length(word) - 2, 3) END")
    for r in counted.where("word IS NOT NULL").groupBy(F.pmod(F.crc32(last), F.lit(ENDINGS)).alias("k")).agg(F.sum("n").alias("n")).collect():
        totals[1 + FREQUENT + tails[r["k"]]] += r["n"]
    for i, r in enumerate(top[:FREQUENT]):
        v.known[bytes(r["word"])] = (1 + i, 0.0)
        totals[v.tail_class(bytes(r["word"]))] -= r["n"]
    rest = totals + 1.0  # a count of 1 for all words that were not counted
    for r in top[FREQUENT:]:
        c = v.tail_class(bytes(r["word"]))
        v.known[bytes(r["word"])] = (c, float(np.log(r["n"] / rest[c])))
    v.others = counted.where(f"word IS NOT NULL AND n <= {least}").select("word", "n")
    of_byte = numbers[:257] + 0.5
    v.unknown, v.of_byte = (-np.log(np.maximum(rest, 1.0))).tolist(), np.log(of_byte / of_byte.sum()).tolist()
    return v


class Reader:
    """Classes and log probabilities of the words of texts."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self._forget()

    def _forget(self) -> None:
        known = self.v.known
        self.numbers = numbers_of(known)
        self.classes, self.logs = np.array([c for c, _ in known.values()], np.uint8), np.array([log for _, log in known.values()], float)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the words of texts laid end to end, with two places of class 0 between texts; log probabilities of all
        words, the number of words of each text, and the numbers of all words."""
        if len(self.numbers) > _CACHE:
            self._forget()
        of_word, lengths = numbered(self.numbers, texts)
        new = np.array([self.v.tail_class(w) for w in islice(self.numbers, len(self.classes), None)], np.uint8)
        self.classes, self.logs = np.concatenate([self.classes, new]), np.concatenate([self.logs, np.array(self.v.unknown)[new]])
        classes = np.zeros(len(of_word) + 2 * len(texts) + 2, np.uint8)
        classes[np.arange(len(of_word)) + 2 + 2 * np.repeat(np.arange(len(lengths)), lengths)] = self.classes[of_word]
        return classes, self.logs[of_word], lengths, of_word

    def others(self, lengths: np.ndarray, of_word: np.ndarray) -> pa.Array:
        """For each text just read its different words beyond the frequent ones: word, how many times, log odds of the bytes."""
        names = list(self.numbers)
        rare = np.flatnonzero(of_word >= len(self.v.known))
        pairs, times = np.unique(np.repeat(np.arange(len(lengths)), lengths)[rare] << 32 | of_word[rare], return_counts=True)
        found, ends = [names[i] for i in (pairs & 0xFFFFFFFF).tolist()], np.searchsorted(pairs >> 32, np.arange(len(lengths) + 1))
        parts = [pa.array(found, pa.binary()), pa.array(times, pa.int64()), pa.array(self.v.spelt(found))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["word", "times", "spelt"]))


def start() -> list[np.ndarray]:
    rng = np.random.default_rng(7)
    return [(rng.normal(size=s) * (0.1 if len(s) > 1 else 0.0)).astype(np.float32) for s in _SHAPES]


def hidden(p: list[np.ndarray], classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hidden layer at each place, and a last column of 1, by which the constants are multiplied."""
    near = np.take(p[0][0], classes[at + SIDES[0]], axis=0)
    for k in range(1, len(SIDES)):
        near += np.take(p[0][k], classes[at + SIDES[k]], axis=0)
    near += p[1]
    out = np.ones((len(at), near.shape[1] + 1), near.dtype)
    np.tanh(near, out=out[:, :-1])
    return out


def odds(p: list[np.ndarray], h: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Log odds of the classes, up to a constant."""
    weights = np.vstack(p[2:])
    out = np.matmul(h, weights, out=out)
    if np.abs(weights).sum(axis=0).max() > 59:  # the hidden layer is between -1 and 1, so that below this none is cut
        np.clip(out, -60, 60, out=out)
    return out


def log_probabilities(p: list[np.ndarray], classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The network's log probability of the class at each place."""
    out = np.empty(len(at), np.float32)
    room, ones = np.empty((min(_CHUNK, len(at)), CLASSES), p[3].dtype), np.ones(CLASSES, p[3].dtype)
    for k in range(0, len(at), _CHUNK):
        some = at[k : k + _CHUNK]
        e = odds(p, hidden(p, classes, some), room[: len(some)])
        target = e[np.arange(len(some)), classes[some]]
        np.exp(e, out=e)
        out[k : k + _CHUNK] = target - np.log(e @ ones)
    return out


def learn(p: list[np.ndarray], squares: list[np.ndarray], classes: np.ndarray, at: np.ndarray) -> None:
    """One pass of Adagrad over the places `at`, in place."""
    room, ones = np.empty((min(BATCH, len(at)), CLASSES), p[3].dtype), np.ones(CLASSES, p[3].dtype)
    for k in range(0, len(at), BATCH):
        some = at[k : k + BATCH]
        n = len(some)
        h = hidden(p, classes, some)
        e = odds(p, h, room[:n])
        np.exp(e, out=e)
        sums = e @ ones
        e[np.arange(n), classes[some]] -= sums
        share = (1 / (sums * n))[:, None]  # by which rows of e are to be multiplied
        back = e @ p[2].T
        back *= share
        back *= 1 - h[:, :-1] * h[:, :-1]
        h *= share
        down = (e.T @ h).T
        slopes = [np.zeros_like(p[0]), back.sum(axis=0), down[:-1], down[-1]]
        for slope, side in zip(slopes[0], SIDES):  # sums over the places with one class there
            near = classes[some + side]
            order = np.argsort(near, kind="stable")
            near = near[order]
            first = np.flatnonzero(near[1:] != near[:-1]) + 1
            first = np.concatenate([[0], first])
            slope[near[first]] = np.add.reduceat(np.take(back, order, axis=0), first, axis=0)
        for w, q, g in zip(p, squares, slopes):
            q += g * g
            g *= w.dtype.type(RATE)
            g /= np.sqrt(q) + w.dtype.type(1e-6)
            w -= g


def laid(rows: Iterable[bytes]) -> np.ndarray:
    """Classes of texts laid end to end, with two places of class 0 before, between and after those that have words."""
    return np.frombuffer(b"\0\0" + b"".join(row + b"\0\0" for row in rows if row), np.uint8)


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Written once for every row of docs(doc_id, text): row (a number of its own), doc_id, shard and place of the text in
    training, a byte for each word (its class), n_tokens, the sum x of log probabilities within classes, and the words whose
    count is in v.others."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(replace(v, others=None))
    shards = max(1, -(-v.size // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, row = Reader(shared.value), TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in sliced(whole, limit=2 << 20):
                classes, logs, lengths, of_word = reader.read(list(text_bytes(batch.column("text"))))
                ends = np.cumsum(lengths)
                coded = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(classes[classes > 0])])
                total = np.concatenate([[0.0], np.cumsum(logs)])
                rows = pa.array(np.arange(row, row + len(lengths)))
                row += len(lengths)
                found = [rows, *(batch.column(c) for c in ("doc_id", "shard", "place")), coded, pa.array(lengths), pa.array(total[ends] - total[ends - lengths]), reader.others(lengths, of_word)]
                yield pa.RecordBatch.from_arrays(found, ["row", "doc_id", "shard", "place", "classes", "n_tokens", "x", "others"])

    place = F.xxhash64("doc_id", "text")
    placed = docs.select("doc_id", "text", place.alias("place"), F.pmod(F.shiftright(place, 8), F.lit(shards)).alias("shard"))
    # Written, so that a task that runs again cannot number its rows anew.
    return materialize(placed.mapInArrow(run, f"row bigint, doc_id {kind}, shard bigint, place bigint, classes binary, n_tokens bigint, x double, others array<struct<word: binary, times: bigint, spelt: double>>"))


def train(docs: DataFrame, v: Vocabulary) -> list[np.ndarray]:
    """The network's parameters after learning from every word of docs(doc_id, text) once."""
    return learned(encode(docs, v))


def learned(coded: DataFrame) -> list[np.ndarray]:
    """The parameters after learning from every word of an encode() result once. A byte for each word is dealt to the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, size = None, [], 0
        p, squares, seen = [], [], 0
        total = np.zeros(sum(int(np.prod(s)) for s in _SHAPES) + 1, np.int64)

        def learn_waiting() -> None:
            nonlocal seen, size
            classes = laid(waiting)
            at = np.flatnonzero(classes)
            learn(p, squares, classes, at)
            seen += len(at)
            size = 0
            waiting.clear()

        def end() -> None:
            if waiting:
                learn_waiting()
            if seen:
                total[:-1] += np.round(np.concatenate([x.ravel() for x in p]).astype(float) * (seen * _UNIT)).astype(np.int64)
                total[-1] += seen

        for batch in batches:
            for shard, classes in zip(batch.column("shard").to_pylist(), batch.column("classes").to_pylist()):
                if shard != now:
                    end()
                    p = start()
                    squares, seen, now = [np.full_like(x, 1e-3) for x in p], 0, shard
                waiting.append(classes)
                size += len(classes)
                if size >= LEARNED_AT_ONCE:
                    learn_waiting()
        end()
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "x"])

    dealt = coded.where("n_tokens > 0").select("shard", "place", "classes").repartition("shard").sortWithinPartitions("shard", "place", "classes").select("shard", "classes")
    # Whole numbers add up to the same in any order.
    summed = dealt.mapInArrow(run, "i int, x bigint").groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    if not summed:
        return start()
    flat = [int(r["x"]) for r in sorted(summed, key=lambda r: r["i"])]
    flat = np.array([x / (flat[-1] * _UNIT) for x in flat[:-1]], np.float32)
    sizes = np.cumsum([int(np.prod(s)) for s in _SHAPES])
    return [x.reshape(s) for x, s in zip(np.split(flat, sizes[:-1]), _SHAPES)]


def score(docs: DataFrame, v: Vocabulary, parameters: list[np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood for every row of docs(doc_id, text)."""
    return scored(encode(docs, v), v, parameters)


def scored(coded: DataFrame, v: Vocabulary, parameters: list[np.ndarray]) -> DataFrame:
    """What score() gives, of an encode() result."""
    kind = coded.schema["doc_id"].dataType.simpleString()
    shared = coded.sparkSession.sparkContext.broadcast(parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for whole in batches:
            for batch in sliced(whole, "classes", LEARNED_AT_ONCE):
                classes = laid(batch.column("classes").to_pylist())
                lengths, x = (batch.column(c).to_numpy() for c in ("n_tokens", "x"))
                total = np.concatenate([[0.0], np.cumsum(log_probabilities(p, classes, np.flatnonzero(classes)).astype(float))])
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_tokens")), pa.array(x + total[ends] - total[ends - lengths])], ["row", "doc_id", "n_tokens", "x"])

    own = coded.select("row", "doc_id", "n_tokens", "x", "classes").mapInArrow(run, f"row bigint, doc_id {kind}, n_tokens bigint, x double")
    rare = coded.select("row", F.explode("others").alias("o")).select("row", "o.*")
    if v.others is not None:
        rare = rare.hint("merge").join(v.others.hint("merge"), "word", "left")
    else:
        rare = rare.withColumn("n", F.lit(None).cast("bigint"))
    more = rare.select("row", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("bigint").alias("n_tokens"), (F.col("times") * F.coalesce(F.log("n"), "spelt")).alias("x"))
    summed = own.unionByName(more).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("x").alias("x"))
    return summed.select("doc_id", "n_tokens", F.col("x").alias("log_likelihood"), F.try_divide("x", "n_tokens").alias("mean_log_likelihood"))


def digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    v = vocabulary(docs)
    coded = encode(docs, v)
    return scored(coded, v, learned(coded))
