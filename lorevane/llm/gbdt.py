"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted in Python tasks with numpy. The trees are grown on the driver from histograms of
binned statistics and kept as flat arrays, which a task walks for all its documents and all trees at once.

The training rows are a bounded sample: TRAIN_DOCS labelled documents at most, those with the smallest hashes of doc_id.
Scoring has no bound, and very long texts are read whole. Of splits with equal gain the first statistic's first is taken. Null and empty texts have zero statistics and are scored like any other. With labels of one class
only, or none, every score is the share of good labels (one half without labels). Repeated rows are scored each on its
own; several labels of one id count as the lowest. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, remainder_of_id, sliced, text_bytes

TRAIN_DOCS = 20_000
FOLDS, HELD_OUT = 3, 1
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 80, 4, 64, 0.15, 8, 1.0

_CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "comma", "shout", "symbol", "bar", "other", "lead", "tail")
NAMES = ("log_bytes", "log_words", *(f"share_{c}" for c in _CLASSES), "word_length", "distinct_words", "repeats_next", "distinct_lines", "line_words", "short_words", "long_words", "ends_shout")


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), np.uint8)
    for name, chars in {"digit": "0123456789", "space": " \t\r\x0b\f", "newline": "\n", "stop": ".", "comma": ",;:", "shout": "!?", "symbol": "#*$%&<>~^@", "bar": "|"}.items():
        table[[ord(c) for c in chars]] = _CLASSES.index(name)
    table[65:91], table[97:123] = _CLASSES.index("upper"), _CLASSES.index("lower")
    table[0x80:0xC0], table[0xC0:] = _CLASSES.index("tail"), _CLASSES.index("lead")
    return table


_TABLE = _class_table()


def statistics(text: bytes) -> np.ndarray:
    """The numbers NAMES of one text."""
    out = np.zeros(len(NAMES))
    n = len(text)
    if not n:
        return out
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[0], out[1] = np.log1p(n), np.log1p(len(words))
    out[2 : 2 + len(_CLASSES)] = np.bincount(_TABLE[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES)) / n
    k = 2 + len(_CLASSES)
    if words:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out[k] = lengths.mean()
        out[k + 1] = len(set(words)) / len(words)
        out[k + 2] = sum(map(bytes.__eq__, words, words[1:])) / len(words)
        out[k + 3] = len(set(lines)) / len(lines)
        out[k + 4] = len(words) / len(lines)
        out[k + 5], out[k + 6] = (lengths <= 2).mean(), (lengths > 14).mean()
        out[k + 7] = text.count(b"!! ") / len(words)
    return out


@dataclass
class Trees:
    """Nodes of all trees in flat arrays: a node with feature -1 is a leaf. roots: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaf values: every document walks every tree, a level at a time."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[node]
            step = np.where(x[row, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(f < 0, node, step)
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the logistic loss."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots: list[int] = []
    if len(set(y.tolist())) == 2:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
        raw = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            roots.append(_grow(nodes, binned, cuts, y - p, np.maximum(p * (1 - p), 1e-9), np.arange(len(y)), 0, raw))
    else:
        nodes, roots = [[-1, 0.0, 0, 0, 0.0]], [0]
    a = list(zip(*nodes))
    return Trees(np.array(a[0], np.int64), np.array(a[1]), np.array(a[2], np.int64), np.array(a[3], np.int64), np.array(a[4]), np.array(roots), base)


def _grow(nodes: list, binned: np.ndarray, cuts: list, slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int, raw: np.ndarray) -> int:
    """Append the subtree over `rows` to nodes, add its values to raw, and return its node."""
    here = len(nodes)
    g, h = slope[rows].sum(), curve[rows].sum()
    nodes.append([-1, 0.0, here, here, RATE * g / (h + RIDGE)])
    best = (1e-6, None, None)
    if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, j]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (slope[rows], curve[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE) - g * g / (h + RIDGE)
            gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
    if best[1] is None:
        raw[rows] += nodes[here][4]
        return here
    _, j, k = best
    goes = binned[rows, j] <= k
    left = _grow(nodes, binned, cuts, slope, curve, rows[goes], depth + 1, raw)
    right = _grow(nodes, binned, cuts, slope, curve, rows[~goes], depth + 1, raw)
    nodes[here][:4] = [j, float(cuts[j][k]), left, right]
    return here


def document_statistics(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, x (the numbers NAMES), and other columns asked for, of every row of docs(doc_id, text)."""
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *also)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                x = [statistics(t) for t in text_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *also)), pa.array(x, pa.list_(pa.float64()))], ["doc_id", *also, "x"])

    return docs.select("doc_id", *also, "text").mapInArrow(run, ", ".join([*kinds, "x array<double>"]))


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees from a bounded sample of the labelled rows outside the held-out fold."""
    usable = labels.where(F.col("quality").isNotNull() & (remainder_of_id(FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = first_by_hash(usable, "doc_id", TRAIN_DOCS)
    # At most TRAIN_DOCS rows, whatever the tables' size; of several texts with one id the one with the smallest hash.
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = document_statistics(one, "quality").orderBy("doc_id").collect()
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["quality"] for r in rows], float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score for every row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                x = np.array([statistics(t) for t in text_bytes(batch.column("text"))]).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.probability(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held_out = F.coalesce(remainder_of_id(FOLDS) == HELD_OUT, F.lit(False))
    return score(docs, train(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
