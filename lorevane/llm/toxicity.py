"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels come for whole documents. A token of a toxic document is labelled toxic where one of its features (the word, or
a prefix of it) stands out in toxic documents of the training rows; every other token is labelled clean. On these token
labels the chain is trained by gradient ascent. To score, forward-backward runs over whole texts; a document's score is
a logistic function of the expected number of toxic tokens and of the largest marginal, fitted on the training rows.
Runs of tokens with a marginal of at least SPAN are returned as offsets in code points.

The training rows are a bounded sample: TRAIN_DOCS labelled documents of each class at most, in the order of the hashes of
their doc_id, until the class has TRAIN_BYTES of text; texts are learned whole. Those of over a sixteenth of that come after
all others, and one that is longer than all of it is left out by itself, so that it takes no other row's place. Of
several texts with one id the one with the smallest hash is used. Scoring has no bound. Null and empty texts have no tokens and
get the score of a text without toxic tokens. Without a toxic training row every score is near the share of toxic labels.
Repeated rows are scored each on its own; several labels of one id count as the highest. Extra columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, first_by_hash, materialize, remainder_of_id, sliced

TRAIN_DOCS = 1000
#: Bytes of text of each class in the sample, passed by one text at most: what the driver holds.
TRAIN_BYTES = 4 << 20
FOLDS = 5
PREFIXES = (5, 6, 7, 8, 9)
SPAN = 0.5
#: Chosen on one training fold after learning from the others: the log odds that mark a feature as toxic, and twice the
#: log likelihood ratio against chance that it must reach.
LEAST_ODDS, LEAST_RATIO = 2.0, 14.0
STEPS, RATE, PENALTY = 30, 0.5, 1e-3
#: ASCII characters that are no letters or digits separate tokens.
_BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_CACHE = 400_000


@dataclass
class Chain:
    """Weights of features for the toxic state, its bias, log transitions, and the document-level logistic function."""

    weights: dict[bytes, float]
    bias: float
    transitions: np.ndarray
    calibration: np.ndarray  # constant, log(1 + expected toxic tokens), largest marginal


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_BREAKS).split()


def features(token: bytes) -> list[bytes]:
    """The token and its prefixes, counted in characters."""
    text = token.decode("utf-8", "replace")
    return [token, *(text[:k].encode() + b"*" for k in PREFIXES if len(text) > k)]


def _scan(m: np.ndarray) -> np.ndarray:
    """Running products of 2x2 matrices m (T, 4), each normalised; in blocks, so that numpy takes about 2 sqrt(T) steps."""
    t = len(m)
    length = max(1, int(np.sqrt(t)))
    blocks = -(-t // length)
    p = np.empty((blocks * length, 4))
    p[:t] = m
    p[t:] = (1, 0, 0, 1)
    p = p.reshape(blocks, length, 4)

    def times(a, b):
        out = np.stack([a[..., 0] * b[..., 0] + a[..., 1] * b[..., 2], a[..., 0] * b[..., 1] + a[..., 1] * b[..., 3],
                        a[..., 2] * b[..., 0] + a[..., 3] * b[..., 2], a[..., 2] * b[..., 1] + a[..., 3] * b[..., 3]], axis=-1)
        return out / out.sum(axis=-1, keepdims=True)

    for i in range(1, length):
        p[:, i] = times(p[:, i - 1], p[:, i])
    before = np.array([1.0, 0, 0, 1])
    entry = np.empty((blocks, 1, 4))
    for b in range(blocks):
        entry[b, 0] = before
        before = times(before, p[b, -1])
    return times(entry, p).reshape(-1, 4)[:t]


def marginals(emission: np.ndarray, starts: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """P(toxic) of every token of chains laid end to end; starts marks first tokens. pairs: also expected transitions."""
    if not len(emission):
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    e = np.exp(np.clip(emission, -30, 30))
    a = np.exp(transitions)
    m = np.stack([np.full(len(e), a[0, 0]), a[0, 1] * e, np.full(len(e), a[1, 0]), a[1, 1] * e], axis=-1)
    m[starts, 0] = m[starts, 2] = 1.0
    m[starts, 1] = m[starts, 3] = e[starts]
    forward = _scan(m / m.sum(axis=-1, keepdims=True))[:, :2]
    forward /= forward.sum(axis=-1, keepdims=True)
    # The backward product runs over transposed matrices from the end: what follows token t is the product of m after t.
    late = np.empty_like(m)
    late[0] = (1, 0, 0, 1)
    late[1:] = m[:0:-1][:, [0, 2, 1, 3]]
    late = _scan(late / late.sum(axis=-1, keepdims=True))
    backward = late[::-1][:, [0, 1]] + late[::-1][:, [2, 3]]
    both = forward * backward
    p = both[:, 1] / both.sum(axis=-1)
    if not pairs:
        return p
    inner = np.flatnonzero(~starts)
    joint = forward[inner - 1][:, [0, 0, 1, 1]] * m[inner] * backward[inner][:, [0, 1, 0, 1]]
    return p, (joint / joint.sum(axis=-1, keepdims=True)).sum(axis=0).reshape(2, 2)


def _stands_out(n: int, m: int, toxic: int, clean: int) -> bool:
    """Whether a feature of n toxic and m clean documents is toxic beyond chance: log odds, and a likelihood ratio test."""
    if np.log((n + 0.5) / (toxic + 1)) - np.log((m + 0.5) / (clean + 1)) < LEAST_ODDS:
        return False
    share = toxic / (toxic + clean)
    ratio = n * np.log(n / (n + m) / share) + (m * np.log(m / (n + m) / (1 - share)) if m else 0.0)
    return 2 * ratio >= LEAST_RATIO


def fit(rows: list[tuple[str, int]], prior: float | None = None) -> Chain:
    """A chain from (text, toxic) rows. prior: the share of toxic documents that scores should reflect."""
    rows = list({text: (text, label) for text, label in rows}.values())  # copies would make rare words stand out
    parsed = [(tokens(text), label) for text, label in rows]
    toxic, clean = sum(y for _, y in parsed), sum(1 - y for _, y in parsed)
    prior = prior if prior is not None else (toxic + 0.5) / (len(parsed) + 1)
    flat = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if not toxic or not clean:
        return Chain({}, -6.0, np.zeros((2, 2)), np.array([flat, 0.0, 0.0]))
    seen = (Counter(), Counter())
    for words, label in parsed:
        seen[label].update({f for w in set(words) for f in features(w)})
    marked = {f for f, n in seen[1].items() if _stands_out(n, seen[0][f], toxic, clean)}
    ids = {f: i for i, f in enumerate(sorted(marked))}
    at, which, labels, starts, lengths = [], [], [], [], []
    known: dict[bytes, list[int]] = {}
    n = 0
    for words, label in parsed:
        lengths.append(len(words))
        for k, w in enumerate(words):
            if w not in known:
                known[w] = [ids[f] for f in features(w) if f in ids]
            for j in known[w]:
                at.append(n), which.append(j)
            labels.append(label if known[w] else 0), starts.append(k == 0)
            n += 1
    at, which = np.array(at, np.int64), np.array(which, np.int64)
    y, first = np.array(labels, float), np.array(starts, bool)
    inner = np.flatnonzero(~first)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    theta = np.zeros(len(ids) + 1 + 4)
    theta[len(ids)] = -3.0
    speed, size = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        emission = np.bincount(at, theta[which], n) + theta[len(ids)]
        p, expected = marginals(emission, first, theta[-4:].reshape(2, 2), pairs=True)
        off = y - p
        slope = np.concatenate([np.bincount(which, off[at], len(ids)), [off.sum()], (seen_pairs - expected).ravel()]) / max(1, y.sum()) - PENALTY * theta
        speed = 0.9 * speed + 0.1 * slope
        size = 0.99 * size + 0.01 * slope * slope
        theta += RATE * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-8)
    chain = Chain({f: float(theta[i]) for f, i in ids.items()}, float(theta[len(ids)]), theta[-4:].reshape(2, 2).copy(), np.zeros(3))
    p = marginals(np.bincount(at, theta[which], n) + theta[len(ids)], first, chain.transitions)
    x = summaries(p, np.array(lengths))
    t = np.array([label for _, label in parsed], float)
    weight = np.where(t == 1, prior / toxic, (1 - prior) / clean)
    x = np.column_stack([np.ones(len(x)), x])
    c = np.array([flat, 0.0, 0.0])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([1e-6, 1e-3, 1e-3])
        move = np.linalg.solve(hess, x.T @ (weight * (t - q)) - np.array([0, 1e-3, 1e-3]) * c)
        c = c + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    chain.calibration = c
    return chain


def summaries(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log(1 + expected toxic tokens) and the largest marginal of each document."""
    out = np.zeros((len(lengths), 2))
    full = np.flatnonzero(lengths)
    if len(full):
        edges = (np.cumsum(lengths) - lengths)[full]
        out[full, 0] = np.log1p(np.add.reduceat(p, edges))
        out[full, 1] = np.maximum.reduceat(p, edges)
    return out


def spans(text: str, toxic: np.ndarray) -> list[dict]:
    """Offsets (start, end) in code points of runs of toxic tokens; toxic has a boolean for each token of the text."""
    data = text.encode("utf-8", "replace")
    found = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_BREAKS))]
    runs: list[list[int]] = []
    for i in np.flatnonzero(toxic[: len(found)]):
        if runs and i and toxic[i - 1]:
            runs[-1][1] = found[i][1]
        else:
            runs.append(list(found[i]))
    chars = lambda n: len(data[:n].decode("utf-8", "ignore"))
    return [{"start": chars(a), "end": chars(b)} for a, b in runs]


def _emissions(words: list[bytes], chain: Chain, known: dict[bytes, float]) -> np.ndarray:
    weight = chain.weights.get
    out = []
    for w in words:
        e = known.get(w)
        if e is None:
            if len(known) > _CACHE:
                known.clear()
            e = known[w] = chain.bias + sum(weight(f, 0.0) for f in features(w))
        out.append(e)
    return np.array(out)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, score, spans for every row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for whole in batches:
            for batch in sliced(whole, limit=2 << 20):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                parts = [_emissions(tokens(t), model, known) for t in texts]
                lengths = np.array([len(p) for p in parts])
                ends = np.cumsum(lengths)
                first = np.zeros(int(ends[-1]), bool)
                first[(ends - lengths)[lengths > 0]] = True
                p = marginals(np.concatenate(parts), first, model.transitions)
                x = np.column_stack([np.ones(len(texts)), summaries(p, lengths)])
                scores = 1 / (1 + np.exp(-np.clip(x @ model.calibration, -30, 30)))
                toxic = p >= SPAN
                found = [spans(t, toxic[b - n : b]) if n and toxic[b - n : b].any() else [] for t, n, b in zip(texts, lengths, ends)]
                kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(found, kinds)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:int,end:int>>")


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """A chain from a bounded sample of the labelled rows outside the held-out fold."""
    usable = labels.where(F.col("toxic").isNotNull() & (remainder_of_id(FOLDS) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = None
    for label in (0, 1):
        some = first_by_hash(usable.where(F.col("toxic") == label), "doc_id", TRAIN_DOCS)
        chosen = some if chosen is None else chosen.union(some)
    # At most 2 * TRAIN_DOCS rows, whatever the tables' size.
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.coalesce(F.min_by("text", F.xxhash64("text")), F.lit("")).alias("text"))
    held = materialize(one.select("doc_id", "toxic", "text", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("place")))
    before = F.sum("n").over(Window.partitionBy("toxic").orderBy(F.col("n") > TRAIN_BYTES // 16, "place", "doc_id")) - F.col("n")
    rows = held.where(F.col("n") <= TRAIN_BYTES).withColumn("before", before).where(F.col("before") < TRAIN_BYTES).select("text", "toxic").collect()
    discard(held)
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    return fit(sorted((r["text"], int(r["toxic"])) for r in rows), prior)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans."""
    scored = score(docs, train(docs, labels))
    held_out = F.coalesce(remainder_of_id(FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
