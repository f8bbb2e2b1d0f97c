"""Spelling variants: words that differ by one code point, grouped under the one that occurs far more often.

Words are counted in tasks, then blocked by their length and by how many of their letters fall in each of two groups of
letters. One inserted letter makes a word one longer and adds one to at most one group; a replaced one keeps the length
and moves at most one from a group to another. So a word's near words lie in a few neighbouring blocks, and every pair of
neighbouring blocks is a unit of work. There a product of the two blocks' letter counts (numpy) gives all squared distances;
pairs at most two apart are kept and verified code point by code point. Blocks are cut at `BLOCK` words, so a unit is
bounded whatever the words; pairs of blocks are made by joins on block keys and nothing passes the driver.

A word's form is its near word of largest n (ties: the smallest in code-point order) if that is at least `RATIO` times the
word's own. Along forms n grows by that factor each time, so following them ends; roots are found by pointer doubling.

Null and empty texts have no words. A null id is written as an empty string before the colon. Very long texts are read
whole, and very long runs are words. Repeated rows count each. Empty tables give no rows. Extra columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

LEAST_LETTERS, LEAST, RATIO = 6, 5, 5
#: Every so many-th run of a document, by a hash, loses a letter.
MISSPELT = 199
BLOCK = 2048
#: Words that a task counts before it passes the counts on.
HELD = 200_000
#: Rows of a block that are multiplied with the other at once.
AT_ONCE = 512
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Two groups of letters that hold about a third of a text each.
GROUPS = ("aeiou", "nrtsl")
#: Columns of the count matrix: a-z, and the rest in a few. What shares a column can only come closer.
COLUMNS = 32


def _column(code: np.ndarray) -> np.ndarray:
    return np.where(code < 128, code - 97, 26 + code % 6)


def runs_of(doc_id: str, text: str, misspelt: int = MISSPELT) -> Counter:
    """The runs of letters of a text in lower case with their number; every `misspelt`-th has lost a letter."""
    out: Counter = Counter()
    head = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
        h = zlib.crc32(run.encode(), head)
        if h % misspelt == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def count_words(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST) -> DataFrame:
    """word, n of the words of docs(doc_id, text) with so many letters and occurrences at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                held.update({w: n for w, n in runs_of(doc_id.as_py() or "", text.as_py() or "").items() if len(w) >= letters})
                if len(held) > HELD:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """length, g1, g2, b, words: the words of each key of length and groups in arrays of about `block`, dealt by a hash."""
    kept = lambda letters: F.length(F.regexp_replace("word", f"[^{letters}]", ""))
    keyed = words.select("word", F.length("word").alias("length"), kept(GROUPS[0]).alias("g1"), kept(GROUPS[1]).alias("g2"))
    many = keyed.groupBy("length", "g1", "g2").agg(F.ceil(F.count("*") / block).alias("many"))
    dealt = keyed.join(many, ["length", "g1", "g2"]).withColumn("b", F.pmod(F.xxhash64("word"), F.col("many")))
    # By all four: else the words of one key would meet in the task that looked up `many`.
    return dealt.repartition("length", "g1", "g2", "b").groupBy("length", "g1", "g2", "b").agg(F.collect_list("word").alias("words"))


#: (longer by, more of the first group, more of the second) of the blocks that a block is paired with, besides itself.
NEIGHBOURS = ((0, 0, 1), (0, 1, 0), (0, 1, -1), (1, 0, 0), (1, 1, 0), (1, 0, 1))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of one length, a row each, and their letter counts."""
    codes = np.frombuffer("".join(words).encode("utf-16-le"), "<u2").reshape(len(words), -1).astype(np.int64)
    counts = np.zeros((len(words), COLUMNS), np.float32)
    np.add.at(counts, (np.arange(len(words))[:, None], _column(codes)), 1)
    return codes, counts


def near_pairs(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of two blocks that are one edit apart; right words are as long as left ones or one longer."""
    a, x = _codes(left)
    b, y = _codes(right)
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    found = [np.zeros((2, 0), np.int64)]
    for first in range(0, len(a), AT_ONCE):
        square = xx[first : first + AT_ONCE, None] + yy - 2 * (x[first : first + AT_ONCE] @ y.T)  # whole numbers: exact
        i, j = np.nonzero(square <= 2)
        i += first
        if a.shape[1] == b.shape[1]:
            good = (a[i] != b[j]).sum(axis=1) == 1
        else:
            differs = a[i] != b[j][:, :-1]
            at = np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])  # the letter that the right one has more
            after = np.arange(a.shape[1]) >= at[:, None]
            good = ((a[i] == b[j][:, 1:]) | ~after).all(axis=1)
        found.append(np.stack([i[good], j[good]]))
    return tuple(np.concatenate(found, axis=1))


def edges(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near: every two of words(word) that are one edit apart, both ways."""
    held = materialize(blocks(words, block))
    key = ["length", "g1", "g2"]
    shifts = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(n, ("d", "d1", "d2")))) for n in ((0, 0, 0), *NEIGHBOURS)))
    met = held.select(*key, "b", F.explode(shifts).alias("s")).select(*(F.col(k).alias(f"_{k}") for k in (*key, "b")), (F.col("length") + F.col("s.d")).alias("length"), (F.col("g1") + F.col("s.d1")).alias("g1"), (F.col("g2") + F.col("s.d2")).alias("g2"), (F.array_max(F.array("s.d", F.abs("s.d1"), F.abs("s.d2"))) == 0).alias("own"))
    pairs = met.join(held.select(*key, "b").hint("merge"), key).where("NOT own OR _b <= b")
    left = held.select(*(F.col(k).alias(f"_{k}") for k in (*key, "b")), F.col("words").alias("left"))
    units = pairs.join(left.hint("merge"), [f"_{k}" for k in (*key, "b")]).join(held.withColumnRenamed("words", "right").hint("merge"), [*key, "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, same in zip(*(batch[c] for c in ("left", "right", "same"))):
                a, b = left.as_py(), right.as_py()
                i, j = near_pairs(a, b)
                if same.as_py():  # a block with itself finds each pair both ways
                    i, j = i[i < j], j[i < j]
                a, b = pa.array(a).take(pa.array(i)), pa.array(b).take(pa.array(j))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([b, a])], names=["word", "near"])

    # A unit is much work however small its bytes: a task gets some tens of them.
    dealt = units.select("left", "right", (F.col("own") & (F.col("_b") == F.col("b"))).alias("same")).repartition(max(1, held.count() // 8), F.xxhash64("left", "right"))
    return dealt.mapInArrow(run, "word string, near string")


def forms(words: DataFrame, links: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, form, form_n, n_near of words(word, n) with links(word, near) both ways."""
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = links.join(other, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(best, "word", "left").withColumn("found", -F.col("best.less") >= F.col("n").cast("decimal(20,0)") * ratio)
    return out.select("word", "n", F.when(F.col("found"), F.col("best.near")).alias("form"), F.when(F.col("found"), -F.col("best.less")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root of every word(word, form) that has a form: the last of its forms. Each round doubles the steps taken."""
    steps = materialize(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not steps.where("moved").isEmpty():
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, steps = steps, materialize(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(before)
    return steps.select("word", "root")


def variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs(doc_id, text)."""
    words = materialize(count_words(docs))
    formed = materialize(forms(words, edges(words, block)))
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return variants(docs)
