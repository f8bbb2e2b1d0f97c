"""Operator 13 against loops over all pairs of words."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorevane.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def loops(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by.get(len(w) + k, []) if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


WORDS = st.text(st.sampled_from("aenzé÷"), min_size=1, max_size=7)


@settings(max_examples=300, deadline=None)
@given(st.sets(WORDS, min_size=1, max_size=25), st.integers(1, 6), st.booleans())
def test_pairs_of_blocks(words, length, longer):
    left, right = ([w for w in words if len(w) == n] for n in (length, length + longer))
    if left and right:
        got = sorted(zip(*(x.tolist() for x in spelling.near_pairs(left, right))))
        assert got == [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if one_edit(a, b)]


def test_neighbouring_blocks_cover_every_edit():
    """What an edit does to a word's block key is among the pairs of blocks, whichever of the two words is the left one."""
    kinds = [(1, 0), (0, 1), (0, 0)]  # groups of one letter
    paired = {(0, 0, 0), *spelling.NEIGHBOURS}
    for a in kinds:
        assert (1, *a) in paired
        for b in kinds:
            d = (0, a[0] - b[0], a[1] - b[1])
            assert d in paired or tuple(-x for x in d) in paired
    assert not any(tuple(-x for x in d) in paired for d in paired if any(d))  # and no pair of blocks comes twice


@pytest.mark.parametrize("block", [2, 2048])
def test_equals_loops(spark, tables, block):
    docs = [(r["doc_id"], r["text"]) for r in tables["documents"].collect()]
    frame = tables["documents"] if block > 2 else spark.createDataFrame(docs[:40], "doc_id long, text string")
    want = loops(docs if block > 2 else docs[:40])
    assert sorted(map(tuple, spelling.variants(frame, block).collect()), key=lambda r: r[0]) == want


def test_chains_ties_and_odd_rows(spark):
    """A chain of forms, a tie between two forms, misspelt runs, accents, nulls and repeated rows."""
    said = {"abcdef": 3750, "abcdeg": 750, "abcdegh": 150, "abcdeghi": 30, "xbcdeghi": 6, "stoner": 100, "stoned": 100, "stones": 9, "ÉCOLÉS": 40, "École": 99, "écolés": 8, "É×÷éàü": 5}
    text = " ".join(f"{w}1" * n for w, n in said.items())
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "lonely " * 7), (None, text), (4, "q" * 100_000 + " " + "lonelyy " * 6), *((i, "surely the misspelt runs ") for i in range(3000))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("word", "n", "form", "length", "g1", "b", "words", "near"):
        frame = frame.selectExpr("*", f"'clash' AS {c}")
    got = sorted(map(tuple, spelling.digest(frame).collect()), key=lambda r: r[0])
    assert got == loops(rows)
    assert dict((r[0], r[2]) for r in got)["xbcdeghi"] == "abcdef" and any(len(r[0]) == 7 and r[1] == "misspelt" for r in got)


def test_empty_tables(none, odd):
    assert spelling.digest(none["documents"]).collect() == []
    assert len(spelling.digest(odd).collect()) == len(loops([(r["doc_id"], r["text"]) for r in odd.collect()]))
