"""Operator 12 against SQL and loops, and the bound that its first pass rests on."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorevane.llm import collocations

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def loops(rows, top, least, share, longest=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    kept = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in kept.items():
        score, _, l, r = min((2000000 * a // (f[lang, p[:c]] + f[lang, p[c:]]), c, f[lang, p[:c]], f[lang, p[c:]]) for c in range(1, len(p)))
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if not any(x == lang and len(q) > len(p) and inside(q) and 100 * b >= share * a for (x, q), b in kept.items()):
            out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out.sort()
    ranks = Counter()
    got = []
    for lang, score, a, p, l, r in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            got.append((lang, ranks[lang], p.decode(), -a, l, r, n[lang], -score))
    return got


ROWS = [
    ("en", "a b c d. a b c d! a b, c d a b c\td  a b\nA B c; é ü é ü é ü : é ü"), ("en", None), ("en", ""), (None, "x y x y x y"), ("und", "x y X Y"),
    ("de", "a b a b a b a b"), ("de", "z" * 70_000 + " a b " + "z" * 70_000 + " a b"), ("en", " ".join(["same"] * 50)), ("en", " ".join(["same"] * 50)), ("", "p q p q p q"), ("en", "\x0b\x0c..,\x00 \x00 \x00 \x00"),
]


@pytest.mark.parametrize("parts, bits", [(1, 64), (3, 1 << 10), (5, 1 << 20)])
@pytest.mark.parametrize("least, top, share", [(3, 5, 80), (2, 2000, 50)])
def test_equals_loops(spark, parts, bits, least, top, share):
    frame = spark.createDataFrame(ROWS, "lang string, text string").repartition(3)
    for c in ("phrase", "k", "f", "n", "part", "rank"):
        frame = frame.selectExpr("*", f"'clash' AS {c}")
    got = collocations.collocations(frame, top, least, share, parts=parts, bits=bits)
    assert sorted(map(tuple, got.collect())) == sorted(loops(ROWS, top, least, share))


def test_equals_sql(spark, tables):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = collocations.digest(tables["documents"])
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({collocations.ORACLE})").fetchall())


def test_empty_tables(none, odd):
    assert collocations.digest(none["documents"]).collect() == []
    assert {r["lang"] for r in collocations.digest(odd.selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=30), min_size=1, max_size=12), st.integers(2, 9))
def test_no_frequent_key_is_lost(rounds, least):
    """Whatever the order and the cuts; and no more than the capacity is kept."""
    true = Counter(x for r in rounds for x in r)
    summary = collocations.Summary(sum(true.values()), least)
    for r in rounds:
        keys, n = np.unique(np.array(r, np.uint32), return_counts=True)
        summary.add(keys, n.astype(np.int64))
        summary.merge()
        assert len(summary.keys) <= summary.capacity and summary.taken < least
    assert {x for x, n in true.items() if n >= least} <= set(summary.survivors().tolist())


def test_counts_over_64_bits(spark):
    """Scores and shares of counts whose products pass 64 bits."""
    big = 9 * 10**17
    rows = [("en", "a", 1, big), ("en", "b", 1, big - 7), ("en", "c", 1, big), ("en", "a b", 2, big - 9), ("en", "b c", 2, 5), ("en", "a b c", 3, big // 100 * 79)]
    got = {r["phrase"]: r for r in collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, k int, f long")).collect()}
    assert set(got) == {"a b", "a b c"} and got["a b"]["score"] == 2000000 * (big - 9) // (2 * big - 7)
