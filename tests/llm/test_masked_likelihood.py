"""Operator 8: what the network learns from, and what words are scored by."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorevane.llm import lm_score


def test_partitions_of_the_input_do_not_matter(spark, tables, monkeypatch):
    """Several shards, 2 and 16 partitions: the same network, to the last bit."""
    monkeypatch.setattr(lm_score, "SHARD_BYTES", 40_000)
    monkeypatch.setattr(lm_score, "LEARNED_AT_ONCE", 10_000)
    docs = tables["documents"].select("doc_id", "text")
    v = lm_score.vocabulary(docs)
    assert v.size > 4 * lm_score.SHARD_BYTES
    one, other = (lm_score.train(docs.repartition(n), v) for n in (2, 16))
    assert all(np.array_equal(x, y) for x, y in zip(one, other))
    rows = lambda p, n: {r["doc_id"]: r["log_likelihood"] for r in lm_score.score(docs.repartition(n), v, p).collect()}
    few, many = rows(one, 2), rows(other, 16)
    assert few.keys() == many.keys() and all(math.isclose(few[i], many[i], rel_tol=1e-5, abs_tol=1e-5) for i in few)


def test_places_of_words_are_the_targets():
    texts = [b"", b"one", *(b" ".join(b"%d-%d" % (n, i) for i in range(n)) for n in (3, 5, 500))]
    reader = lm_score.Reader(lm_score.Vocabulary({}, [-1.0] * lm_score.CLASSES, [-5.0] * 257, [0] * lm_score.ENDINGS))
    classes, _, lengths, of_word = reader.read(texts)
    assert len(np.flatnonzero(classes)) == len(of_word) == sum(lengths) == 509
    fresh = lm_score.Reader(lm_score.Vocabulary({b"one": (7, 0.0)}, [-1.0] * lm_score.CLASSES, [-5.0] * 257, [0] * lm_score.ENDINGS))
    assert fresh.read([b"one one"])[0].tolist() == [0, 0, 7, 7, 0, 0]


def test_learning_step_is_that_of_the_slopes():
    """Slopes against differences of the loss, on places with repeated classes."""
    rng = np.random.default_rng(0)
    classes = np.concatenate([[0, 0], rng.integers(1, 9, 60), [0, 0]])
    at = np.arange(2, 62)
    p = [x.astype(np.float64) for x in lm_score.start()]
    moved, squares = [x.copy() for x in p], [np.full_like(x, 1e12) for x in p]  # so large that slopes can be read off
    lm_score.learn(moved, squares, classes, at)
    loss = lambda q: -float(np.mean([t - math.log(sum(math.exp(e) for e in row)) for t, row in ((lm_score.odds(q, lm_score.hidden(q, classes, np.array([i])))[0][classes[i]], lm_score.odds(q, lm_score.hidden(q, classes, np.array([i])))[0]) for i in at)]))
    for k, place in ((0, (1, int(classes[5]), 3)), (0, (3, int(classes[9]), 0)), (1, (2,)), (2, (4, int(classes[7]))), (3, (int(classes[8]),))):
        up, down = [x.copy() for x in p], [x.copy() for x in p]
        up[k][place] += 1e-4
        down[k][place] -= 1e-4
        want = (loss(up) - loss(down)) / 2e-4
        got = (p[k][place] - moved[k][place]) * math.sqrt(1e12) / lm_score.RATE
        assert got == pytest.approx(want, rel=1e-2, abs=1e-4)


def test_score_is_the_sum_over_all_words(spark, tables):
    """Every document against a loop over its words."""
    docs = tables["documents"].select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (9003, "ONE word\tone")], "doc_id long, text string"))
    v = lm_score.vocabulary(docs)
    p = lm_score.train(docs, v)
    counts = {}
    for r in docs.collect():
        for w in lm_score.words((r["text"] or "").encode()):
            counts[w] = counts.get(w, 0) + 1
    frequent = sorted(counts, key=lambda w: (-counts[w], w))[: lm_score.FREQUENT]
    class_of = lambda w: 1 + frequent.index(w) if w in frequent else v.tail_class(w)
    totals = [1.0] * lm_score.CLASSES
    known = {w: class_of(w) for w in counts}
    for w, n in counts.items():
        totals[known[w]] += n
    got = {r["doc_id"]: r for r in lm_score.score(docs, v, p).collect()}
    some = docs.where("doc_id % 10 = 3 OR doc_id > 9000").collect()
    for r in some:
        said = lm_score.words((r["text"] or "").encode())
        classes = [0, 0, *(known[w] for w in said), 0, 0]
        want = 0.0
        for i, w in enumerate(said, 2):
            h = np.tanh(p[1] + sum(p[0][k][classes[i + s]] for k, s in enumerate(lm_score.SIDES)))
            e = h @ p[2] + p[3]
            want += float(e[classes[i]]) - math.log(float(np.exp(e.astype(float)).sum()))
            want += 0.0 if w in frequent else math.log(counts[w] / totals[known[w]])
        assert got[r["doc_id"]]["n_tokens"] == len(said)
        assert got[r["doc_id"]]["log_likelihood"] == pytest.approx(want, rel=1e-4, abs=1e-3)
    assert got[9001]["mean_log_likelihood"] is None and got[9002]["log_likelihood"] == 0


def test_beats_the_unigram_on_texts_that_it_did_not_see(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    seen, held = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    v = lm_score.vocabulary(seen)
    p = lm_score.train(seen, v)
    got = lm_score.score(held, v, p).agg(F.sum("log_likelihood"), F.sum("n_tokens")).collect()[0]
    counts = {}
    for r in seen.collect():
        for w in lm_score.words(r["text"].encode()):
            counts[w] = counts.get(w, 0) + 1
    total, unigram, n = sum(counts.values()) + 1, 0.0, 0
    for r in held.collect():
        for w in lm_score.words(r["text"].encode()):
            n += 1
            unigram += math.log(counts.get(w, 1) / total) + (0.0 if w in counts else sum(v.of_byte[b] for b in w) + v.of_byte[256])
    assert n == got[1] and got[0] / n > unigram / n + 0.3


def test_counted_words_are_scored_by_their_counts_at_any_size_of_the_vocabulary(spark, tables, monkeypatch):
    docs = tables["documents"].select("doc_id", "text")
    docs = docs.union(docs.limit(20))
    score = lambda v: sorted(tuple(r) for r in lm_score.score(docs, v, lm_score.start()).collect())
    monkeypatch.setattr(lm_score, "VOCABULARY", 1_000_000)
    whole = lm_score.vocabulary(docs)
    assert whole.others.isEmpty()
    want = score(whole)
    monkeypatch.setattr(lm_score, "VOCABULARY", 400)
    few = lm_score.vocabulary(docs)
    assert lm_score.FREQUENT < len(few.known) <= 400 < len(whole.known)
    got = score(few)
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) == docs.count()
    assert np.allclose([r[2] for r in got], [r[2] for r in want]) and not any(r[2] is None for r in got)


def test_words_that_were_not_counted_are_spelt(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a b a zebra zebra")], "doc_id long, text string")
    v = lm_score.vocabulary(docs.where("doc_id = 1"))
    got = lm_score.Reader(v)
    *_, lengths, of_word = got.read([b"zebra zebra a"])
    (other,) = got.others(lengths, of_word).to_pylist()[0]
    assert other["word"] == b"zebra" and other["times"] == 2 and np.isclose(other["spelt"], sum(v.of_byte[b] for b in b"zebra") + v.of_byte[256])
    p, classes, at = lm_score.start(), got.read([b"a b a zebra zebra"])[0], np.arange(2, 7)
    want = lm_score.log_probabilities(p, classes, at).sum() + 2 * (v.unknown[classes[5]] + other["spelt"])
    rows = {r["doc_id"]: r for r in lm_score.score(docs, v, p).collect()}
    assert np.isclose(rows[2]["log_likelihood"], want) and rows[2]["n_tokens"] == 5


def test_endings_with_alike_neighbours_come_together():
    rng = np.random.default_rng(3)
    kinds = rng.dirichlet(np.ones(lm_score.NEIGHBOURS) * 0.2, 4)
    pairs = np.array([rng.multinomial(2000, kinds[i % 4]) for i in range(100)] + [np.zeros(lm_score.NEIGHBOURS, int)])
    group = lm_score.alike(pairs, 4)
    assert len({tuple(sorted({int(g) for g in group[k:100:4]})) for k in range(4)}) == 4 and all(len(set(group[k:100:4])) == 1 for k in range(4))
    assert lm_score.alike(np.zeros((3, lm_score.NEIGHBOURS)), 4).tolist() == [0, 0, 0]


def test_texts_are_read_twice(spark, tables, tmp_path):
    """Once to be counted, once to be encoded: what is learned and scored is a byte for each word."""
    source = tables["documents"].select("doc_id", "text")
    folder = str(tmp_path)

    def seen(batches):
        import uuid

        for batch in batches:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(batch.num_rows))
            yield batch

    got = lm_score.digest(source.mapInArrow(seen, source.schema)).collect()
    assert len(got) == source.count()
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 2 * len(got)


def test_encoded_words_are_those_of_the_texts(spark):
    texts = [None, "", "a b a", " \n", "A\tzebra", "a b a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, "a b a")], "doc_id int, text string")
    v = lm_score.vocabulary(docs)
    rows = lm_score.encode(docs, v).collect()
    assert len({r["row"] for r in rows}) == len(rows) == 7
    for r in rows:
        said = lm_score.words((texts[r["doc_id"]] or "").encode())
        assert list(r["classes"]) == [v.known[w][0] for w in said] and r["n_tokens"] == len(said)
        assert np.isclose(r["x"], sum(v.known[w][1] for w in said)) and r["others"] == []
    assert lm_score.laid([b"", b"\1\2", b"", b"\3"]).tolist() == [0, 0, 1, 2, 0, 0, 3, 0, 0]


def test_odds_are_cut_where_they_could_be_too_large():
    p = lm_score.start()
    classes, at = np.array([0, 0, 5, 9, 5, 0, 0]), np.arange(2, 5)
    p[3][5] = 500
    assert lm_score.odds(p, lm_score.hidden(p, classes, at)).max() == 60
    assert np.isfinite(lm_score.log_probabilities(p, classes, at)).all()
    lm_score.learn(p, [np.full_like(x, 1e-3) for x in p], classes, at)
    assert all(np.isfinite(x).all() for x in p)
