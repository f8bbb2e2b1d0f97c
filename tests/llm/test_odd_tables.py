"""Every operator on nulls, empty and long texts, repeated rows, empty tables, and columns with names like its own."""

import pytest

from lorevane.llm import decontam, gbdt, html_template, lm_score, packing, rules, sharding, simhash, suffix_dedup, token_files, toxicity

BY_DOCUMENT = {
    "packing": lambda d, t: packing.digest(d).where("piece = 0"),
    "toxicity": lambda d, t: toxicity.digest(d, t["labels"]),
    "gbdt": lambda d, t: gbdt.digest(d, t["labels"]),
    "suffix_dedup": lambda d, t: suffix_dedup.digest(d),
    "simhash": lambda d, t: simhash.digest(d),
    "decontam": lambda d, t: decontam.digest(d, t["benchmark"]),
    "lm_score": lambda d, t: lm_score.digest(d),
    "rules": lambda d, t: rules.digest(d),
    "sharding": lambda d, t: sharding.digest(d),
    "token_files": lambda d, t: token_files.digest(d),
    "rules.keep": lambda d, t: rules.keep(d),
    "simhash.keep_one": lambda d, t: simhash.keep_one(d),
    "suffix_dedup.clean": lambda d, t: suffix_dedup.clean(d),
    "decontam.clean": lambda d, t: decontam.clean(d, t["benchmark"]),
}


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_odd_rows(tables, odd, name):
    rows = BY_DOCUMENT[name](odd, tables).collect()
    ids = sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x or 0))
    if name == "rules.keep":
        assert ids == [6]  # the long text and the one that repeats have too many repeated windows
    elif name == "simhash.keep_one":
        assert ids == [1, 4, 5, 6, 7, None]
    else:
        assert ids == [1, 2, 3, 4, 5, 6, 7, 7, 8, None]
    if "." in name:
        assert rows[0].asDict().keys() == set(odd.columns)


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_empty_tables(none, name):
    assert BY_DOCUMENT[name](none["documents"], none).collect() == []


def test_empty_pages_labels_and_benchmark(tables, none):
    assert html_template.digest(none["pages"]).collect() == []
    few = tables["documents"].where("doc_id < 5")
    for made in (toxicity.digest(few, none["labels"]), gbdt.digest(few, none["labels"])):
        assert {0 < r["score"] < 1 for r in made.collect()} == {True}
    assert {(r["n_hit"], r["contaminated"]) for r in decontam.digest(few, none["benchmark"]).collect()} == {(0, False)}
    assert packing.digest(none["documents"]).collect() == []


def test_values_of_odd_rows(odd, tables):
    n = {r["doc_id"]: r for r in rules.digest(odd).collect()}
    assert [n[i]["n_words"] for i in (1, 2, 3, 4, 6)] == [0, 0, 0, 1, 11] and all(n[i]["base_failed"] for i in (1, 2, 3, 4))
    fp = {r["doc_id"]: r for r in simhash.digest(odd).collect()}
    assert fp[1]["fingerprint"] == fp[3]["fingerprint"] == "0" * 16 and fp[3]["component_id"] == 1 and fp[8]["component_id"] == 7
    gone = {r["doc_id"]: r for r in suffix_dedup.digest(odd).collect()}
    assert gone[7]["n_removed"] == gone[7]["n_bytes"] == gone[8]["n_removed"] and gone[1]["n_bytes"] == 0
    scores = {r["doc_id"]: r["score"] for r in toxicity.digest(odd, tables["labels"]).collect()}
    assert scores[1] == scores[2] == scores[3]
    lm = {r["doc_id"]: r for r in lm_score.digest(odd).collect()}
    assert lm[1]["n_tokens"] == 0 and lm[1]["log_likelihood"] == 0 and lm[1]["mean_log_likelihood"] is None and lm[5]["n_tokens"] == 80_000


def test_own_folder_only_in_local_sessions_without_a_setting():
    from types import SimpleNamespace

    from lorevane.llm.common import shared_dir

    session = lambda value, master="local[2]": SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: master if key == "spark.master" else value))
    assert shared_dir(session("hdfs://store/checkpoints/", "yarn")) == "hdfs://store/checkpoints"
    assert shared_dir(session(None)) == shared_dir(session(None)) and shared_dir(session(None)).startswith("file:///")
    with pytest.raises(ValueError):
        shared_dir(session(None, "spark://host:7077"))


def test_very_long_runs_are_packed_like_any_text(spark):
    """A million of one character: the ids are those of the tokenizer file, whatever the quick way can take."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    said = {i: c * 1_000_000 for i, c in enumerate([" ", "\n", "a", "\u3000"])} | {9: "word" + " " * 9_999 + "word"}
    rows = packing.digest(spark.createDataFrame(list(said.items()), "doc_id long, text string")).collect()
    for i, text in said.items():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
        parts = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["length"] for r in parts) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in parts)


def test_one_row_of_each_group_stays_and_no_other_text_is_lost(spark):
    import random

    rng = random.Random(2)
    prose = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6)]
    rows = [(None, prose[0]), (None, prose[1]), (1, prose[2]), (1, prose[3]), (1, prose[3]), (2, prose[2]), (3, prose[4]), (None, prose[4]), (5, None), (4, ""), (None, " ")]
    docs = spark.createDataFrame([(*r, k % 2) for k, r in enumerate(rows)], "doc_id long, text string, th int")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(0, prose[0]), (0, prose[1]), (1, prose[2]), (1, prose[3]), (3, prose[4]), (4, "")])
    assert [r["th"] for r in got.where("doc_id = 1").orderBy("text").collect()] == [r["th"] for r in simhash.keep_one(docs.repartition(7)).where("doc_id = 1").orderBy("text").collect()]


def test_tables_that_nothing_reads_are_deleted(spark, tables):
    """What stays in the shared folder is what the returned table reads."""
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/lorevane"
    os.makedirs(folder, exist_ok=True)
    for name, most in (("simhash", 2), ("simhash.keep_one", 2), ("suffix_dedup", 1)):
        before = set(os.listdir(folder))
        rows = BY_DOCUMENT[name](tables["documents"], tables)
        assert len(set(os.listdir(folder)) - before) <= most and rows.count() > 0
