"""The pipeline against plain versions of its stages."""

import random

import brute
import corpus_pipeline
import duckdb
from tokenizers import Tokenizer

import public_tokenizers
from lorevane.llm import rules

SF = "/root/testdata/sf0.001"


def test_run(spark, tables):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({rules.ORACLE}) WHERE kept").fetchall()}
    said = {r["doc_id"]: r["text"].encode() for r in tables["documents"].collect() if r["doc_id"] in kept}
    ids = sorted(said)
    roots = brute.linked([brute.simhash(said[i]) for i in ids])
    ids = [i for k, i in enumerate(ids) if roots[k] == k]
    hits = brute.repeated([said[i] for i in ids], corpus_pipeline.REPEATED_BYTES)
    cleaned = {}
    known = brute.windows([(r["item_id"], r["text"]) for r in tables["benchmark"].collect()])
    for i, hit in zip(ids, hits):
        parts, text = [], said[i]
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and hit[end] == hit[at]:
                end += 1
            if not hit[at]:
                parts.append(text[at:end].decode("utf-8", "ignore"))
            at = end
        cleaned[i] = brute.without_hits("".join(parts).encode(), known).decode("utf-8", "ignore")
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in cleaned.items()}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_stages_keep_the_columns(spark, tables):
    docs = tables["documents"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0.5 * docs.count()


def written(folder, **tables):
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_run_on_odd_rows(spark, tables, odd, tmp_path):
    """Nulls, long and repeated texts, null ids and extra columns: what the rules keep is packed whole, the rest is gone."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long, twice = prose(30_000), prose(40)
    more = [(20, long), (21, twice), (21, twice), (None, prose(30)), (None, prose(31)), (22, prose(50) + " " + (shared := prose(60)) + " " + prose(40)), (23, prose(45) + " " + shared + " " + prose(55))]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = {}
    for r in corpus_pipeline.run(spark, written(tmp_path, documents=docs, benchmark=tables["benchmark"])).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got.keys() == {6, 20, 21, None, 22, 23}
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = lambda text: len(whole.encode(text, add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in got[20]) == size(long) and sum(r["length"] for r in got[21]) == size(twice)
    assert [r["piece"] for r in got[None]] == [0, 0]
    assert all(sum(r["length"] for r in got[i]) < size(more[k][1]) - 60 for i, k in ((22, 5), (23, 6)))
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for rows in got.values() for r in rows)
    for a, b in zip(places, places[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)


def test_run_on_empty_tables(spark, none, tmp_path):
    assert corpus_pipeline.run(spark, written(tmp_path, documents=none["documents"], benchmark=none["benchmark"])).collect() == []
