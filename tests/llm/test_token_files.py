"""Operator 11: token files against the tokenizer on whole texts, and what lies in the folder."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorevane.llm import token_files

FILE = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(FILE)


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0  　'sdrveAÉ́ͅςΣİ1２<|>_"), st.characters(exclude_categories=["Cs"])), max_size=60), st.booleans())
def test_runs_between_white_space_give_the_ids_of_the_whole_text(text, special):
    text = text + "<|endoftext|>" * special + text
    made = b"".join(token_files._encoder(FILE).texts([text.encode()], 1))
    assert np.frombuffer(made, "<u2").tolist() == ids_of(text)


def test_equals_the_tokenizer(spark, tables):
    docs = tables["documents"].orderBy("doc_id").collect()
    want, at = [], 0
    for r in docs:
        ids = ids_of(r["text"])
        want.append((r["doc_id"], at, len(ids), crc(ids)))
        at += len(ids)
    got = token_files.digest(tables["documents"].repartition(7)).orderBy("doc_id").collect()
    assert list(map(tuple, got)) == want


def test_odd_documents(odd):
    docs = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got = sorted(token_files.digest(odd).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(r["doc_id"], len(ids_of(r["text"])), crc(ids_of(r["text"]))) for r in docs]
    assert [r["start"] for r in got] == np.cumsum([0, *(len(ids_of(r["text"])) for r in docs)]).tolist()[:-1]


def test_files_of_a_folder(spark, tables, tmp_path):
    """Only files that the index names stay, bases are sums over the parts before, and each part stands for itself."""
    folder = f"file://{tmp_path}/made"
    token_files.write(tables["documents"], folder, FILE)
    index = token_files.read_index(spark, folder).orderBy("part").collect()
    assert {p.name for p in (tmp_path / "made").iterdir() if p.is_file()} == {f"{r['file']}.{k}" for r in index for k in ("ids", "offsets", "docs")}
    assert [r["first_token"] for r in index] == np.cumsum([0, *(r["tokens"] for r in index)]).tolist()[:-1]
    texts = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    for r in index:
        part = token_files.Part(folder, r["file"], r["width"], r["documents"], r["nulls"])
        ids, at = part.doc_ids(0, part.documents), part.offsets(0, part.documents)
        middle = part.documents // 2
        assert part.ids(at[middle], at[middle + 1]).tolist() == ids_of(texts[ids[middle]])
        assert ids == sorted(ids) and at[-1] == r["tokens"] and r["width"] == 2


def test_a_store_without_memory_maps(tables, tmp_path, monkeypatch):
    import pyarrow.fs as pafs

    folder = f"file://{tmp_path}/made"
    token_files.write(tables["documents"].limit(20), folder, FILE)
    index = token_files.read_index(tables["documents"].sparkSession, folder).collect()
    of = lambda: [token_files.Part(folder, r["file"], r["width"], r["documents"], r["nulls"]).ids(0, r["tokens"]).tolist() for r in index]
    mapped = of()
    monkeypatch.setattr(token_files, "store_of", lambda uri: (pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem()), "made"))
    assert of() == mapped
