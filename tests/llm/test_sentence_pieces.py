"""SentencePiece encoding in rounds against the library itself."""

import hashlib
import random
import time

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfold.llm import queries, sentence_pieces
from loomfold.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.PieceBPE(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def agrees(model, library, text):
    ids = model.encode_batch([text])[0]
    want = library.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert model.decode(ids).decode() == library.decode(want)


TRICKY = [
    "", " ", "  ", "   a", "▁", "▁a", "a▁b", " ▁ ", "\0a\0", "<s></s><unk> ⁇ ", "<0x0A>", "日本語テキスト。한국어 текст", "👩‍👩‍👧 🇩🇪", "\n\n\t", "a" * 5000, " " * 700, "é" * 700, "ab" * 700, "﻿x", "\r\n",
    "************************", "x" * 512, "x" * 513, "=" * 2000, " a" * 1000, "bookkeeper's  co-operative", "é combining   \U0010ffff",
]


@pytest.mark.parametrize("text", TRICKY)
def test_ids_are_the_librarys(model, library, text):
    agrees(model, library, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("estinroab  ▁.,'129é日\n<0x>")), st.characters(blacklist_categories=["Cs"])), max_size=80))
def test_ids_are_the_librarys_on_any_text(model, library, text):
    agrees(model, library, text)


def test_pieces_put_together_at_random(model, library):
    """Pieces side by side make the pairs in which one merge at a time and all at once could differ."""
    some = random.Random(3)
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    for k in range(3000):
        agrees(model, library, "".join(some.choice(pieces) for _ in range(some.randint(1, 8))).replace("▁", " " if k % 2 else ""))


@pytest.mark.parametrize(("long", "slab", "waiting", "cache"), [(1, 7, 3, 5), (4, 50, 100, 1), (10_000, 64, 1, 50)])
def test_bounds_do_not_change_the_ids(library, monkeypatch, long, slab, waiting, cache):
    for name, value in (("LONG_WORD", long), ("SLAB_CHARS", slab), ("WAITING_WORDS", waiting), ("CACHE_WORDS", cache), ("ROUND_SYMBOLS", 40)):
        monkeypatch.setattr(sentence_pieces, name, value)
    small = sentence_pieces.PieceBPE(PATH)
    texts = ["It's a long text,  with spaces and\n\nlines: 12,345 wörds. " * 30, "", "abcabcabc" * 100, *TRICKY]
    for text, ids in zip(texts, small.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
        assert small.decode(ids).decode() == library.decode(library.encode(text))


@pytest.mark.parametrize("text", ["\n" * 500_000, " " * 200_000, "ab" * 200_000, "".join(random.Random(5).choices("abcdefgh", k=200_000)), "word " * 300_000])
def test_very_long_texts_and_words(model, library, text):
    began = time.perf_counter()
    agrees(model, library, text)
    assert time.perf_counter() - began < 30


def test_decoding_of_any_ids(model):
    ids = lambda *x: np.array(x, "<u4").tobytes()
    assert model.decode(b"") == b""
    assert model.decode(ids(*model.byte_ids[list("é".encode())])) == "é".encode()
    assert model.decode(ids(model.byte_ids[0xC3], model.byte_ids[0x41])) == "�A".encode()


def test_frames(spark, library):
    rows = [(1, "a b  c"), (2, None), (None, "日本"), (2, ""), (2, "a b  c")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, ids int, n_tokens string")
    got = sentence_pieces.encode_documents(docs, PATH)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], bytes(r["ids"])) for r in got.collect()) == sorted((i or 0, len(library.encode(t or "")), np.array(library.encode(t or ""), "<u4").tobytes()) for i, t in rows)
    assert {r["text"] for r in sentence_pieces.decode_documents(got, PATH).collect()} == {"a b  c", "", "日本"}
    assert sentence_pieces.encode_documents(docs.limit(0), PATH).count() == 0
    assert sentence_pieces.digests(docs.where("doc_id = 9"), PATH).count() == 0


def test_query_is_the_library_on_the_whole_table(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text")).collect()}
    got = queries.op11_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
