"""Codecs against the public libraries, best-fit packing against a plain version."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, empty, rows_of, sha
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import bpe, packing

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LETTERS = "ab cdeé́ᰀİΣ\x1c\x85\xa0 \n\t'sdtrem9٣😀<|endoftext|>ÀßŒ—“.,!?-_" + "the and ing "


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(LETTERS, max_size=80), st.text(max_size=60)))
def test_byte_codec_equals_the_library(text):
    library = Tokenizer.from_file(BYTES) if not hasattr(test_byte_codec_equals_the_library, "t") else test_byte_codec_equals_the_library.t
    test_byte_codec_equals_the_library.t = library
    text = text.encode("utf-8", "replace").decode()
    ids = bpe.codec(BYTES).encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert bpe.codec(BYTES).decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(LETTERS, max_size=80), st.text(max_size=60)))
def test_word_ids_equal_the_library(text):
    library = Tokenizer.from_file(WORDS) if not hasattr(test_word_ids_equal_the_library, "t") else test_word_ids_equal_the_library.t
    test_word_ids_equal_the_library.t = library
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(packing.token_buffers([text], WORDS)[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_scan_and_heap_agree():
    c = bpe.codec(BYTES)
    random.seed(3)
    for _ in range(50):
        ids = [c.byte_ids[b] for b in "".join(random.choice("thenadio") for _ in range(random.randrange(1, 90))).encode()]
        assert c._by_scan(list(ids)) == c._by_heap(list(ids))


def test_parts_are_spans_of_the_word():
    c = bpe.codec(BYTES)
    starts, ids = c.parts(b" tokenization")
    assert b"".join(c.bytes_of[i] for i in ids) == b" tokenization" and starts[0] == 0 and all(len(c.bytes_of[i]) == b - a for i, a, b in zip(ids, starts, [*starts[1:], 13]))


def test_round_trip_of_awkward_documents(spark, libraries):
    docs = awkward(spark)
    got = bpe.decode(bpe.encode(docs, BYTES), BYTES)
    assert all(r["decoded"] == (r["text"] or "") for r in got.collect())
    digests = bpe.round_trip_digests(docs, BYTES).collect()
    for r, d in zip(docs.collect(), digests):
        ids = libraries[0].encode(r["text"] or "", add_special_tokens=False).ids
        assert (d["n_tokens"], d["ids_sha256"], d["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(r["text"] or ""))
    assert bpe.encode(empty(spark), BYTES).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 65, 500))[::-1]
    where, offset = packing.best_fit(lengths, 64)
    rooms: list[int] = []
    for need, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        fits = [r for r in rooms if r >= need]
        if fits:
            assert rooms[w] == min(fits)
        else:
            assert w == len(rooms)
            rooms.append(64)
        assert o == 64 - rooms[w]
        rooms[w] -= need


def test_pieces_cover_each_document_once(spark, libraries):
    docs = awkward(spark)
    found = packing.pieces(docs, WORDS, with_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_doc: dict = {}
    for r in found:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] <= 2048
        by_doc.setdefault(r["doc_id"], {}).setdefault(r["start"], r["ids"])
    for doc, parts in by_doc.items():
        ids = [i for s in sorted(parts) for i in parts[s]]
        assert ids == [*libraries[1].encode(texts[doc] or "", add_special_tokens=False).ids, 1]


def test_windows_are_gapless_and_nearly_full(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = packing.pack(packing.pieces(docs, WORDS).cache(), group_pieces=100).collect()
    windows: dict = {}
    for r in packed:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(r["length"] for r in packed)
    assert used > 0.97 * 2048 * len(windows)
    assert sum(r["length"] for r in packed if r["doc_id"] == 3) == next(r["doc_tokens"] for r in packed if r["doc_id"] == 3)


def test_packing_of_awkward_documents(spark):
    found = packing.pieces(awkward(spark), WORDS).cache()
    packed = packing.pack(found)
    assert rows_of(packed, "doc_id", "start", "length") == rows_of(found, "doc_id", "start", "length")
    assert packing.pack(packing.pieces(empty(spark), WORDS)).count() == 0


def test_new_words_merge_together(monkeypatch, libraries):
    random.seed(8)
    words = sorted({" " + "".join(random.choice("thenadioé") for _ in range(random.randrange(1, 30))) for _ in range(3000)})
    texts = ["".join(words[i::40]) for i in range(40)] + [None, "", "a<|endoftext|>b " + "x" * 300]
    monkeypatch.setattr(bpe, "TOGETHER", 9000)
    c = bpe.Codec(BYTES)
    alone = []
    monkeypatch.setattr(c, "_by_scan", lambda ids: alone.append(ids) or bpe.Codec._by_scan(c, ids))
    assert list(c.encode_all(texts)) == [libraries[0].encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(alone) < len(words) / 5
