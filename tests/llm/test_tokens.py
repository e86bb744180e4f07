"""Operators 1 and 9 against the library, and exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm.bpe import BytePairCodec, bpe_decode, bpe_encode, decoded, strings
from corvane.llm.rans import FrequencyTable, WordTokenizer, decode_block, encode_block, read_digests, read_ids, write_ids

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "  a  b\n\n c", "<|endoftext|>x <|endoftext|>", "日本語 🙂", "a" * 3000, "it's we'll 'S don't''t 12½²", "\x1c x\x85y\xa0z", "Éá ÄÖ ß", "same", "same"]


@pytest.fixture(scope="module")
def byte_codec():
    return BytePairCodec(BYTE), Tokenizer.from_file(BYTE)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_and_decoding_equal_the_library(byte_codec, text):
    own, library = byte_codec
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert decoded(ids, strings(BYTE)) == library.decode(ids, skip_special_tokens=False)
    assert decoded(ids[1:], strings(BYTE)) == library.decode(ids[1:], skip_special_tokens=False)


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, sizes int")


def test_bpe_on_a_table_with_clashing_columns(spark):
    rows = bpe_decode(bpe_encode(frame(spark), BYTE), BYTE).orderBy("doc_id").collect()
    assert [r["decoded"] for r in rows] == [t or "" for t in TEXTS]
    assert rows[0]["ids"] == [] and rows[9]["ids"] == rows[10]["ids"] and rows[0]["sizes"] == 1
    assert bpe_encode(frame(spark).where("false"), BYTE).count() == 0


def test_query_digests(spark, tmp_path):
    from corvane.llm.q_bpe import op1_bpe_encode_decode

    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(BYTE)
    for r in op1_bpe_encode_decode(spark, str(tmp_path)).collect():
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_word_tokenizer_equals_the_library(text):
    own = test_word_tokenizer_equals_the_library.own
    got = np.frombuffer(own.encode_batch([text])[0], dtype=own.dtype).tolist()
    assert got == own.library.encode(text, add_special_tokens=False).ids


test_word_tokenizer_equals_the_library.own = WordTokenizer(WORD)


@pytest.mark.parametrize("n", [1, 2, 255, 5000, 300_000])
def test_block_round_trip_checkpoints_and_damage(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49_000).astype(np.int64)
    table = FrequencyTable(np.bincount(ids, minlength=49_408))
    payload = encode_block(ids, table)
    assert (decode_block(payload, table) == ids).all()
    lanes = min(1024, max(1, n // 256))
    assert (decode_block(payload, table, 1, 2) == ids[64 * lanes : 128 * lanes]).all()
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        decode_block(bytes(broken), table)


def test_one_symbol_and_rare_symbols():
    for ids in (np.zeros(1000, dtype=np.int64), np.arange(49_408)):
        table = FrequencyTable(np.bincount(ids, minlength=49_408))
        assert (decode_block(encode_block(ids, table), table) == ids).all()


def test_files_in_document_order(spark, tmp_path):
    rows = spark.createDataFrame([(9, "b"), (2, "a a"), (2, "a b"), (None, "n"), (5, None), (7, "x" * 2000)], "doc_id bigint, text string")
    out, _ = write_ids(rows, WORD, str(tmp_path / "f"))
    got = read_digests(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 2, 2, 5, 7, 9]
    library, start = Tokenizer.from_file(WORD), 0
    for r, text in zip(got, ["n", "a a", "a b", "", "x" * 2000, "b"], strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert {r["start"]: r["ids"][-1] for r in read_ids(spark, out).collect()} == {r["start"]: 1 for r in got}
    out, _ = write_ids(rows.where("false"), WORD, str(tmp_path / "e"))
    assert read_digests(spark, out).count() == 0
