"""Operator 11 against the tiktoken library, its perfect hash, and exact round trips."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import bytebpe
from corvane.llm.bytebpe import RankCodec, RankStrings, decode_ranks, encode_ranks, read_ranks
from corvane.llm.mph import PerfectHash

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "  a  b\n\n c", "<|endoftext|>x <|endoftext|>", "日本語 🙂　x", "a" * 5000, "it's we'll 'S don't''t 12½²", "\x1c x\x85y\xa0z", "Éá ÄÖ ß", "same", "same", "ab" * 40_000 + " long, " * 3000]


def library_of(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


@pytest.fixture(scope="module")
def codecs():
    return RankCodec(PATH, public_tokenizers.PATTERN), RankStrings(PATH), library_of(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_equals_the_library(codecs, texts):
    own, strings, library = codecs
    ids = own.encode_texts(texts)
    assert ids.to_pylist() == [library.encode_ordinary(t) for t in texts]
    assert [b.decode() for b in strings.decode_lists(ids).to_pylist()] == texts


def test_special_texts_blocks_and_bounded_tables(codecs, monkeypatch):
    _, _, library = codecs
    want = [library.encode_ordinary(t or "") for t in TEXTS]
    for block, long_text, entries in ((200_000, 1 << 20, 150_000), (7, 50, 3)):
        for name, value in (("BLOCK", block), ("LONG_TEXT", long_text), ("CACHE_ENTRIES", entries)):
            monkeypatch.setattr(bytebpe, name, value)
        assert RankCodec(PATH).encode_texts(TEXTS).to_pylist() == want


def test_another_vocabulary_and_pattern():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    text = "Größe 東京 x1 l'été\n\nок  "
    assert RankCodec(path).encode(text) == library_of(path).encode_ordinary(text)
    words = tiktoken.Encoding("w", pat_str=r"\w+|\W", mergeable_ranks=read_ranks(PATH), special_tokens={})
    assert RankCodec(PATH, r"\w+|\W").encode("some words-here") == words.encode_ordinary("some words-here")


@settings(max_examples=50, deadline=None)
@given(st.sets(st.binary(max_size=6), max_size=300))
def test_the_hash_is_minimal_and_perfect(keys):
    keys = sorted(keys)
    found = PerfectHash(keys)
    assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))
    assert all(-1 <= s < len(keys) for s in found.slots([b"other", b"strings", b""]))


def test_bad_files(tmp_path):
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash([b"a", b"a"])
    lines = [base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)]
    (tmp_path / "short").write_bytes(b"\n".join(lines[:255]))
    (tmp_path / "again").write_bytes(b"\n".join([*lines, lines[0]]))
    for name, message in (("short", "no rank"), ("again", "repeats")):
        with pytest.raises(ValueError, match=message):
            read_ranks(str(tmp_path / name))


def test_a_table_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string, decoded int")
    rows = decode_ranks(encode_ranks(docs, PATH), PATH).orderBy("doc_id").collect()
    assert [r["decoded"].decode() for r in rows] == [t or "" for t in TEXTS]
    assert rows[0]["ids"] == [] and rows[9]["ids"] == rows[10]["ids"]
    assert encode_ranks(docs.where("false"), PATH).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [64, None, 99_999_999, -1, 65]), (3, [])], "k int, ids array<int>")
    strings = RankStrings(PATH)
    both = strings.strings[64].as_py() + strings.strings[65].as_py()
    assert [bytes(r["decoded"]) for r in decode_ranks(odd, PATH).orderBy("k").collect()] == [b"", both, b""]


def test_query_digests(spark, tmp_path):
    from corvane.llm.q_bytebpe import op11_byte_bpe

    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = library_of(PATH)
    rows = op11_byte_bpe(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
