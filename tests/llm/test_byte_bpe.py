"""Byte-level BPE against the tiktoken library, round trips and edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetaudit.llm import byte_bpe, queries

TOKENS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
MERGES = byte_bpe.Merges(TOKENS)
SPLITTER = byte_bpe.Splitter(public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=MERGES.rank, special_tokens={})


def ids_of(texts):
    return [row.tolist() for row in byte_bpe.Encoder(MERGES, SPLITTER)(texts)]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text_as_the_library(texts):
    assert ids_of(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_mixed_scripts_and_repeats_as_the_library():
    rnd = random.Random(5)
    bits = ["a", "b", "é", "the", "ing", " ", "  ", "\n", "1", "!", "中", "文", "\u0301", "𝒳", "ß", "я", "\x1c", "'s", "'re", "aaaa", "\u0558", "."]
    texts = ["".join(rnd.choices(bits, k=rnd.randrange(80))) for _ in range(2000)]
    assert ids_of(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_characters_of_newer_unicode_tables():
    texts = [t for c in SPLITTER.newer[::50] for t in (f"{c}'s", f"a{c}1{c}!", f" {c} ")]
    assert ids_of(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5001])
def test_overlapping_pairs(n):
    texts = ["a" * n, "ab" * n, "!" * n, " " * n, "aab" * n]
    assert ids_of(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_tokens_that_rank_before_their_parts():
    """`abc` ranks before `ab`: the pair that a merge makes is merged before the next position of the rank."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bcd", b"ab", b"cd", b"aba"]
    merges = byte_bpe.Merges(tokens)
    library = tiktoken.Encoding("x", pat_str=r"\S+", mergeable_ranks=merges.rank, special_tokens={})
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcd", k=rnd.randrange(1, 14))) for _ in range(3000)]
    ids, counts = merges.replay([w.encode() for w in words])
    got = [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [library.encode_ordinary(w) for w in words]


def test_forgetting_changes_nothing():
    texts = [f"word{k} other{k % 7} " * 5 for k in range(300)]
    encoder = byte_bpe.Encoder(MERGES, SPLITTER, remembered=200)
    got = [row.tolist() for k in range(0, 300, 20) for row in encoder(texts[k:k + 20])]
    assert got == ids_of(texts)


def test_long_text_takes_the_other_way_of_cutting(monkeypatch):
    want = ids_of(["the cat's 12 hats"])
    monkeypatch.setattr(byte_bpe, "LONG", 3)
    assert ids_of(["the cat's 12 hats"]) == want


def check(rows, texts):
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts, strict=True):
        ids = LIBRARY.encode_ordinary(text)
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_query_as_the_library(spark):
    rows = {r["doc_id"]: r for r in queries.op11(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(docs) == len(rows)
    check([rows[d["doc_id"]] for d in docs], [d["text"] or "" for d in docs])


def test_edges(spark):
    data = [(1, None, "x", None), (2, "", "x", None), (3, "Aé " * 60_000, "x", "n"), (None, "tie", None, None), (None, "tie", None, None), (4, "\x00\ufeff\n", "x", "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids string, decoded string").coalesce(1)
    check(byte_bpe.round_trip(docs, TOKENS, public_tokenizers.PATTERN).collect(), [d[1] or "" for d in data])
    empty = byte_bpe.round_trip(docs.limit(0), TOKENS, public_tokenizers.PATTERN)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_encode_then_decode(spark):
    texts = ["naïve café", "", None, "日本語 text\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    coded = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, TOKENS, public_tokenizers.PATTERN), TOKENS).collect()
    assert [bytes(r["decoded"]).decode() for r in coded] == [t or "" for t in texts]
    assert [np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in coded] == [LIBRARY.encode_ordinary(t or "") for t in texts]
    assert byte_bpe.decode_ids(b"", TOKENS) == b""
