"""Token ids against the tokenizer, and sequences against their definition."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetaudit.llm import packing
from fleetaudit.session import work_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = packing.WordEncoder(PATH)


def plain_ids(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n\x0b\x1c\x1f\x85  '.,!|<>*-_0123456789abcdefgistABCéÉßÀσΣςİıŉ́̈ñü中文😀²ªǅ"),
                         st.characters(exclude_categories=("Cs",))), max_size=40))
def test_words_give_the_ids_of_the_text(text):
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == plain_ids(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|startoftext|>b", "It's we'll 's, don't.", "ÀÉ, Straße.", "x" * 5000, "é É", "", "..,,", "a.b,c|"])
def test_special_words(text):
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == plain_ids(text)


def check_places(lengths, room, sequence, offset):
    if not len(lengths):
        return 0
    order = np.lexsort((offset, sequence))
    lengths, sequence, offset = lengths[order], sequence[order], offset[order]
    first = np.append(True, sequence[1:] != sequence[:-1])
    assert (offset[first] == 0).all()
    assert (offset[1:][~first[1:]] == (offset + lengths)[:-1][~first[1:]]).all()
    assert (offset + lengths <= room).all()
    return int(first.sum())


@pytest.mark.parametrize("n", [0, 1, 5, 400, 20_000])
def test_pack_is_tight(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(6.3, 1, n).astype(int), 1, 2048)
    sequence, offset = packing.pack(lengths)
    used = check_places(lengths, 2048, sequence, offset)
    assert used <= 1.02 * lengths.sum() / 2048 + 2 or used <= (lengths > 1024).sum() * 1.02 + 2


@pytest.mark.parametrize("lengths", [[2048] * 7, [1] * 5000, [1025] * 300, [683] * 301, [700, 700, 648] * 100, [513] * 99])
def test_ties(lengths):
    lengths = np.array(lengths)
    used = check_places(lengths, 2048, *packing.pack(lengths))
    assert used <= -(-len(lengths) // (2048 // lengths.max())) + 1


def test_documents(spark):
    rows = [(1, "One two three.", "x"), (2, None, None), (3, "", "x"), (4, "word " * 5000, "y"), (1, "One two three.", "x"),
            (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    got = packing.pack_documents(docs, work_dir(spark), PATH, block=4).toPandas()
    want = []
    for d, t, _ in rows:
        ids = [*plain_ids(t), 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], "<u4")
            want.append((d, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32))
                                             for r in got.itertuples())
    check_places(got["length"].to_numpy(), 2048, got["sequence_id"].to_numpy(), got["offset"].to_numpy())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, work_dir(spark), PATH).count() == 0
