"""Operators 1, 8 and 9 against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from loomline.llm import bpe, common, token_counts, token_files, wordbpe

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(WORDS)
UNIGRAM = Tokenizer(models.Unigram(token_counts.vocabulary(PIECES), 0, True))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@given(st.one_of(st.text(max_size=60), st.text("abcdeth ' s.!\n<|endoftext|>", max_size=80)))
@settings(max_examples=300, deadline=None)
def test_same_ids_as_the_library(text):
    text = text.encode(errors="ignore").decode()
    assert wordbpe.load(WORDS).encode(text) == ids_of(text)
    assert wordbpe.load(WORDS, wordbpe.LibraryWords).encode(text) == ids_of(text)


@given(st.text("abcdeth lo▁ \n\té日", max_size=80))
@settings(max_examples=200, deadline=None)
def test_same_counts_as_the_library(text):
    want = len(UNIGRAM.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0
    assert token_counts.load(PIECES).count(text) == want


@given(st.text("abz日 \n▁", max_size=40))
@settings(max_examples=200, deadline=None)
def test_unknown_characters_side_by_side_are_one_without_byte_pieces(text):
    pieces = [("<unk>", 0.0), ("▁", -2.0), ("▁a", -1.0), ("a", -1.5), ("ab", -1.0), ("b", -3.0)]
    for own in (pieces, [p for p in pieces if p[0] != "▁"]):
        library = Tokenizer(models.Unigram(own, 0, False))
        want = len(library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0
        assert token_counts.UnigramCounter(own).count(text) == want


@pytest.mark.parametrize("kind", [wordbpe.WordBpe, wordbpe.LibraryWords])
def test_a_cache_that_starts_anew_changes_nothing(kind):
    small = kind(WORDS, room=4000)
    text = "the quick brown fox jumps over the lazy dog, twice; the end " * 3 + "x" * 500 + " don't stop, İ ³ é!"
    assert small.encode_all([text, "", "fox"])[0].tolist() == ids_of(text)
    assert small.encode(text) == ids_of(text) and len(small.tokens) + len(small.tokens.before) < 30
    assert max(map(len, small.tokens)) <= wordbpe.Memo.LONGEST


@given(st.lists(st.lists(st.integers(0, 49407), max_size=12), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_decoding_by_offsets(lists):
    words, ids = wordbpe.load(WORDS), np.array([i for x in lists for i in x], np.uint16)
    ends = np.cumsum([len(x) for x in lists])
    assert [bytes(x).decode() for x in words.pieces.joined(ids, ends)] == [LIBRARY.decode(x, skip_special_tokens=False) for x in lists]
    assert [bytes(x).decode() for x in words.decimals.joined(ids, ends)] == [" ".join(map(str, x)) for x in lists]


def test_slices_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["aaaa", None, "b" * 30, "", "cc", "d" * 9, "e", "f"])], names=["i", "t"])
    assert [x.column(0).to_pylist() for x in common.slices(batch, 1, 10)] == [[0, 1], [2], [3, 4], [5, 6], [7]]
    assert [x.num_rows for x in common.slices(batch, 1, 1000, 3)] == [3, 3, 2] and not list(common.slices(batch.slice(0, 0), 1))


@pytest.mark.parametrize("counts", [[0, 0, 5], [1, 1], [1] * 300, [2**k for k in range(40)], [0]])
def test_code_lengths(counts):
    lengths = token_files.code_lengths(np.array(counts))
    used = lengths[lengths > 0].astype(float)
    assert (lengths > 0).tolist() == [c > 0 for c in counts] and lengths.max(initial=0) <= token_files.LONGEST
    if len(used) > 1:
        assert (2.0**-used).sum() == 1.0


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000])
def test_pack_and_unpack(n):
    ids = np.random.RandomState(n).geometric(0.05, n).astype(np.uint16)
    lengths = token_files.code_lengths(np.bincount(ids))
    payload, at = token_files.pack(ids, lengths, token_files.canonical(lengths))
    assert (token_files.Table(lengths).unpack(payload, at, n) == ids).all()


def test_digests(spark, odd_docs):
    got = bpe.bpe_round_trip(odd_docs, WORDS).collect()
    want = []
    for r in odd_docs.collect():
        ids = ids_of(r.text)
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.bpe_round_trip(odd_docs.limit(0), WORDS).count() == 0


def test_counts_of_odd_documents(spark, odd_docs):
    got = sorted(map(repr, map(tuple, token_counts.token_counts(odd_docs, PIECES).collect())))
    want = [(r.doc_id, len(UNIGRAM.encode("▁" + r.text.replace(" ", "▁"), add_special_tokens=False).ids) if r.text else 0) for r in odd_docs.collect()]
    assert got == sorted(map(repr, want))


@pytest.mark.parametrize("block", [64, 1 << 18])
def test_token_files(spark, odd_docs, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK", block)
    folder = common.work_dir(spark)
    token_files.write_token_files(odd_docs, WORDS, folder)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    rows = odd_docs.collect()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert sorted(repr((r.doc_id, r.ids)) for r in got) == sorted(repr((r.doc_id, [*ids_of(r.text), 1])) for r in rows)


def test_token_files_of_nothing(spark, odd_docs):
    folder = common.work_dir(spark)
    token_files.write_token_files(odd_docs.limit(0), WORDS, folder)
    assert token_files.read_token_files(spark, folder).count() == 0
