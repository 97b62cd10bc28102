import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from pagewright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXT = st.text(st.sampled_from("abz's'tremdlve  \n\t09!.é中١ ʰⅧ😀​\x85"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_same_as_library(reference, texts):
    coder = bpe.coder(PATH)
    got = coder.encode_batch(texts)
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert [coder.decode(i) for i in got] == [t.encode() for t in texts]


def test_long_pieces_and_small_cache(reference):
    coder = bpe.ByteBPE(PATH, cache=10)
    for t in ("a" * 3000, "ab" * 2000 + " !" * 999, "  " * 500, "word " * 50):
        assert coder.encode_batch([t]) == [reference.encode_ordinary(t)]


def test_offsets_point_at_tokens():
    coder = bpe.coder(PATH)
    text = "don't stop, señor"
    ids = coder.encode_batch([text])[0]
    raw = text.encode()
    for at, i in zip(coder.offsets(ids), ids, strict=True):
        assert raw[at : at + len(coder.tokens[i])] == coder.tokens[i]


def test_functions_compose():
    of, compose, after, _ = bpe._machine()
    assert (compose[compose[of[0], of[4]], of[0]] == compose[of[0], compose[of[4], of[0]]]).all() and after.shape[0] == compose.shape[0]


def test_odd_rows(odd_docs, no_docs):
    found = bpe.query(odd_docs).collect()
    assert len(found) == odd_docs.count() and bpe.query(no_docs).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    for r in found:
        if r.doc_id in (3, 4):
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty)
    round_trip = bpe.decode(bpe.encode(odd_docs, PATH), PATH)
    assert sorted(bytes(r.bytes).decode() for r in round_trip.collect()) == sorted(r.text or "" for r in odd_docs.collect())
