"""Token counts and byte-level pair encoding against brute force and the public library."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagetide.llm import bpe
from pagetide.llm.token_counts import Automaton, token_counts

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def greedy(word, pieces, longest=50):
    n = i = 0
    while i < len(word):
        j = min(len(word), i + longest)
        while j > i and word[i:j] not in pieces:
            j -= 1
        if j == i:
            return 1
        n, i = n + 1, j
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12), st.text("abc", max_size=14))
def test_automaton_counts_like_greedy_longest_match(pieces, word):
    word = word.encode()
    assert Automaton(pieces).count(word) == (greedy(word, pieces) if word else 0)


def test_token_counts_of_odd_rows(frame, odd, empty):
    pieces = set(bpe.read_ranks(RANKS))
    assert max(map(len, pieces)) <= 50
    got = sorted(((r["doc_id"], r["n_words"], r["n_tokens"], r["n_bytes"]) for r in token_counts(frame(odd), RANKS).collect()), key=repr)
    want = []
    for i, text in odd:
        words = (text or "").encode().split()
        want.append((i, len(words), sum(greedy(b" " + w, pieces) for w in words), len((text or "").encode())))
    assert got == sorted(want, key=repr)
    assert token_counts(empty, RANKS).count() == 0


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(frame, odd, empty, library):
    texts = [*odd, (20, "  two  blanks  \r\n\n it's 12³ don't!!! <|endoftext|>"), (21, "é ا ب 한국어 \U0001f468‍\U0001f469")]
    rows = bpe.bpe_round_trip(frame(texts), RANKS, P.PATTERN).collect()
    got = sorted(((r["doc_id"], hashlib.sha256(r["ids"]).hexdigest(), bytes(r["data"])) for r in rows), key=repr)
    want = [(i, hashlib.sha256(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), (t or "").encode()) for i, t in texts]
    assert got == sorted(want, key=repr)
    assert bpe.bpe_round_trip(empty, RANKS, P.PATTERN).count() == 0


def test_both_roads_merge_alike(spark, library):
    ranks = bpe.read_ranks(RANKS)
    words = [b" the", b"unbelievable", "größer".encode(), b"aaaaaaaaaa", b"q", " Straße".encode(), b"\xff\xfe", b"indivisibility's"]
    folded = {bytes(r["word"]): r["ids"] for r in bpe.encoded_words(spark.createDataFrame([(w,) for w in words], "word binary"), ranks).collect()}
    for w in words:
        assert folded[w] == bpe.merged_ids(w, ranks)
    assert bpe.merged_ids(b" the", ranks) == library.encode_ordinary(" the")


def test_an_id_without_a_piece_is_an_error(spark):
    bad = spark.createDataFrame([(1, np.array([10**6], "<u4").tobytes())], "doc_id long, ids binary")
    with pytest.raises(Exception, match="no rank"):
        bpe.bpe_decode(bad, RANKS).collect()
