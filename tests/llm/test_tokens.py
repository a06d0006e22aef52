"""Token counts and byte-level BPE against the vocabularies' own libraries."""

from __future__ import annotations

import base64
import random
from array import array
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from vellumgrid.llm import bpe, token_counts
from tests.llm.conftest import hard_texts

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def odd_texts() -> list[str]:
    rng = random.Random(4)
    letters = "abc ABC'stTlL09\n\t 　éÉΣσİſK中文😀<|endoftext|>\x1c\x85​ñǅß½²٣ \r '''LL're"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(1, 127), rng.randint(0x1F300, 0x1F9FF)])) for _ in range(30)) for _ in range(200)]
    return [*out, "a" * 3000, "ab" * 2000, "<|startoftext|>" * 3, "x<|endoftext|>y", "\n" * 100, "ΑΣ ΣΑΣ"]


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library():
    library, own = Tokenizer.from_file(WORDS), token_counts.MergeCounter(WORDS)
    for text in odd_texts():
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_counts_of_hard_texts(hard, none):
    library = Tokenizer.from_file(WORDS)
    expected = []
    for i, t in hard_texts():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 2048))
    assert Counter(map(tuple, token_counts.count_tokens(hard, WORDS).collect())) == Counter(expected)
    assert token_counts.count_tokens(none, WORDS).collect() == []


def test_full_cache_is_emptied(monkeypatch):
    own = token_counts.MergeCounter(WORDS)
    before = [own.count(t) for t in odd_texts()]
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 3)
    own.cache.clear()
    assert [own.count(t) for t in odd_texts()] == before
    assert len(own.cache) <= 3


def test_identifiers_equal_the_library(encoding):
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in odd_texts():
        ids = own.encode(text)
        assert ids == array("I", encoding.encode_ordinary(text)).tobytes(), repr(text)
        assert own.decode(ids) == text.encode()


def test_every_token_encodes_to_itself():
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    assert all(own.halves[i] != (i, i) for i, t in enumerate(own.tokens) if len(t) > 1)


def test_coding_of_hard_texts(hard, none, encoding):
    expected = [(i, len(encoding.encode_ordinary(t or "")), array("I", encoding.encode_ordinary(t or "")).tobytes(), (t or "").encode()) for i, t in hard_texts()]
    got = bpe.encode(hard, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == Counter(expected)
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN, keep_cols=("lang",)).columns == ["doc_id", "lang", "n_tokens", "ids", "decoded"]
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).collect() == []
