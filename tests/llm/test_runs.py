"""Periodic runs against a comparison of every period at every place."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vellumgrid.llm import periodic_runs, queries
from vellumgrid.llm._words import buffers, span_hashes, spans
from tests.llm.conftest import hard_texts, prose

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=6, exponent=4):
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def plain_collapse(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (5, 3), (12, 2)])
def test_runs_of_random_words(least, exponent):
    rng = random.Random(least)
    for _ in range(1500):
        words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 70))]
        if words and rng.random() < 0.6:
            a, p = rng.randrange(len(words)), rng.randint(1, 8)
            words = [words[i if i < a else a + (i - a) % min(p, len(words) - a)] for i in range(len(words))]
        assert periodic_runs.runs(words, least, exponent) == plain_runs(words, least, exponent)


def test_runs_within_runs():
    inner = "a b a b a b a b c".split()
    assert periodic_runs.runs([ord(w) for w in inner * 4]) == plain_runs(inner * 4) and len(plain_runs(inner * 4)) == 5


def test_long_runs_in_blocks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 8)
    rng = random.Random(2)
    for words in ([0] * 3000, [i % 7 for i in range(3000)], [rng.randrange(3) for _ in range(1500)] + [1, 2] * 300):
        assert periodic_runs.runs(words) == plain_runs(words)


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (5, 3)])
def test_every_run_lies_in_a_stretch(least, exponent):
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 50))]
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + words[at : at + rng.randint(1, 4)] * rng.randint(2, 6) + words[at:]))
    data, offsets = buffers(pa.array(texts))
    starts, ends, first = spans(data, offsets, periodic_runs._KINDS)
    found = periodic_runs.stretches(span_hashes(data, starts, ends), first, least, exponent)
    for doc, text in enumerate(texts):
        for s, n, _ in plain_runs(text.split(), least, exponent):
            assert any(a <= first[doc] + s and first[doc] + s + n <= b for a, b in found)
    assert all(np.searchsorted(first, a, side="right") == np.searchsorted(first, b - 1, side="right") for a, b in found)


def test_find_runs_of_hard_texts(spark, hard, none):
    rng = random.Random(6)
    rows = hard_texts() + [(80, "a " * 5), (81, "a " * 6), (82, prose(rng, 5000) + " x y" * 4000), (83, "é b é b é b é b"), (84, "p q " * 4 + "r " * 7 + "p q " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in periodic_runs.find_runs(df).collect()), key=repr)
    expected = []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        found = plain_runs(words) if i != 82 else [(len(words) - 8000, 8000, 2)]
        expected.append((i, len(words), tuple(found), plain_collapse(words, found)))
    assert got == sorted(expected, key=repr)
    assert len(periodic_runs.find_runs(hard, keep_cols=("id", "text.x")).select("doc_id", "id", "`text.x`").collect()) == len(hard_texts())
    assert periodic_runs.find_runs(none).collect() == []


def test_query_equals_plain_version(spark):
    expected = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = plain_runs(words)
        best = min(((-length, s, q) for s, length, q in found), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        own = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        expected.add((r["doc_id"], len(found), *own, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapse(words, found).encode()).hexdigest()))
    got = {tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert got == expected and sum(r[1] > 0 for r in got) > 5
