"""Substring and near deduplication against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from vellumgrid.llm import near_dedup, substring_dedup
from vellumgrid.llm._words import gram_hashes, window_argmin
from tests.llm.conftest import hard_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_repeats(rows, window=50):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1) if i is not None else ():
            at = tuple(w[k : k + window])
            first[at] = min(first.get(at, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        cut = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                cut.update(range(k, k + window))
        out.append((i, len(w), len(cut), " ".join(x for k, x in enumerate(w) if k not in cut)))
    return Counter(out)


def found_repeats(df, **kw):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(df, **kw).collect())


def test_repeats_in_hard_texts(hard):
    assert found_repeats(hard) == without_repeats(hard_texts())


def test_repeats_without_broadcast(hard, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", -1)
    monkeypatch.setattr("vellumgrid.llm._tables.BROADCAST_BYTES", -1)
    assert found_repeats(hard) == without_repeats(hard_texts())


@pytest.mark.parametrize("window", [8, 13])
def test_repeats_in_random_texts(spark, window):
    rng = random.Random(window)
    parts = [prose(rng, rng.randint(3, 30)) for _ in range(25)]
    rows = [(i // 2 * 3, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window) == without_repeats(rows, window)


def test_no_rows(none):
    assert found_repeats(none) == Counter()
    assert near_dedup.near_duplicates(none).collect() == []


def test_unchanged_texts_are_kept(hard):
    for r in substring_dedup.remove_repeats(hard).collect():
        assert (r["text"] is None) or r["n_removed"] == 0


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_groups(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            n = len(s & t)
            if i is not None and j is not None and s and t and 100 * n >= percent * (len(s) + len(t) - n):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), top(i) if i is not None else None, i is None or top(i) == i) for i, s in sets)


def found_groups(df, **kw):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, **kw).collect())


def test_near_groups_in_hard_texts(hard):
    assert found_groups(hard) == near_groups(hard_texts())


def test_near_groups_without_broadcast(hard, monkeypatch):
    monkeypatch.setattr("vellumgrid.llm._tables.BROADCAST_BYTES", -1)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    assert found_groups(hard) == near_groups(hard_texts())


def test_sets_of_a_hot_group_are_shipped_once(spark, monkeypatch):
    """Near copies of one text: after the round with their leader nothing is left to compare."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    shipped = []
    real = near_dedup._rest
    monkeypatch.setattr(near_dedup, "_rest", lambda *a: shipped.append(real(*a)) or shipped[-1])
    rng = random.Random(4)
    base = prose(rng, 200).split(" ")
    rows = []
    for i in range(300):
        own = list(base)
        own[rng.randrange(len(own))] = f"edit{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_groups(df) == near_groups(rows)
    assert shipped[0].count() == 0


@pytest.mark.parametrize(("block", "percent"), [(4, 85), (256, 80)])
def test_near_groups_of_many_copies(spark, monkeypatch, block, percent):
    """One group of edited copies, in blocks much smaller than it, and chains whose ends are far apart."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(block)
    base = prose(rng, 160).split(" ")
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = f"edit{rng.randint(0, 9)}"
        rows.append((i, " ".join(own)))
    chain = prose(rng, 150).split(" ")
    for i in range(12):
        rows.append((100 + (i * 7) % 12, " ".join(chain[i * 3 :] + [f"more{k}" for k in range(i * 3)])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_groups(df, percent=percent) == near_groups(rows, percent)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 700)
    assert found_groups(df, percent=percent) == near_groups(rows, percent)


def test_components_of_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450)]
    found = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {450: 400, 500: 400}


def test_long_document_is_hashed_in_blocks():
    sets = np.unique(np.random.default_rng(1).integers(0, 2**63, 600_000, dtype=np.uint64))
    whole = near_dedup.band_keys(sets, np.array([0, len(sets)]))
    twice = near_dedup.band_keys(np.concatenate([sets[:10], sets, sets[:7]]), np.array([0, 10, 10 + len(sets), 17 + len(sets)]))
    assert (whole[0] == twice[1]).all()


def test_gram_hashes_do_not_depend_on_place():
    words = np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64)
    joined = gram_hashes(np.concatenate([words[:77], words]), 9)
    assert (joined[77:] == gram_hashes(words, 9)).all()
    assert gram_hashes(words[:8], 9).size == 0


@pytest.mark.parametrize("width", [1, 2, 3, 43, 64])
def test_window_argmin(width):
    values = np.random.default_rng(width).integers(0, 20, 200).astype(np.uint64)
    assert window_argmin(values, width).tolist() == [i + int(np.argmin(values[i : i + width])) for i in range(200 - width + 1)]
