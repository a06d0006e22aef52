"""Order MinHash against a plain loop, and what its likeness says about edits."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from vellumgrid.llm import order_minhash as M
from vellumgrid.llm import queries
from tests.llm.conftest import hard_texts, prose

SF = "/root/testdata/sf0.001"
LOW = (1 << M.PLACE) - 1


def h(*values) -> int:
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_signature(text):
    words = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % M.PIECE, text or "")
    if not words:
        return ()
    seen, elements = {}, []
    for i in range(max(len(words) - M.K, 0) + 1):
        kmer = h(*words[i : i + M.K]) >> M.PLACE
        seen[kmer] = seen.get(kmer, 0) + 1
        elements.append((h((kmer, 8), (seen[kmer], 4)) >> M.PLACE, i))
    own = [e for e, _ in sorted((((e << M.PLACE & (1 << 64) - 1) >> (M.PLACE + 1), i) for e, i in sorted(elements)[: M.SKETCH]), key=lambda x: x[1])]
    bits = M.SKETCH.bit_length()
    out = []
    for p in range(1, M.SIZE + 1):
        picked = sorted(i for _, i in sorted((h((e, 8), (p, 4)) >> bits, i) for i, e in enumerate(own))[:2])
        out.append(h((own[picked[0]], 8), (own[picked[-1]], 8)) & 0xFFFFFFFF)
    return tuple(out)


def alike(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / max(len(a), len(b)) if len(a) == len(b) and a else float(not a and not b)


def print_of(signature):
    return "".join(f"{x:08x}" for x in signature)


def test_signatures_equal_a_plain_loop(spark):
    rng = random.Random(1)
    texts = [t for _, t in hard_texts()] + ["a a a a a a a", "a b a b a b", "x" * 40, "中文字" * 30, " one\ttwo\n", prose(rng, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    got = {r["i"]: tuple(r["s"]) for r in df.select("i", M.signature(F.col("text")).alias("s")).collect()}
    assert got == {i: plain_signature(t) for i, t in enumerate(texts)}


def likeness_of(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return [r[1] for r in df.select("i", M.likeness(M.signature(F.col("a")), M.signature(F.col("b")))).orderBy("i").collect()]


def test_likeness_falls_with_edits_and_with_order(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(400)}" for _ in range(400)]

    def edited(n):
        words = list(base)
        for i in rng.sample(range(len(words)), n):
            words[i] = f"new{rng.random()}"
        return " ".join(words)

    blocks = [base[i : i + 20] for i in range(0, 400, 20)]
    moved = " ".join(w for b in reversed(blocks) for w in b)
    text = " ".join(base)
    halves = " ".join(base[200:] + base[:200])
    few, more, many, backwards, swapped, other, same = likeness_of(spark, [(text, edited(4)), (text, edited(40)), (text, edited(300)), (text, moved), (text, halves), (text, prose(rng, 400)), (text, text)])
    assert same == 1 and few > 0.75 and few > more > many and other == 0 and many < 0.1
    # Reversing twenty blocks keeps nine in ten k-mers (a plain MinHash sees some 0.82), but only pairs within a block keep their order;
    # swapping the halves keeps nearly all k-mers, and the order of half of the pairs.
    assert backwards < 0.2 and 0.25 < swapped < 0.75
    assert likeness_of(spark, [("", None), ("", "a"), ("a", "a b"), ("a  b", "a b")]) == [1, 0, 0, 1]


def neighbours(rows):
    """(id, text, next text) by falling id, nulls last; rows of one id by falling hash of the text."""
    order = sorted(((i is not None, i or 0, h(t or ""), i, t or "") for i, t in rows), reverse=True)
    return sorted(((a[3], a[4], b[4]) for a, b in zip(order, order[1:] + order[:1], strict=True)), key=repr)


@pytest.mark.parametrize("ranges", [M.RANGES, (3, 5, 10), (1, 1, 1), (2000, 5000, 1)])
def test_next_rows(spark, monkeypatch, hard, none, ranges):
    monkeypatch.setattr(M, "RANGES", ranges)
    rows = hard_texts() + [(1000 + i, f"t{i % 7}") for i in range(300)] + [(-5, "below")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    met = M.with_next(df).collect()
    assert sorted(((r["doc_id"], r["text"], r["next_text"]) for r in met), key=repr) == neighbours(rows)
    assert len(M.with_next(hard).collect()) == len(hard_texts())
    assert M.with_next(none).collect() == []
    assert [(r["text"], r["next_text"]) for r in M.with_next(df.where("doc_id = 23")).collect()] == [("one", "one")]


def test_query_equals_plain_version(spark):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    expected = set()
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, third = plain_signature(text), plain_signature(edited), plain_signature(following)
        expected.add((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_of(own), print_of(other), alike(own, other), alike(own, third)))
    query = queries.op13_fingerprints(spark, SF)
    assert {tuple(r) for r in query.collect()} == expected
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
