"""Hashes that decide results: no family of strings may collide by construction."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumgrid.llm import substring_dedup
from vellumgrid.llm._words import SPACE, buffers, gram_hashes, span_hashes, spans
from tests.llm.conftest import prose
from tests.llm.test_dedup import found_groups, found_repeats, near_groups, without_repeats


def thue_morse(n: int, flip: bool = False) -> str:
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


def word_hashes(texts: list[str], lower: bool = False) -> np.ndarray:
    data, offsets = buffers(pa.array(texts))
    starts, ends, _ = spans(data, offsets, (~SPACE).astype(np.uint8))
    return span_hashes(data, starts, ends, lower)


@pytest.mark.parametrize("n", [16, 64, 256, 257, 1024, 4096])
def test_thue_morse_words_differ(n):
    a, b = word_hashes([f"{thue_morse(n)} {thue_morse(n, True)}"])
    assert a != b


def test_a_word_has_one_hash_wherever_it_stands():
    rng = random.Random(1)
    words = ["".join(rng.choice("aÄß7-") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 300]))) for _ in range(500)]
    whole = word_hashes([" ".join(words)])
    alone = word_hashes(words)
    assert (whole == alone).all()
    by = {}
    for w, h in zip(words, whole.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    assert word_hashes(["ABC" * 200 + " Ä"], lower=True).tolist() == word_hashes(["abc" * 200 + " Ä"]).tolist()
    # Zero bytes count, too.
    assert len(set(word_hashes(["a", "a\0", "a\0\0", "\0a"]).tolist())) == 4


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13, 50, 64])
def test_grams_differ_by_order(k):
    rng = np.random.default_rng(k)
    words = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    grams = gram_hashes(words, k)
    assert len(grams) == 3001 - k and len(np.unique(grams)) == len(grams)
    if k > 1:
        swapped = words.copy()
        swapped[[10, 11]] = swapped[[11, 10]]
        changed = np.flatnonzero(gram_hashes(swapped, k) != grams)
        assert changed.tolist() == list(range(max(0, 11 - k), 12))


@pytest.mark.parametrize("n", [1024, 4096])
def test_long_words_do_not_pass_for_one_another(spark, n):
    rng = random.Random(n)
    rest = prose(rng, 120)
    rows = [(1, f"{thue_morse(n)} {rest}"), (2, f"{thue_morse(n, True)} {rest}"), (3, " ".join([thue_morse(n)] * 60)), (4, " ".join([thue_morse(n, True)] * 60)), (5, f"{thue_morse(n)} x y z w"), (6, f"{thue_morse(n, True)} x y z w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_repeats(df) == without_repeats(rows)
    assert found_groups(df) == near_groups(rows)


def test_texts_of_one_id_whose_names_agree(spark, monkeypatch):
    """Rows of one id are told apart by 64 bits; only texts that agree in all of them are taken for one."""
    rng = random.Random(5)
    shared = prose(rng, 60)
    rows = [(1, shared), (2, f"{prose(rng, 30)} {shared}"), (2, f"{shared} {prose(rng, 70)}"), (2, shared)]
    assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string")) == without_repeats(rows)


def shared_parts():
    rng = random.Random(9)
    parts = [prose(rng, rng.randint(20, 60)) for _ in range(12)]
    return [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for i in range(60)] + [(99, prose(rng, 300)), (100, "short"), (101, None)]


@pytest.mark.parametrize(("shard_phrases", "part_words"), [(1000, 1 << 20), (7, 1 << 20), (3, 500)])
def test_every_document_streams_through_every_shard(spark, monkeypatch, shard_phrases, part_words):
    """Runs of the automata are counted: documents, copies as well, times shards, however many there are; each is moved once."""
    rows = shared_parts()
    rows += [(200 + i, t) for i, t in rows[::4]] + [(300, rows[-3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real = substring_dedup.dealt

    def spied(documents, recurring, own=shard_phrases, words=part_words):
        seen.append((documents.count(), -(-recurring.count() // shard_phrases), recurring.count(), real(documents, recurring, shard_phrases, part_words)))
        return seen[-1][3]

    monkeypatch.setattr(substring_dedup, "dealt", spied)
    cut = substring_dedup.remove_spans(df, substring_dedup.find_repeats(df))
    assert {(r["doc_id"], r["kept_text"]) for r in cut.collect()} == {(i, kept) for i, _, _, kept in without_repeats(rows)}
    documents, shards, phrases, passing = seen[0]
    assert documents == len(rows)
    assert (shards > 1) == (shard_phrases < 100)
    parts = passing.select("part").distinct().count()
    assert (parts > 1) == (part_words < 1000) and passing.where("shard < 0").count() == documents and passing.where("shard >= 0").agg(F.sum(F.size("phrases"))).first()[0] == phrases * parts
    runs, dealt_shards = spark.sparkContext.accumulator(0), passing.where("shard >= 0").select("shard").distinct().count()

    def counted(batches):
        from vellumgrid.llm import substring_dedup as own

        found = own.occurrences

        def spy(automaton, codes, copy):
            runs.add(1)
            return found(automaton, codes, copy)

        own.occurrences = spy
        try:
            yield from own._stream(batches)
        finally:
            own.occurrences = found

    passing.mapInArrow(counted, "id long, twin long, copy boolean, found array<int>").count()
    assert runs.value == documents * dealt_shards and dealt_shards > shards // 2


def test_occurrences_come_from_the_automaton():
    """What counts is what the automaton is compiled from and finds, not what a document is known to hold."""
    rng = random.Random(3)
    streamed = []

    class Spy:
        def __init__(self, automaton):
            self.automaton = automaton

        def iter(self, text):
            streamed.append(len(text))
            return self.automaton.iter(text)

    words = word_hashes([prose(rng, 300)])
    codes = substring_dedup._codes(words).tobytes()
    phrase = lambda at: int.from_bytes(codes[at : at + substring_dedup.PHRASE], "little", signed=True)
    automaton = substring_dedup.compile_phrases([phrase(12), phrase(250)])
    assert substring_dedup.occurrences(Spy(automaton), codes) == [12, 250] and substring_dedup.occurrences(Spy(automaton), b"") == [] and streamed == [len(words), 0]
    assert not substring_dedup.occurrences(Spy(substring_dedup.compile_phrases([phrase(12) ^ 1])), codes)


def test_copies_are_what_the_automaton_finds(spark, monkeypatch):
    """A copy is removed because all its windows' phrases were found in it: with none of them compiled it stays."""
    rng = random.Random(17)
    text = prose(rng, 140)
    rows = [(1, text), (2, text.replace(" ", "  ")), (3, text), (3, text), (4, prose(rng, 80))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_repeats(df) == without_repeats(rows)
    real = substring_dedup.dealt
    monkeypatch.setattr(substring_dedup, "dealt", lambda documents, recurring, *more: real(documents, recurring.limit(0), *more))
    assert {r["n_removed"] for r in substring_dedup.remove_spans(df, substring_dedup.find_repeats(df)).collect()} == {0}


def test_phrases_of_copies_count_in_copies_only():
    automaton = substring_dedup.compile_phrases([int.from_bytes(b"abcdefgh", "little"), int.from_bytes(b"bcdefghi", "little")], [True, False])
    assert substring_dedup.occurrences(automaton, b"xabcdefghi") == [1] and substring_dedup.occurrences(automaton, b"xabcdefghi", True) == [1, 2]


def test_every_part_is_a_task_of_its_own(spark):
    documents = spark.range(400).selectExpr("id", "id * 7 as twin", "cast(repeat('x', 100) as binary) as codes", "false as copy")
    recurring = spark.range(10).selectExpr("id as phrase", "true as among")
    tasks = substring_dedup.dealt(documents, recurring, part_words=5000).select("part", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == 8 and len({t["part"] for t in tasks}) == len({t["task"] for t in tasks}) == 8


def test_phrases_in_memory_are_bounded(spark, monkeypatch):
    """An automaton holds few of a shard's phrases, those that may stand in its part; rows of phrases are small; what is found stays the same."""
    rng = np.random.default_rng(4)
    codes = [rng.integers(0, 256, 300).astype(np.uint8) for _ in range(30)]
    documents = spark.createDataFrame([(i, i, bytearray(c.tobytes()), i % 2 == 0) for i, c in enumerate(codes)], "id long, twin long, codes binary, copy boolean")
    at = lambda c, j: int.from_bytes(c[j : j + substring_dedup.PHRASE].tobytes(), "little", signed=True)
    held = {at(c, j): (i + j) % 3 > 0 for i, c in enumerate(codes) for j in (0, 100, 292)}
    strange = {int(p): True for p in rng.integers(-(2**63), 2**63 - 1, 5000)}
    recurring = spark.createDataFrame([*held.items(), *strange.items()], "phrase long, among boolean")
    monkeypatch.setattr(substring_dedup, "ROW_PHRASES", 200, raising=False)
    passing = substring_dedup.dealt(documents, recurring, part_words=3000)
    assert passing.agg(F.max(F.size("phrases"))).first()[0] < 500
    monkeypatch.setattr(substring_dedup, "AUTOMATON_PHRASES", 10, raising=False)
    compiled, real = [], substring_dedup.compile_phrases
    monkeypatch.setattr(substring_dedup, "compile_phrases", lambda phrases, among: compiled.append(len(phrases)) or real(phrases, among))
    found = Counter()
    for batch in substring_dedup._stream(iter(passing.toArrow().to_batches(max_chunksize=7))):
        for r in batch.to_pylist():
            found.update((r["id"], place) for place in r["found"])
    assert found == Counter((i, j) for i, c in enumerate(codes) for j in (0, 100, 292) if held[at(c, j)] or i % 2 == 0)
    assert max(compiled) < 200 and sum(compiled) < 400


def test_no_phrase_of_a_part_is_passed_over():
    """Bits are set at every place, over the ends of blocks and documents too."""
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, substring_dedup.BLOCK * 2 + 5).astype(np.uint8)
    bits = np.zeros(1 << (substring_dedup.PART_BITS - 3), dtype=np.uint8)
    substring_dedup.mark(bits, codes[:4])
    assert not bits.any()
    substring_dedup.mark(bits, codes)
    every = np.lib.stride_tricks.sliding_window_view(codes, substring_dedup.PHRASE).copy().view("<i8").reshape(-1)
    assert substring_dedup.may_stand(bits, every).all()
    assert substring_dedup.may_stand(bits, rng.integers(-(2**63), 2**63 - 1, 10_000)).mean() < 0.01
    assert not substring_dedup.may_stand(np.zeros_like(bits), every).any()
