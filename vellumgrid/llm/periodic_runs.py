"""Periodic run detection over words, by suffix automata with merged end-position sets.

A run is a stretch of consecutive words with smallest period q, of at least ``least`` words and ``exponent`` * q words, that
no neighbouring word extends keeping the period. For each stretch of a text that can hold one:

1. A suffix automaton is built over its words. Every state stands for the substrings that end at the same places.
2. From the longest states to the shortest, each state's ordered set of end positions is merged into its suffix link's, the
   smaller into the larger. Two positions that become neighbours there share as many last words as the link's state has;
   if their distance d is not more than that, the words before them are a square of period d.
3. A square is extended both ways as long as words d apart are equal. Of one stretch found with several periods the
   smallest is its own. (Words one smallest period apart within a run are neighbours in the set where they meet, or the period
   were not the smallest; so no run is missed.)

Which stretches: in a run every ``_gram_size`` consecutive words recur within it, so a gram that occurs once in a stretch
splits it. Grams are counted by hash for all texts of a batch at once, ``ROUNDS`` times; equal hashes of different grams only leave a
stretch longer. What the automaton compares are the words themselves.

Null and blank texts have no words and no runs. Ids are only passed on: null ids, ids that repeat and repeated rows are answered
row by row, so there are no ties between rows; of a row's runs the longest is the one that starts first, then that of the smallest period. An empty
table gives an empty one. A text of any length that a task holds is worked on whole: time grows as n log² n, and positions are kept
in blocks. Other columns, whatever their names, are dropped unless asked for.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm._arrow import columns, slices
from vellumgrid.llm._words import SPACE, U, buffers, gram_hashes, mix, span_hashes, spans

LEAST = 6
EXPONENT = 4
#: Times that stretches are split before the automata read them.
ROUNDS = 4
#: End positions in a block of an ordered set; a block of twice as many is halved.
BLOCK = 1024

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_KINDS = (~SPACE).astype(np.uint8)


class Ends:
    """An ordered set of positions, in blocks, so that inserting moves at most a block."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, position: int):
        self.blocks, self.tops, self.size = [[position]], [position], 1

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, position: int) -> tuple[int | None, int | None]:
        """Put in a new position; its neighbours below and above."""
        blocks, tops = self.blocks, self.tops
        self.size += 1
        b = bisect_left(tops, position)
        if b == len(tops):
            block = blocks[-1]
            below, above = block[-1], None
            block.append(position)
            tops[-1] = position
            b -= 1
        else:
            block = blocks[b]
            i = bisect_left(block, position)
            above = block[i]
            below = block[i - 1] if i else (tops[b - 1] if b else None)
            block.insert(i, position)
        if len(block) >= 2 * BLOCK:
            blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]
            tops[b : b + 1] = [block[BLOCK - 1], block[-1]]
        return below, above


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of a word sequence: length, suffix link and own end position (-1: a clone) of every state; 0 is the root."""
    length, link, end, after = [0], [-1], [-1], [{}]
    last = 0
    for i, word in enumerate(words):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        after.append({})
        p = last
        while p != -1 and word not in after[p]:
            after[p][word] = new
            p = link[p]
        if p != -1:
            q = after[p][word]
            if length[p] + 1 != length[q]:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                after.append(after[q].copy())
                link[q] = clone
                while p != -1 and after[p].get(word) == q:
                    after[p][word] = clone
                    p = link[p]
                q = clone
            link[new] = q
        last = new
    return length, link, end


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(last word, period) of squares, among them one within every run; a square may come more than once."""
    length, link, end = automaton(words)
    ends: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        to = link[state]
        if to <= 0:  # what meets at the root shares no word
            continue
        small, large, reach = ends[state], ends[to], length[to]
        ends[state] = None
        if large is None:
            ends[to] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        for e in small:
            below, above = large.add(e)
            if below is not None and e - below <= reach:
                yield e, e - below
            if above is not None and above - e <= reach:
                yield above, above - e
        ends[to] = large


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries are equal."""
    done, step = 0, 16
    while done < len(a):
        differ = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 2
    return len(a)


def runs(words: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a word sequence, by start, then period."""
    array = np.array(words, dtype=np.int64)
    back = array[::-1]
    n = len(array)
    known: dict[int, list[tuple[int, int]]] = {}
    period: dict[tuple[int, int], int] = {}
    for e, d in squares(words):
        found = known.setdefault(d, [])
        at = bisect_right(found, (e - 2 * d + 1, n)) - 1
        if at >= 0 and found[at][1] > e:
            continue
        start = e - 2 * d + 1 - _reach(back[n - (e - 2 * d + 1) :], back[n - (e - d + 1) :][: e - 2 * d + 1])
        stop = e + 1 + _reach(array[e + 1 :], array[e + 1 - d : n - d])
        insort(found, (start, stop))
        if stop - start >= max(least, exponent * d):
            period[start, stop] = min(d, period.get((start, stop), d))
    return sorted((start, stop - start, q) for (start, stop), q in period.items())


@lru_cache
def _gram_size(least: int, exponent: int) -> int:
    """Most words of a gram such that each in a run has an equal one a period away within it."""
    return max(1, min(8, *(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 2))))


def stretches(words: np.ndarray, first: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Word ranges, each within one document, outside which no word is in a run. ``words``: hashes, ``first``: each document's first word."""
    size = _gram_size(least, exponent)
    grams = gram_hashes(words, size)
    sizes = np.maximum(np.diff(first) - size + 1, 0)
    before = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(before[-1]) + np.repeat(first[:-1] - before[:-1], sizes)
    stretch = np.repeat(np.arange(len(sizes)), sizes)
    for _ in range(ROUNDS):
        if not len(at):
            break
        _, same, count = np.unique(mix(grams[at] ^ mix(stretch.astype(U) + U(1))), return_inverse=True, return_counts=True)
        recurs = count[same.reshape(-1)] > 1
        at, stretch = at[recurs], stretch[recurs]
        cut = np.ones(len(at), dtype=bool)
        cut[1:] = (np.diff(at) != 1) | (np.diff(stretch) != 0)
        stretch = np.cumsum(cut) - 1
        enough = np.bincount(stretch)[stretch] >= least - size + 1 if len(at) else cut
        at, stretch = at[enough], stretch[enough]
    if not len(at):
        return []
    begins = np.flatnonzero(np.concatenate(([True], np.diff(stretch) != 0)))
    return list(zip(at[begins].tolist(), (at[np.append(begins[1:] - 1, len(at) - 1)] + size).tolist(), strict=True))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run contains after its first period."""
    if not found:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, q in found:
        kept[start + q : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, keep_cols: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, runs (by start, then period) and collapsed (the text without repeated periods) of every row, with ``keep_cols``."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    extra = {f"keep{i}": name for i, name in enumerate(keep_cols)}
    base = columns(docs, id=id_col, text=text_col, **extra)
    kinds = dict(base.dtypes)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = buffers(part.column(1))
            starts, ends, first = spans(data, offsets, _KINDS)
            parts: dict[int, list[tuple[int, int]]] = {}
            for a, b in stretches(span_hashes(data, starts, ends), first, least, exponent):
                doc = int(np.searchsorted(first, a, side="right")) - 1
                parts.setdefault(doc, []).append((a - int(first[doc]), b - int(first[doc])))
            all_runs, texts = [], []
            for doc in range(part.num_rows):
                words = data[offsets[doc] : offsets[doc + 1]].tobytes().split()
                found = []
                for a, b in parts.get(doc, ()):
                    names: dict[bytes, int] = {}
                    found += [(a + s, n, q) for s, n, q in runs([names.setdefault(w, len(names)) for w in words[a:b]], least, exponent)]
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(collapse(words, found).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(part.column(2 + i) for i in range(len(extra))), pa.array(np.diff(first), pa.int64()), pa.array(all_runs, run_type), pa.array(texts, pa.string())],
                names=["id", *extra, "n_words", "runs", "collapsed"],
            )

    out = base.mapInArrow(read, ", ".join([f"id {kinds['id']}", *(f"{x} {kinds[x]}" for x in extra), f"n_words long, runs array<{RUN}>, collapsed string"]))
    return out.select(F.col("id").alias(id_col), *(F.col(a).alias(n) for a, n in extra.items()), "n_words", "runs", "collapsed")


def longest(found: Column) -> Column:
    """The longest of a row's runs (start, length, period); null if there is none."""
    return F.element_at(F.array_sort(F.transform(found, lambda r: F.struct((-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.when(F.size(found) > 0, F.lit(1)))
