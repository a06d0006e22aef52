"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list; a heap holds the rank and place of every adjacent
pair that some merge rule joins. The lowest rank is popped until none is left. No identifier is
emitted: the count is the number of initial symbols minus the number of merges.

Null text counts as empty: 0 bytes, 0 tokens. Every row is answered on its own, so repeated rows,
null ids and empty tables need no special case. Of pairs with equal rank the leftmost is merged first, so there are no other
ties. A text of any length is counted word by word. Other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vellumgrid.llm._arrow import columns, slices

#: Words whose counts a Python worker keeps; the table is emptied when full, so memory is bounded.
CACHE_WORDS = 200_000
#: Longer words are counted each time they occur.
CACHE_CHARS = 64


def byte_symbols() -> list[str]:
    """The printable stand-in for every byte, by the rule of byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the others take code points from 256 on.
    """
    printable = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts tokens as the vocabulary file's own library would, special strings included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rules.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cache: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of one word."""
        data = word.encode()
        n = len(data)
        if n == 1:
            return 1
        inner, rules = self.inner, self.rules
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rule = rules.get((ids[i], ids[i + 1]))
            if rule is not None:
                heap.append((rule[0], i, ids[i], ids[i + 1], rule[1]))
        heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, made = heappop(heap)
            j = after[i]
            # An entry is stale when either symbol has been merged away since it was pushed.
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            merges += 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                rule = rules.get((made, ids[j]))
                if rule is not None:
                    heappush(heap, (rule[0], i, made, ids[j], rule[1]))
            h = before[i]
            if h >= 0:
                rule = rules.get((ids[h], made))
                if rule is not None:
                    heappush(heap, (rule[0], h, ids[h], made, rule[1]))
        return n - merges

    def count(self, text: str) -> int:
        if self.special is not None and "<" in text and self.special.search(text):
            return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if not text.isascii():
            # The library lower-cases character by character, without the final-sigma rule.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        cache, total = self.cache, 0
        for word, times in Counter(self.words.findall(text.lower())).items():
            n = cache.get(word)
            if n is None:
                n = self.merged(word)
                if len(word) <= CACHE_CHARS:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = n
            total += n * times
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    """One counter a worker process and vocabulary file."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file with word ends, present on every executor.
    """
    frame = columns(docs, id=id_col, text=text_col)
    kind = dict(frame.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for part in slices(batches, "text"):
            texts = [t or "" for t in part.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    return frame.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
