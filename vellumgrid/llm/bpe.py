"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1, so that a pyahocorasick automaton over the vocabulary gives, for every
place of a piece, the longest token that starts there. Encoding walks left to right with the longest
match, accepts a token only if it may stand beside the previous one, and backtracks otherwise; a
place from which no encoding exists is marked and never tried again, which keeps the walk linear.
Two tokens may stand side by side when the merge rules, applied to their joined bytes, would not
cross the boundary; answers are memoised. The result equals that of applying the merges by rank.

Null text is encoded as empty: no tokens. Rows are independent of one another, so repeated rows, null
ids and empty tables need no special case; a text of any length is encoded piece by piece. Ranks differ, so there are no
ties. Other columns, whatever their names, are dropped unless asked for.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm._arrow import columns, slices

#: Pieces whose tokens a Python worker keeps; the table is emptied when full.
CACHE_PIECES = 150_000
#: Longer pieces are encoded each time they occur.
CACHE_CHARS = 48
#: Pairs of tokens whose compatibility is remembered.
CACHE_PAIRS = 150_000


class Codec:
    """Encoder and decoder for a file of ranked byte strings."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f))}
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self.ids: dict[str, int] = {}
        self.longest = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.ids[token.decode("latin-1")] = rank
            self.longest.add_word(token.decode("latin-1"), rank)
        self.longest.make_automaton()
        self.sizes = [len(t) for t in self.tokens]
        self.pieces = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.beside: dict[int, bool] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.tokens))]
        self.shorter: list[int] = [-1] * len(self.tokens)
        for rank, token in enumerate(self.tokens):
            self._learn(rank, token.decode("latin-1"))

    def _learn(self, rank: int, token: str) -> None:
        """Find the last merge that makes a token: the one split whose halves may stand side by side."""
        for cut in range(len(token) - 1, 0, -1):
            left = self.ids.get(token[:cut])
            if left is None:
                continue
            if self.shorter[rank] < 0:
                self.shorter[rank] = left
            right = self.ids.get(token[cut:])
            if right is not None and left < rank and right < rank and self._fits(left, right):
                self.halves[rank] = (left, right)
                self.joined[left, right] = rank
                return

    def _fits(self, left: int, right: int) -> bool:
        """Would the merge rules leave the boundary between these tokens alone?

        Undo the later of the two merges again and again; the boundary is crossed if the tokens that
        meet at it at some moment have a merge of their own that comes before what was undone.
        """
        limit = len(self.tokens)
        halves, joined = self.halves, self.joined
        while True:
            made = joined.get((left, right))
            if made is not None and made < limit:
                return False
            splits_left, splits_right = halves[left][1] != left, halves[right][0] != right
            if not splits_left and not splits_right:
                return True
            # Of equal ranks, the one further left was merged first.
            if splits_left and (left > right or not splits_right):
                limit, left = left, halves[left][1]
            else:
                limit, right = right + 1, halves[right][0]

    def piece(self, piece: str) -> bytes:
        """The identifiers of one piece as little-endian unsigned 32-bit integers."""
        text = piece.encode().decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return whole.to_bytes(4, "little")
        n, sizes, shorter, beside = len(text), self.sizes, self.shorter, self.beside
        best = [-1] * n
        for end, rank in self._matches(text):
            start = end + 1 - sizes[rank]
            if best[start] < 0 or sizes[best[start]] < sizes[rank]:
                best[start] = rank
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, best[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + sizes[token]
                if open_at[end]:
                    if last < 0:
                        break
                    pair = last << 32 | token
                    fits = beside.get(pair)
                    if fits is None:
                        if len(beside) >= CACHE_PAIRS:
                            beside.clear()
                        fits = beside[pair] = self._fits(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = best[at] if at < n else -1
            else:
                open_at[at] = 0
                token = out.pop()
                at -= sizes[token]
        ids = array("I", out)
        return ids.tobytes()

    def _matches(self, text: str) -> Iterator[tuple[int, int]]:
        return self.longest.iter(text)

    def encode(self, text: str) -> bytes:
        cache, out = self.cache, []
        for piece in self.pieces.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= CACHE_CHARS:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process and vocabulary file."""
    return Codec(path, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, keep_cols: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the columns in ``keep_cols``, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of every row.

    ``decoded`` is made from ``ids`` alone. ``vocabulary`` is a rank file present on every executor;
    ``pattern`` splits texts into the pieces that are encoded separately.
    """
    extra = {f"keep{i}": name for i, name in enumerate(keep_cols)}
    frame = columns(docs, text=text_col, id=id_col, **extra)
    passed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for part in slices(batches, "text"):
            ids = [own.encode(t or "") for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())],
                names=[*part.schema.names[1:], "n_tokens", "ids", "decoded"],
            )

    out = frame.mapInArrow(run, f"{passed}, n_tokens long, ids binary, decoded binary")
    return out.select(F.col("id").alias(id_col), *(F.col(a).alias(n) for a, n in extra.items()), "n_tokens", "ids", "decoded")
