"""Vectorised words and word hashes over the buffers of an Arrow string column.

Everything works on UTF-8 bytes in place: a byte class table marks where words start and end. A word's
hash absorbs it eight bytes at a time and mixes after each step, its length first; a span of words is
hashed by halves, mixed at every joint. Neither is a sum of powers, so no family of strings (such as
Thue-Morse words under a polynomial modulo 2**64) collides by construction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 18
U = np.uint64
#: Longer words are hashed one by one: few words, many bytes.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: ASCII white space as the contracts have it: a word is a run of anything else.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
#: The low n bytes of eight.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=U)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null is empty."""
    texts = pa.compute.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if offsets is None or n == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one kind (0 is between words), and each document's first run.

    ``kinds`` has a small number for each byte value. Runs never cross from one document to the next.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = kinds[data]
    change = np.empty(n + 1, dtype=bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[offsets] = True
    inside = kind != 0
    starts = np.flatnonzero(change[:n] & inside)
    ends = np.flatnonzero(change[1:] & inside) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans; ``lower`` folds A-Z only."""
    sizes = ends - starts
    out = mix(sizes.astype(U) * U(0x9E3779B97F4A7C15))
    for i in range(0, len(starts), BLOCK):
        s, n, h = starts[i : i + BLOCK], sizes[i : i + BLOCK], out[i : i + BLOCK]
        if not len(s):
            continue
        long = np.flatnonzero(n > LONG_WORD)
        for k in long.tolist():
            word = data[s[k] : s[k] + n[k]]
            h[k] = xxhash.xxh3_64_intdigest((_FOLD[word] if lower else word).tobytes())
        live = np.flatnonzero(n <= LONG_WORD) if len(long) else np.arange(len(s))
        if not len(live):
            continue
        base = int(s[live[0]])
        own = data[base : int((s + n)[live].max())]
        own = np.concatenate((_FOLD[own] if lower else own, np.zeros(8, dtype=np.uint8)))
        lanes = np.ndarray(shape=(len(own) - 7,), dtype="<u8", buffer=own, strides=(1,))
        at = s - base
        done = 0
        while len(live):
            left = n[live] - done
            h[live] = mix((h[live] ^ (lanes[at[live] + done] & _LOW[np.minimum(left, 8)])) * U(0xD1342543DE82EF95))
            done += 8
            live = live[left > 8]
    return out


def gram_hashes(words: np.ndarray, k: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes (len(words) - k + 1 of them), by doubling."""
    n = len(words)
    if n < k:
        return np.empty(0, dtype=U)
    out = np.empty(n - k + 1, dtype=U)
    for i in range(0, n - k + 1, BLOCK):
        power = words[i : i + BLOCK + k - 1]
        m = len(power) - k + 1
        whole, taken, size = None, 0, 1
        while True:
            if k & size:
                part = power[taken : taken + m]
                whole = part if whole is None else mix(whole * U(seed) + part)
                taken += size
            if size * 2 > k:
                break
            power = mix(power[:-size] * U(seed) + power[size:])
            size *= 2
        out[i : i + m] = mix(whole + U(k)) if k == 1 else whole
    return out


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of every ``width`` consecutive values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    place = np.arange(len(values))
    reach = 1
    while reach * 2 <= width:
        left, right = place[: len(place) - reach], place[reach:]
        place = np.where(values[right] < values[left], right, left)
        reach *= 2
    if reach < width:
        left, right = place[:n], place[width - reach : width - reach + n]
        place = np.where(values[right] < values[left], right, left)
    return place[:n]
