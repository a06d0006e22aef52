"""Language identification by multilingual mixture inference.

Every language has a table of letter n-gram log-likelihoods. A document is a mixture: each of its words
is drawn from one language, and expectation-maximisation over the words' likelihoods estimates the
proportions, until none moves by more than ``TOLERANCE``. The set of languages is chosen by penalised likelihood: the
languages are ordered by their proportion in the full mixture, the leading sets are fitted one after another, and the set
with the highest log-likelihood less half a log of the number of words for every language wins. No set can fit better
than the full mixture, so larger ones are left unfitted as soon as their penalty alone rules them out.

The tables are counted over at most ``sample`` distinct whole texts, those with the smallest hashes, of those the
caller lets teach; a text with several languages counts for the first by name. Null texts and texts without a letter
get the language ``und`` and score 0; so does everything if nothing could be learnt. Of languages with equal
proportions the first by name leads. Rows are independent of one another: repeated rows are answered alike, an empty
table gives an empty one. Very long texts are read in blocks of ``BLOCK`` characters; equal words are then counted
instead of kept, which is all that the fit needs to know of them. Other columns, whatever their names, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm._arrow import column, columns, slices

BITS = 16
#: Distinct texts counted for the tables, at most.
SAMPLE = 12_000
#: Steps of one fit, at most, and the largest change of a proportion that ends it.
ROUNDS = 30
TOLERANCE = 1e-3
#: Characters of a text that are looked at at once.
BLOCK = 1 << 20
SMOOTHING = 0.25
#: Log-likelihood that a word has under any language at least, against its best one: e^-80 is a normal number of 32 bits.
FLOOR = np.float32(-80)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table places of the letter trigrams, the first trigram of every word, and every word's document.

    A word is a run of letters; each of its letters gives the trigram it stands in the middle of, with
    anything that is not a letter seen as one and the same blank.
    """
    joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
    codes = np.frombuffer(f"\0{joined}\0".encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = letters()[codes]
    doc = np.cumsum(codes == 0) - 1
    blank = np.where(letter, codes, np.uint32(32))
    a, b, c = blank[:-2], blank[1:-1], blank[2:]
    x = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77) + (b >> np.uint32(3))) ^ (c * np.uint32(0xC2B2AE3D))
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    middle = letter[1:-1]
    place = (x >> np.uint32(32 - BITS))[middle]
    starts = middle & ~letter[:-2]
    first = np.cumsum(middle)[starts] - 1
    return place.astype(np.int64), first, doc[1:-1][starts]


def pieces(texts: list[str]) -> Iterator[list[str]]:
    """The texts, very long ones cut into blocks between words (a longer run of letters is cut within)."""
    short = [t for t in texts if len(t) <= BLOCK]
    if short:
        yield short
    for t in texts:
        at = 0
        while len(t) > BLOCK and at < len(t):
            end = min(at + BLOCK, len(t))
            while at + BLOCK // 2 < end < len(t) and t[end].isalpha():
                end -= 1
            yield [t[at:end]]
            at = end


@dataclass(frozen=True)
class Model:
    languages: list[str]
    tables: np.ndarray  # places x languages, log-likelihoods


def fit(docs: DataFrame, teaches: Column, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Count the tables over those documents for which ``teaches`` holds and whose language is known."""
    known = columns(docs.where(teaches), text=text_col, lang=lang_col).where("lang is not null and text is not null").withColumn("turn", F.xxhash64("text"))
    # Bounded by the parameter, not by the table, so the drawn names can be sent everywhere.
    drawn = known.groupBy("turn").agg(F.min("lang").alias("lang")).orderBy("turn").limit(sample)
    drawn = known.select("turn", "text").join(F.broadcast(drawn), "turn").groupBy("turn", "lang").agg(F.max("text").alias("text")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for part in slices(batches, "text", 1 << 20):
            langs = np.array(part.column(1).to_pylist(), dtype=object)
            texts = part.column(0).to_pylist()
            for lang in sorted(set(langs)):
                for piece in pieces([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    found[lang] = found.get(lang, 0) + np.bincount(grams(piece)[0], minlength=1 << BITS)
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "at", "n"])

    # Bounded: at most 2**BITS places for each language.
    counts = drawn.repartition(8).mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["lang"]))
    if not languages:
        return None
    tables = np.full((1 << BITS, len(languages)), SMOOTHING)
    tables[counts["at"], counts["lang"].map(languages.index)] += counts["n"]
    return Model(languages, np.log(tables / tables.sum(0)).astype(np.float32))


def words_of(text: str, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of a very long text's distinct words (as far as the tables tell them apart), and how often each occurs."""
    rows, times = np.empty((0, tables.shape[1]), dtype=np.float32), np.empty(0, dtype=np.int64)
    for piece in pieces([text]):
        place, first, _ = grams(piece)
        if len(first):
            own = np.add.reduceat(tables[place], first, axis=0)
            rows, at = np.unique(np.concatenate([rows, own]), axis=0, return_inverse=True)
            times = np.bincount(at.reshape(-1), weights=np.concatenate([times, np.ones(len(own), dtype=np.int64)])).astype(np.int64)
    return rows, times


def infer(likely: np.ndarray, docs: np.ndarray, n_docs: int, penalty: float = 0.5, times: np.ndarray | None = None) -> np.ndarray:
    """Proportions (documents x languages) of the chosen language sets.

    ``likely`` has each word's log-likelihood under every language, ``docs`` its document, in order, ``times`` how often
    it occurs (once, if not given).
    """
    n_langs = likely.shape[1]
    out = np.zeros((n_docs, n_langs), dtype=np.float64)
    if not len(docs):
        return out
    here, first = np.unique(docs, return_index=True)
    sizes = np.diff(np.append(first, len(docs)))
    weight = None if times is None else times.astype(np.float32)[:, None]
    words = sizes if times is None else np.add.reduceat(times, first)
    top = likely.max(1)
    # Floored: a set without a word's own language still gives it some likelihood, so that no total is 0.
    ratio = np.exp(np.maximum(likely - top[:, None], FLOOR))
    base = np.add.reduceat(top.astype(np.float64) if times is None else top.astype(np.float64) * times, first)

    def em(start: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fitted proportions and log-likelihood of the documents ``among``, from ``start``; languages at 0 stay out."""
        w, fit = start.copy(), np.empty(len(among))
        live = np.arange(len(among))
        for step in range(ROUNDS):
            # The words of the documents that still move, laid out afresh when half of them have settled.
            if step == 0 or len(live) * 2 <= len(known):
                known = live
                rows = np.concatenate([np.arange(first[d], first[d] + sizes[d]) for d in among[known]]) if len(known) < len(here) else slice(None)
                r, own, n = ratio[rows], np.repeat(np.arange(len(known)), sizes[among[known]]), words[among[known]]
                t = None if weight is None else weight[rows]
                begin = np.concatenate(([0], np.cumsum(sizes[among[known]])[:-1]))
            mixed = r * w[known][own]
            total = mixed.sum(1, keepdims=True)
            fit[known] = np.add.reduceat(np.log(total[:, 0].astype(np.float64)) * (1 if t is None else t[:, 0]), begin)
            mixed /= total
            new = np.add.reduceat(mixed if t is None else mixed * t, begin, axis=0) / n[:, None].astype(np.float32)
            new = np.maximum(new, np.float32(1e-30)) * (start[known] > 0)
            moved = np.abs(new - w[known]).max(1) > TOLERANCE
            w[known] = new
            live = known[moved]
            if not len(live):
                break
        return w, fit + base[among]

    full, most = em(np.full((len(here), n_langs), 1 / n_langs, dtype=np.float32), np.arange(len(here)))
    order = np.argsort(-full, axis=1, kind="stable")
    best, chosen = np.full(len(here), -np.inf), np.zeros_like(full)
    price = penalty * np.log(words + 1)
    for k in range(1, n_langs + 1):
        open_ = np.flatnonzero(best < most - k * price + 1e-6 * np.abs(most))
        if k == 1:
            open_ = np.arange(len(here))
        if not len(open_):
            break
        start = np.zeros((len(open_), n_langs), dtype=np.float32)
        np.put_along_axis(start, order[open_, :k], np.maximum(np.take_along_axis(full[open_], order[open_, :k], axis=1), np.float32(1e-6)), axis=1)
        start /= start.sum(1, keepdims=True)
        w, fit = em(start, open_)
        value = fit - k * price[open_]
        better = value > best[open_]
        best[open_[better]] = value[better]
        chosen[open_[better]] = w[better]
    out[here] = chosen / chosen.sum(1, keepdims=True)
    return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score (its proportion) and languages (map of the chosen set) of every row."""
    frame = columns(docs, id=id_col, text=text_col)
    kind = dict(frame.dtypes)["id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, "text"):
            n = part.num_rows
            langs, scores, sets = [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)]
            if own is not None:
                texts = [t or "" for t in part.column(1).to_pylist()]
                if n == 1 and len(texts[0]) > BLOCK:
                    likely, times = words_of(texts[0], own.tables)
                    doc = np.zeros(len(likely), dtype=np.int64)
                else:
                    place, first, doc = grams(texts)
                    likely, times = np.add.reduceat(own.tables[place], first, axis=0) if len(first) else np.empty((0, len(own.languages))), None
                if len(likely):
                    share = infer(likely, doc, n, times=times)
                    lead = share.argmax(1)
                    for i in np.flatnonzero(share.sum(1) > 0):
                        langs[i], scores[i] = own.languages[lead[i]], min(1.0, float(share[i, lead[i]]))
                        sets[i] = [(own.languages[k], float(share[i, k])) for k in np.flatnonzero(share[i] > 0)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))],
                names=["id", "lang_pred", "score", "languages"],
            )

    return frame.mapInArrow(run, f"id {kind}, lang_pred string, score double, languages map<string,double>").withColumnRenamed("id", id_col)
