"""Substring deduplication by repeated-phrase automata.

A window is ``window`` consecutive words. Each window is named by one short phrase inside it, the one
with the smallest hash, so equal windows have equal phrases. The steps:

1. Phrases that recur together with half a window's other words on one side, in two or more different texts, are those of the recurring
   passages (of every repeated window at least that much is the same); those of texts that recur as a whole, word for word (SHA-256),
   are added. They are dealt by hash into shards of about ``shard_phrases``, whose number grows with them.
2. All documents, as codes (a character a word), are dealt once into parts of about ``PART_WORDS`` words, and all shards'
   phrases to every part, in one exchange. A worker holds its part's documents and takes one shard after another: it compiles the shard's
   phrases, but for those that cannot stand in the part, into an Aho-Corasick automaton and streams all of the part's documents through it;
   what that finds, and nothing else, are the phrases' occurrences. What cannot stand there is told by a bit for the hash of every
   eight neighbouring words of the part. Where more than ``AUTOMATON_PHRASES`` are left, a shard takes several automata.
3. The windows named by the occurrences are confirmed. A document of which every window was found, and whose word sequence is that
   of an earlier document, repeats it from end to end. Of all others 128 bits of hash over each window's words are grouped, and
   a word is removed if a window over it also starts in a document with a smaller id.

So documents are streamed as many times as there are shards, whatever they hold, but moved once; a worker's memory is set by
``AUTOMATON_PHRASES`` and ``PART_WORDS``, rows of phrases are bounded by ``ROW_PHRASES``, and the driver only learns counts.

Null texts have no words; an empty text has none either. A null id is neither earlier nor later than
another, so such rows are returned whole. Rows that share an id are not earlier than one another; each is
answered for its own text, rows that share both alike. Of equal windows that of the smallest id stays, so there are
no ties. Empty tables give empty results. Texts may be of any length: they are hashed in blocks, a text is one row and has to
fit into a task. Other columns, whatever their names, are dropped at once unless asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm._arrow import columns, slices
from vellumgrid.llm._tables import BROADCAST_BYTES, keep, small, text_key
from vellumgrid.llm._words import BLOCK, SPACE, U, buffers, gram_hashes, span_hashes, spans, window_argmin

WINDOW = 50
#: Words of a phrase; each is a Latin-1 character of its hash in the automata, and all are one long integer.
PHRASE = 8
SLICE_BYTES = 1 << 20
#: Phrases of a shard. All are read in every part, few are compiled there.
SHARD_PHRASES = 1 << 21
#: Phrases of an automaton: at most about 120 MB in a worker.
AUTOMATON_PHRASES = 1 << 18
#: Phrases of a row (eight bytes each): small, since such rows are gathered, sorted and sent in the JVM.
ROW_PHRASES = 1 << 14
#: Words (bytes of codes) of a part, which a worker holds and which is a task: small enough that tasks outnumber cores, large enough that
#: the phrases, which go to every part, stay a fraction of the documents.
PART_WORDS = 16 << 20
#: Bits that tell what stands in a part, as a power of two: 32 MB, a sixteenth of them set by ``PART_WORDS`` different phrases.
PART_BITS = 28
#: Mixed into the second half of a window's 128 bits.
SECOND = 0xA24BAED4963EE407

PHRASES = "array<bigint>"

_KINDS = (~SPACE).astype(np.uint8)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = buffers(texts)
    starts, ends, first = spans(data, offsets, _KINDS)
    return data, offsets, span_hashes(data, starts, ends), first


def _windows(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the place of each one's phrase, and each document's first window."""
    sizes = np.maximum(np.diff(first) - window + 1, 0)
    before = np.concatenate(([0], np.cumsum(sizes)))
    starts = np.arange(before[-1]) + np.repeat(first[:-1] - before[:-1], sizes)
    place = window_argmin(gram_hashes(words, PHRASE), window - PHRASE + 1)
    return starts, place[starts] if len(starts) else starts, before


def _codes(words: np.ndarray) -> np.ndarray:
    return (words >> U(56)).astype(np.uint8)


def _read(window: int):
    """What later steps need of every document: its words as codes, and its phrases (code, and hash with either context)."""
    half = PHRASE + (window - PHRASE + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            data, offsets, words, first = _words(part.column(2))
            place = np.unique(_windows(words, first, window)[1])
            codes = _codes(words)
            doc = np.searchsorted(first[1:], place, side="right")
            phrase = np.ascontiguousarray(codes[place[:, None] + np.arange(PHRASE)]).view("<i8").reshape(-1) if len(place) else np.empty(0, np.int64)
            spans_ = gram_hashes(words, half)
            left = place + PHRASE - half
            sides = ((place, place + half <= first[doc + 1], U(0)), (left, left >= first[doc], U(SECOND)))
            at = np.concatenate([start[ok] for start, ok, _ in sides])
            mark = np.concatenate([np.full(int(ok.sum()), m) for _, ok, m in sides])
            own = np.concatenate([doc[ok] for _, ok, _ in sides])
            named = np.concatenate([phrase[ok] for _, ok, _ in sides])
            order = np.argsort(own, kind="stable")
            lists = pa.array(np.searchsorted(own[order], np.arange(len(first))), pa.int32())
            context = (spans_[at[order]] ^ mark[order]).view(np.int64) if len(at) else np.empty(0, np.int64)
            sha = [hashlib.sha256(b" ".join(data[i:j].tobytes().split())).digest() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            coded = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(first), pa.int64()), pa.array(sha, pa.binary()), coded, pa.ListArray.from_arrays(lists, pa.array(named[order], pa.int64())), pa.ListArray.from_arrays(lists, pa.array(context, pa.int64()))],
                names=["id", "twin", "n_words", "words_sha", "codes", "phrase", "context"],
            )

    return run


def compile_phrases(phrases: list[int], among: list[bool] | None = None) -> ahocorasick.Automaton:
    """An automaton of the phrases, each marked as one that recurs among different texts (all, unless said) or only in copies of one."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p, mark in zip(phrases, among or [True] * len(phrases), strict=True):
        automaton.add_word(p.to_bytes(PHRASE, "little", signed=True).decode("latin-1"), int(mark))
    automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton, codes: bytes, copy: bool = False) -> list[int]:
    """The words of a document at which a phrase of the automaton starts; those that recur only in copies count in copies only."""
    return [end - PHRASE + 1 for end, among in automaton.iter(codes.decode("latin-1")) if among or copy]


def _bit(phrases: np.ndarray) -> np.ndarray:
    return (phrases.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - PART_BITS)


def mark(bits: np.ndarray, codes: np.ndarray) -> None:
    """Set the bit of every phrase that stands in the codes (documents one after another: also where one goes over into the next)."""
    for i in range(0, len(codes) - PHRASE + 1, BLOCK):
        own = codes[i : i + BLOCK + PHRASE - 1]
        bit = np.sort(_bit(np.ndarray(shape=(len(own) - PHRASE + 1,), dtype="<i8", buffer=own, strides=(1,)).copy()))
        byte = (bit >> U(3)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        bits[byte[starts]] |= np.bitwise_or.reduceat(U(1) << (bit & U(7)), starts).astype(np.uint8)


def may_stand(bits: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """Whether each phrase may stand in the codes that were marked: never False of one that does."""
    bit = _bit(phrases)
    return (bits[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & 1 == 1


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts, one after another: first their documents, as codes, which are held, then their phrases, shard by shard."""
    part, shard, held, bits, phrases, among = None, None, [], None, [], []

    def found() -> Iterator[pa.RecordBatch]:
        if phrases and held:
            automaton = compile_phrases(phrases, among)
            for documents in held:
                rows = zip(documents.column(2), documents.column(3).to_pylist(), strict=True)
                places = pa.array([occurrences(automaton, c.as_buffer().to_pybytes(), copy) for c, copy in rows], pa.list_(pa.int32()))
                some = pa.compute.greater(pa.compute.list_value_length(places), 0)
                yield pa.RecordBatch.from_arrays([documents.column(i) for i in (0, 1, 3)] + [places], names=["id", "twin", "copy", "found"]).filter(some)

    for batch in slices(batches, "codes", SLICE_BYTES):
        where = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        cuts = np.flatnonzero(np.concatenate(([True], (np.diff(where, axis=0) != 0).any(1)))).tolist()
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            own, number = where[a].tolist()
            begins = (own, number) != (part, shard)
            if begins:
                yield from found()
                phrases, among = [], []
                if own != part:
                    held, bits = [], np.zeros(1 << (PART_BITS - 3), dtype=np.uint8)
                part, shard = own, number
            if number < 0:
                held.append(pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[2:6]], names=["id", "twin", "codes", "copy"]))
                mark(bits, buffers(held[-1].column(2))[0])
                continue
            for i in range(a, b):
                row = batch.column(6).slice(i, 1).flatten().to_numpy()
                ok = may_stand(bits, row)
                # A shard of which nothing may stand here is streamed like any other.
                ok[:1] |= begins and i == a
                phrases += row[ok].tolist()
                among += [not batch.column(5)[i].as_py()] * (len(phrases) - len(among))
                if len(phrases) >= AUTOMATON_PHRASES:
                    yield from found()
                    phrases, among = [], []
    yield from found()


def dealt(documents: DataFrame, recurring: DataFrame, shard_phrases: int = SHARD_PHRASES, part_words: int = PART_WORDS) -> DataFrame:
    """Every document (id, twin, codes, copy) in its part, and all phrases (phrase, among), shard by shard, in every part: part, shard, id, twin, codes, copy, phrases, in order.

    A document's row has shard -1 and stands before the part's phrases, which have no codes. A shard has about ``shard_phrases``, in rows of about
    ``ROW_PHRASES``; ``copy`` tells the rows whose phrases recur only in copies.
    """
    n_phrases = recurring.count()
    shards = max(1, -(-n_phrases // shard_phrases))
    rows = max(1, -(-min(n_phrases, shard_phrases) // ROW_PHRASES))
    words = documents.agg(F.coalesce(F.sum(F.octet_length("codes")), F.lit(0))).first()[0]
    parts = max(1, -(-words // part_words))
    names = ("part", "shard", "id", "twin", "codes", "copy", "phrases")
    own = documents.withColumns({"part": F.pmod(F.xxhash64("id", "twin"), F.lit(parts)).cast("int"), "shard": F.lit(-1), "phrases": F.lit(None).cast(PHRASES)}).select(*names)
    dealt_to = lambda n, *salt: F.pmod(F.xxhash64("phrase", *salt), F.lit(n)).cast("int")
    grouped = recurring.groupBy(dealt_to(shards).alias("shard"), dealt_to(rows, F.lit(1)).alias("row"), (~F.col("among")).alias("copy")).agg(F.collect_list("phrase").alias("phrases"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    theirs = grouped.select(every.alias("part"), "shard", *[F.lit(None).cast(kind).alias(c) for c, kind in documents.dtypes if c != "copy"], "copy", "phrases").select(*names)
    # By the part's own number: by its hash, some tasks would get several parts and others none.
    return own.unionByName(theirs).repartitionById(parts, "part").sortWithinPartitions("part", "shard")


def _locate(window: int):
    """The windows (start and 128 bits of hash) whose phrase stands at one of the places found; of a copy that they cover whole, its length alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            _, _, words, first = _words(part.column(2))
            starts, place, before = _windows(words, first, window)
            found = np.zeros(len(words) + 1, dtype=bool)
            places = part.column(3)
            found[places.flatten().to_numpy() + np.repeat(first[:-1], pa.compute.list_value_length(places).to_numpy())] = True
            chosen, sizes = found[place], np.diff(before)
            whole = part.column(4).to_numpy(zero_copy_only=False) & (sizes > 0) & (np.diff(np.concatenate(([0], np.cumsum(chosen)))[before]) == sizes)
            chosen &= ~np.repeat(whole, sizes)
            counts = np.concatenate(([0], np.cumsum(chosen)))[before]
            at = starts[chosen]
            own = pa.array(at - np.repeat(first[:-1], np.diff(counts)), pa.int32())
            hashes = [pa.array(gram_hashes(words, window, *seed)[at].view(np.int64) if len(at) else [], pa.int64()) for seed in ((), (SECOND,))]
            offsets = pa.array(counts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (own, *hashes)]
            ends = pa.array(np.diff(first), pa.int64(), mask=~whole)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ends, *lists], names=["id", "twin", "copy_end", "start", "h1", "h2"])

    return run


def _merge(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for starts in part.column(2).to_pylist():
                s = np.unique(np.array(starts, dtype=np.int64))
                new = np.concatenate(([True], s[1:] > s[:-1] + window))
                last = np.concatenate((new[1:], [True]))
                out.append([{"start": a, "end": b} for a, b in zip(s[new].tolist(), (s[last] + window).tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["id", "twin", "spans"])

    return run


SPANS = "array<struct<start:bigint,end:bigint>>"


def find_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """id, twin (see ``text_key``) and spans: the word ranges that repeat an earlier document, one row for each text that has any."""
    if window < PHRASE:
        raise ValueError(f"a window has at least {PHRASE} words")
    base = columns(docs, id=id_col, text=text_col).where("id is not null").select("id", text_key(F.col("text")).alias("twin"), "text")
    kind = dict(base.dtypes)["id"]
    prints = keep(base.mapInArrow(_read(window), f"id {kind}, twin long, n_words long, words_sha binary, codes binary, phrase array<bigint>, context array<bigint>"))
    # Copies: rows of one word sequence. Partial aggregation keeps large groups apart until the end.
    long = prints.where(F.col("n_words") >= window)
    first = long.groupBy("words_sha").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id")
    # Kept, and sent everywhere if counted small; if not, the join's hot partitions can be split.
    first = small(keep(first.select("words_sha", "first_id")), 64)
    copies = keep(long.select("id", "twin", "words_sha").join(first, "words_sha").where("id > first_id").select("id", "twin", F.lit(True).alias("copy")).distinct())
    marked = prints.join(small(copies, 32), ["id", "twin"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    # Among different texts a phrase recurs together with its context; copies of one text count once for that.
    each = marked.where("not copy").select("id", F.explode(F.arrays_zip("phrase", "context")).alias("p")).select("id", "p.phrase", "p.context")
    confirmed = each.groupBy("context").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.first("phrase").alias("phrase")).where("a < b")
    copied = long.select("id", "words_sha", "phrase").join(first, "words_sha").where("id = first_id").select(F.explode("phrase").alias("phrase"), F.lit(False).alias("among"))
    recurring = keep(confirmed.select("phrase", F.lit(True).alias("among")).unionByName(copied).groupBy("phrase").agg(F.max("among").alias("among")))
    passing = dealt(marked.select("id", "twin", "codes", "copy"), recurring, shard_phrases)
    found = passing.mapInArrow(_stream, f"id {kind}, twin long, copy boolean, found array<int>")
    places = keep(found.groupBy("id", "twin").agg(F.max("copy").alias("copy"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")))
    size = places.agg(F.count("*") * 32 + F.coalesce(F.sum(F.size("found")), F.lit(0)) * 4).first()[0]
    texts = base.join(F.broadcast(places) if size <= BROADCAST_BYTES else places, ["id", "twin"]).select("id", "twin", "text", "found", "copy")
    located = keep(texts.mapInArrow(_locate(window), f"id {kind}, twin long, copy_end long, start array<int>, h1 array<bigint>, h2 array<bigint>"))
    whole = located.where("copy_end is not null").select("id", "twin", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("copy_end").alias("end"))).alias("spans")).distinct()
    pairs = located.select("id", "twin", F.explode(F.arrays_zip("start", "h1", "h2")).alias("w")).select("id", "twin", "w.start", "w.h1", "w.h2")
    earliest = pairs.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id").select("h1", "h2", "first_id")
    # Kept first: then both sides of the join are plain exchanges, whose hot partitions can be split.
    repeats = pairs.join(keep(earliest), ["h1", "h2"]).where("id > first_id")
    spans_found = repeats.groupBy("id", "twin").agg(F.collect_list("start").alias("starts")).mapInArrow(_merge(window), f"id {kind}, twin long, spans {SPANS}")
    return keep(spans_found.unionByName(whole))


def remove_spans(docs: DataFrame, found: DataFrame, keep_cols: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, kept_text (kept words joined by one space), n_words and n_removed of every row, with the columns in ``keep_cols``.

    A row without any repeated word also has its text as it was in ``text`` (null for others).
    """
    extra = {f"keep{i}": name for i, name in enumerate(keep_cols)}
    base = columns(docs, id=id_col, text=text_col, **extra).withColumn("twin", text_key(F.col("text")))
    size = found.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    fits = size["rows"] * 48 + size["spans"] * 16 <= BROADCAST_BYTES
    joined = base.join(F.broadcast(found) if fits else found, ["id", "twin"], "left").select("id", "text", "spans", *extra)
    fields = {f.name: f.dataType.simpleString() for f in joined.schema}
    schema = ", ".join([f"id {fields['id']}", *(f"{x} {fields[x]}" for x in extra), "text string, kept_text string, n_words long, n_removed long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            at = part.schema.get_field_index
            texts, spans_of = part.column(at("text")).to_pylist(), part.column(at("spans")).to_pylist()
            kept, words_n, removed, plain = [], [], [], []
            for text, cut in zip(texts, spans_of, strict=True):
                words = (text or "").encode().split()
                n = len(words)
                for s in reversed(cut or ()):
                    del words[s["start"] : s["end"]]
                kept.append(b" ".join(words).decode())
                words_n.append(n)
                removed.append(n - len(words))
                plain.append(text if n == len(words) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(at("id")), *(part.column(at(x)) for x in extra), pa.array(plain, pa.string()), pa.array(kept, pa.string()), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64())],
                names=["id", *extra, "text", "kept_text", "n_words", "n_removed"],
            )

    out = joined.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), *(F.col(a).alias(n) for a, n in extra.items()), "text", "kept_text", "n_words", "n_removed")


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_cols: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find and remove, in one call."""
    return remove_spans(docs, find_repeats(docs, window, id_col, text_col), keep_cols, id_col, text_col)
