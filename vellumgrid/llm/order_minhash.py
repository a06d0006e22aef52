"""Document fingerprints by order MinHash, as column expressions.

A text is cut into tokens (words, long ones in pieces of ``PIECE`` characters) and its k-mers of ``K`` tokens are numbered by occurrence,
so that every one of them is an element of its own. The ``SKETCH`` elements of smallest hash are kept; then for each of ``SIZE`` permutations the two
minimal ones are selected and hashed as a tuple, in the order in which they stand in the text. Two texts agree
in a tuple if they share those elements and have them in the same order, so the share of equal tuples falls with their edit
distance and not only with their sets of k-mers. A fingerprint is all tuples' hashes, ``HEX`` hex digits each.

Everything about one text is one projection. An element is one long integer: the high bits its hash, the low ``PLACE`` bits its place.
Equal k-mers are neighbours once these are sorted, which numbers them without comparing all pairs.

Null and blank texts have no tokens and the empty fingerprint; a text of fewer than K tokens has one k-mer, all of them. Texts that differ only
in white space have equal fingerprints. Likeness is 1 for equal fingerprints, empty ones included, and 0 if one of two is
empty. A text may be as long as a task holds; the work grows as n log n. Rows are independent of one another but for ``with_next``, where
rows stand by falling id (nulls last), rows of one id by their text's hash; rows alike in both hold the same text, so which of
them comes first changes nothing. An empty table gives an empty one. Other columns, whatever their names, are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.llm._arrow import columns
from vellumgrid.llm._tables import keep
from vellumgrid.llm.sharding import SAMPLES_PER_RANGE, _assign, _splitters

PIECE = 12
K = 3
SKETCH = 96
SIZE = 64
HEX = 8
PLACE = 30

#: Ranges of rows that stand next to one another: at least, at most, and rows for which one is planned.
RANGES = (256, 1 << 16, 100_000)

_LOW = (1 << PLACE) - 1


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _packed(hash_: Column, place: Column) -> Column:
    return hash_.bitwiseAND(F.lit(~_LOW)).bitwiseOR(place.bitwiseAND(F.lit(_LOW)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^\\x20\\x09-\\x0D]{{1,{PIECE}}}"), F.lit(0))


def _elements(words: Column) -> Column:
    """The hashes of the SKETCH smallest occurrence-numbered k-mers, in the order of the text."""
    last = F.greatest(F.size(words) - K, F.lit(0))
    kmers = F.transform(F.sequence(F.lit(0), last), lambda i: _packed(F.xxhash64(*[F.get(words, i + j) for j in range(K)]), i.cast("long")))

    def numbered(sorted_: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (F.shiftright(F.get(sorted_, i), PLACE) != F.shiftright(F.get(sorted_, i - 1), PLACE)))
        counts = _let(first, lambda at: F.flatten(F.transform(at, lambda a, i: F.sequence(F.lit(1), F.coalesce(F.get(at, i + 1), F.size(sorted_)) - a))))
        return F.zip_with(sorted_, counts, lambda p, n: _packed(F.xxhash64(F.shiftright(p, PLACE), n), p))

    smallest = F.slice(F.sort_array(_let(F.sort_array(kmers), numbered)), 1, SKETCH)
    placed = F.transform(smallest, lambda v: F.shiftleft(v.bitwiseAND(F.lit(_LOW)), 63 - PLACE).bitwiseOR(F.shiftrightunsigned(v, PLACE + 1)))
    return F.transform(F.sort_array(placed), lambda v: v.bitwiseAND(F.lit((1 << (63 - PLACE)) - 1)))


def _pair(elements: Column, permutation: Column) -> Column:
    """32 bits of the hash of a permutation's two minimal elements in the order of the text (of one element, of itself twice)."""
    index = (1 << SKETCH.bit_length()) - 1
    permuted = F.transform(elements, lambda e, i: F.xxhash64(e, permutation).bitwiseAND(F.lit(~index)).bitwiseOR(i.cast("long")))

    def minimal(values: Column, smallest: Column) -> Column:
        a = smallest.bitwiseAND(F.lit(index)).cast("int")
        b = F.array_min(F.array_remove(values, smallest)).bitwiseAND(F.lit(index)).cast("int")
        return F.xxhash64(F.get(elements, F.least(a, b)), F.get(elements, F.greatest(a, b))).bitwiseAND(F.lit(0xFFFFFFFF))

    return _let(permuted, lambda values: _let(F.array_min(values), lambda smallest: minimal(values, smallest)))


def signature(text: Column) -> Column:
    """The tuples' hashes of a text; empty for a text without tokens."""
    some = lambda words: F.when(F.size(words) > 0, _let(_elements(words), lambda elements: F.transform(F.sequence(F.lit(1), F.lit(SIZE)), lambda i: _pair(elements, i))))
    return F.coalesce(_let(tokens(text), some), F.array().cast("array<bigint>"))


def fingerprint(signature_: Column) -> Column:
    return F.array_join(F.transform(signature_, lambda h: F.lpad(F.lower(F.hex(h)), HEX, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples of two signatures."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: same))
    size = F.greatest(F.size(a), F.size(b))
    return F.when(size > 0, equal / size).otherwise(F.lit(1.0))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, text and signature of every row, and next_text and next_signature of the row that follows by falling id; the first follows the last.

    Rows are dealt into ranges of the order by sampled splitters (as in ``sharding``); a range's last row is also dealt, as a
    guest, to the range whose first row it precedes. So neighbours meet in one shuffle, and no task sees all rows.
    """
    base = columns(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    # Ascending order, nulls first: the next row by falling id is the previous one.
    base = base.withColumn("key", F.struct(F.col("id"), F.xxhash64("text").alias("h")))
    slim = keep(base.select("key", (F.octet_length("text") + 1).cast("long").alias("size"), F.lit(0).alias("range")))
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    least, most, rows = RANGES
    step = max(total["bytes"], 1) / min(most, max(least, total["rows"] // rows))
    bounds = keep(_splitters(slim, step, SAMPLES_PER_RANGE / step).select("key").distinct())
    # As many rows as ranges.
    order = Window.orderBy("range")
    lasts = _assign(slim, bounds).groupBy("range").agg(F.max("key").alias("key"))
    guests = keep(lasts.select("range", "key", F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy())).alias("to")))
    placed = _assign(base.withColumn("signature", signature(F.col("text"))), bounds).join(F.broadcast(guests), ["range", "key"], "left")
    seats = F.filter(F.array(F.struct(F.lit(False).alias("guest"), F.col("range")), F.struct(F.lit(True).alias("guest"), F.col("to").alias("range"))), lambda s: s["range"].isNotNull())
    dealt = placed.select("id", "text", "key", "signature", F.explode(seats).alias("seat")).select("id", "text", "key", "signature", "seat.guest", "seat.range")
    before = Window.partitionBy("range").orderBy(F.desc("guest"), "key")
    met = dealt.withColumns({"next_text": F.lag("text").over(before), "next_signature": F.lag("signature").over(before)})
    return met.where(~F.col("guest")).select(F.col("id").alias(id_col), "text", "signature", "next_text", "next_signature")
