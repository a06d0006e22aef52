"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts are words: A-Z folded, then runs of ASCII letters, digits and non-ASCII characters. Of every
window of ``WINDOW`` words the smallest hash of its ``GRAM``-word grams is kept; equal windows keep
equal hashes, so a join of the documents' fingerprints with the benchmark's misses no shared window. Neighbouring windows
that keep the same hash are one fingerprint with an extent. Those that the join finds are extended to their
windows, compared as words, and every document word inside an occurrence is counted. Benchmark items shorter than a window are
one window of their own length; for each such length that occurs, the same projection also takes the grams of that length.

A benchmark that is counted small is sent to the executors, and documents are read once; else its fingerprints are shuffled,
and the documents that they meet are read again. Either way no row that leaves a task holds more than one window.

A null text has no words, nor has an empty one; an item without words has no window; an item with a null id marks words
but is not named. Rows that share id and text are answered alike, each on its own row. Null document
ids are kept. Equal windows of several items name all of these, so there are no ties. Empty tables give empty results, an
empty benchmark clean ones. Texts may be of any length: the work is in proportion to it. Other columns, whatever their
names, are dropped; ``drop_contaminated`` keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm._arrow import column, columns
from vellumgrid.llm._tables import BROADCAST_BYTES, keep

WINDOW, GRAM = 10, 8
#: Windows of a chunk: texts are cut into chunks (which overlap by a window less a word), so that what travels with a
#: fingerprint does not grow with the text.
CHUNK = 512

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text; only texts with non-ASCII characters need the slower folding of A-Z alone."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(folded, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


MARK = "struct<size:int,at:int,n:int,print:bigint>"


def _sliding(array: str, size: int, make, kind: str = "bigint") -> Column:
    """``make(values)`` for every ``size`` consecutive values of an array."""
    n = F.size(array)
    own = F.transform(F.sequence(F.lit(0), n - size), lambda i: make([F.get(array, i + k) for k in range(size)]))
    return F.when(n >= size, own).otherwise(F.array().cast(f"array<{kind}>"))


def _marks(frame: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds ``marks``: the fingerprints (size, at, n, print) of the windows of each size, of n windows from ``at`` on.

    Every array is named more than once, so that the optimiser leaves it a column of its own: put into a lambda it
    would be computed for every window. Marks are to be exploded with the outer forms only: for the others the optimiser
    adds a filter on the array's size, for which it computes the array once more, and badly.
    """
    out = frame.withColumn("_words", F.transform("words", lambda w: F.xxhash64(w)))
    marks = []
    for size in sizes:
        if size < WINDOW:
            out = out.withColumn(f"_least{size}", _sliding("_words", size, lambda v: F.xxhash64(*v)))
        else:
            out = out.withColumn("_grams", _sliding("_words", GRAM, lambda v: F.xxhash64(*v)))
            out = out.withColumn(f"_least{size}", _sliding("_grams", WINDOW - GRAM + 1, lambda v: F.least(*v)))
        kept, begins = f"_least{size}", f"_begins{size}"
        places = F.filter(F.sequence(F.lit(0), F.size(kept) - 1), lambda i: (i == 0) | (F.get(kept, i) != F.get(kept, i - 1)))
        out = out.withColumn(begins, F.when(F.size(kept) > 0, places).otherwise(F.array().cast("array<int>")))
        marks.append(_marked(size, kept, begins))
    return out.select(*frame.columns, F.concat(*marks).alias("marks"))


def _marked(size: int, kept: str, begins: str) -> Column:
    def mark(at: Column, k: Column) -> Column:
        n = F.coalesce(F.get(begins, k + 1), F.size(kept)) - at
        return F.struct(F.lit(size).alias("size"), at.alias("at"), n.alias("n"), F.get(kept, at).alias("print"))

    return F.transform(begins, mark).cast(f"array<{MARK}>")


def _chunks(frame: DataFrame) -> DataFrame:
    """A row for each chunk, with its place ``k``; a text without words has one."""
    last = F.greatest(F.ceil(F.size("words") / CHUNK).cast("int") - 1, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("words", k * CHUNK + 1, F.lit(CHUNK + WINDOW - 1)))
    return frame.select(*[c for c in frame.columns if c != "words"], F.posexplode_outer(each).alias("k", "words"))


def _windows(words: str, mark: Column) -> Column:
    """(at, window) of the windows that a fingerprint stands for, ``at`` from 1."""
    each = F.sequence(mark["at"] + 1, mark["at"] + mark["n"])
    return F.transform(each, lambda at: F.struct(at.alias("at"), F.array_join(F.slice(words, at, mark["size"]), " ").alias("window")))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """item, size, print and window (its words joined by spaces) of every window of every item, kept, and the sizes that occur."""
    items = columns(benchmark, item=id_col, text=text_col).select("item", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("own", F.least(F.size("words"), F.lit(WINDOW)))
    # At most WINDOW numbers.
    sizes = sorted({WINDOW} | {r[0] for r in items.select("own").distinct().collect()})
    each = _marks(_chunks(items), sizes).select("item", "words", "own", F.explode_outer("marks").alias("m")).where("m.size = own")
    spelt = each.select("item", F.col("m.size").alias("size"), F.col("m.print").alias("print"), F.explode_outer(_windows("words", F.col("m"))).alias("w"))
    return keep(spelt.select("item", "size", "print", F.col("w.window").alias("window")).distinct()), sizes


def _numbered(windows: DataFrame) -> DataFrame:
    """size, print, window, number and names of every different window, kept: ``names`` are the items that hold it (null ids are not named).

    So an occurrence is one row, whatever the number of items that share its window.
    """
    each = windows.groupBy("size", "print", "window").agg(F.collect_set(F.col("item").cast("string")).alias("names"))
    return keep(each.withColumn("number", F.monotonically_increasing_id()))


def _hits(docs: DataFrame, windows: DataFrame, sizes: list[int], broadcast_bytes: int) -> DataFrame:
    """id, key, n_words, at, size and window number of every occurrence, and a row for each document whose ``at`` is null."""
    prints = windows.select(F.col("size").alias("own_size"), F.col("print").alias("own_print")).distinct()
    texts = windows.select(F.col("size").alias("item_size"), F.col("window").alias("item_window"), "number")
    bytes_ = windows.agg(F.coalesce(F.count("*") * 40 + F.sum(F.octet_length("window")), F.lit(0))).first()[0]
    chunks = _chunks(docs)
    # The first chunk of a text begins with a mark of nothing, which stands for the text.
    nothing = F.when(F.col("k") == 0, F.array(F.lit(None).cast(MARK))).otherwise(F.array().cast(f"array<{MARK}>"))
    met = (F.col("m.print") == F.col("own_print")) & (F.col("m.size") == F.col("own_size"))
    if bytes_ <= broadcast_bytes:
        marked = _marks(chunks, sizes).select("id", "key", "n_words", "k", "words", F.explode_outer(F.concat(nothing, "marks")).alias("m"))
        some = marked.join(F.broadcast(prints), met, "left").where("own_print is not null or (m is null and k = 0)")
        texts = F.broadcast(texts)
    else:
        slim = _marks(chunks, sizes).select("id", "key", "k", F.explode_outer("marks").alias("m")).join(prints, met).select(F.col("id").alias("own_id"), F.col("key").alias("own_key"), F.col("k").alias("own_k"), "m")
        found = keep(slim.groupBy("own_id", "own_key", "own_k").agg(F.collect_set("m").alias("marks")))
        hit = (F.col("key") == F.col("own_key")) & (F.col("k") == F.col("own_k")) & F.col("id").eqNullSafe(F.col("own_id"))
        given = F.coalesce("marks", F.array().cast(f"array<{MARK}>"))
        some = chunks.join(found, hit, "left").select("id", "key", "n_words", "k", "words", F.explode_outer(F.concat(nothing, given)).alias("m")).where("m is not null or k = 0")
    spelt = some.select("id", "key", "n_words", "k", F.col("m.size").alias("size"), F.explode_outer(F.when(F.col("m").isNotNull(), _windows("words", F.col("m")))).alias("w"))
    same = (F.col("size") == F.col("item_size")) & (F.col("w.window") == F.col("item_window"))
    found = spelt.join(texts, same, "left").where("item_window is not null or w is null")
    return found.select("id", "key", "n_words", (F.col("w.at") + F.col("k") * CHUNK).alias("at"), "size", "number")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``id_col``, key (hash of the text), n_words, n_hit, items (sorted names) and spans (at, size) of every row."""
    base = columns(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    windows, sizes = item_windows(benchmark, item_id_col, item_text_col)
    windows = _numbered(windows)
    found = _hits(base, windows.drop("names"), sizes, broadcast_bytes)
    per_text = found.groupBy("id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("at").isNull(), 1)).alias("rows"),
        F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "size"))).alias("spans"),
        F.collect_set("number").alias("numbers"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))))
    counted = per_text.select("id", "key", "n_words", F.when(F.size("spans") > 0, covered).otherwise(0).cast("long").alias("n_hit"), F.array_sort("spans").alias("spans"), "rows", "numbers")
    # The windows' names are looked up once a document, in the partitions in which its occurrences were gathered.
    each = counted.select("id", "key", "n_words", "n_hit", "rows", "spans", F.posexplode_outer("numbers").alias("nth", "number"))
    each = each.withColumn("spans", F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("spans")))
    bytes_ = windows.agg(F.coalesce(F.count("*") * 40 + F.sum(F.aggregate("names", F.lit(0).cast("long"), lambda n, x: n + 16 + F.octet_length(x))), F.lit(0))).first()[0]
    names = windows.select("number", "names")
    named = each.join(F.broadcast(names) if bytes_ <= broadcast_bytes else names, "number", "left")
    out = named.groupBy("id", "key").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n_words", "n_hit", "rows", "spans")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("items"),
    )
    return out.select(F.col("id").alias(id_col), "key", "n_words", "n_hit", "items", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy")).drop("copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of whose words at most ``share`` lie in an occurrence of a benchmark window."""
    found = contamination(docs, benchmark, id_col, text_col)
    name = next(n for n in (f"contaminated_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    bad = keep(found.where(F.col("n_hit") > share * F.col("n_words")).select(F.struct(F.col(id_col).alias("id"), "key").alias(name)).distinct())
    mark = F.broadcast(bad) if bad.count() * 24 <= BROADCAST_BYTES else bad
    match = (F.xxhash64(column(docs, text_col)) == F.col(f"{name}.key")) & column(docs, id_col).eqNullSafe(F.col(f"{name}.id"))
    return docs.join(mark, match, "left_anti")
