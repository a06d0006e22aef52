"""Near-duplicate detection by min-max hashing.

Each permutation of a document's shingle set yields two signature values, its minimum and its maximum,
so half the hash evaluations give as many values as plain MinHash. Values are banded; documents
that agree on a band are candidates, and candidates are confirmed on their full shingle sets.

Documents with the same set are one class, named by its smallest id. Every band bucket has a leader,
its smallest class; all classes that ever share a bucket with a leader form that leader's group, which
holds every candidate pair of those buckets. Groups are dealt into blocks bounded in classes and in shingles, and
confirmed in two rounds by sparse matrix products, of which only a star for each connected part leaves the task:

1. every block with its leader. A group of copies of one text is one component afterwards, at one
   shipment of each set;
2. in groups of several blocks that are not yet one component, the classes outside the largest
   component with each other and with it. Pairs within that component need no comparing.

Components are then found by alternating large-star and small-star steps.

With 26 bands of 5 values a pair at similarity 0.85 is missed with a probability of 3e-7, one at 0.9
of 5e-11. Empty and null texts have no shingles and no links. A row with a null id is a class of none:
its component is null and it is kept. Rows that share an id are one node, repeated rows are answered alike. Ties
do not arise: the smallest id stands for its class and component. Empty tables give empty results. Whole texts are
read, a very long one in blocks of its shingles; a set is one row and has to fit into a task. Other columns of
``docs`` are dropped at once, whatever their names. No group is ever cut short; one whose classes are all candidates but no
links costs the square of its size, in comparisons and, divided by the block, in shipped sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm._arrow import columns, slices
from vellumgrid.llm._tables import keep, semi, small
from vellumgrid.llm._words import SPACE, U, buffers, gram_hashes, mix, span_hashes, spans

SHINGLE = 5
PERMUTATIONS = 65
BAND = 5
#: Classes and shingles in a block of a large group (about); a task confirms at most two blocks.
BLOCK = 256
BLOCK_SHINGLES = 1 << 19
COLUMNS = 8192

_KINDS = (~SPACE).astype(np.uint8)
_SEEDS = mix(np.arange(1, PERMUTATIONS + 1, dtype=U) * U(0xA0761D6478BD642F))
_TURNS = mix(np.arange(1, PERMUTATIONS + 1, dtype=U) * U(0xE7037ED1A0B428DB)) | U(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of every document's distinct shingles, one document after another, and the first of each."""
    data, offsets = buffers(texts)
    starts, ends, first = spans(data, offsets, _KINDS)
    words = span_hashes(data, starts, ends, lower=True)
    grams = gram_hashes(words, SHINGLE)
    sets = []
    for i, j in zip(first[:-1], first[1:], strict=True):
        if j - i >= SHINGLE:
            sets.append(np.unique(grams[i : j - SHINGLE + 1]))
        elif j > i:
            # Too short for a shingle: the whole sequence is the only one, told apart by its length.
            sets.append(mix(gram_hashes(words[i:j], int(j - i)) + U(j - i)))
        else:
            sets.append(np.empty(0, dtype=U))
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    return np.concatenate([*sets, np.empty(0, dtype=U)]), np.concatenate(([0], np.cumsum(sizes)))


def band_keys(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Band hashes (documents x bands) of non-empty sets, from the minimum and maximum under each permutation."""
    n = len(first) - 1
    values = np.empty((n, 2 * PERMUTATIONS), dtype=U)
    step = 1 << 18
    for i in range(0, n):
        if first[i + 1] - first[i] > step:  # one long document: in blocks, so that memory stays bounded
            own = sets[first[i] : first[i + 1]]
            for p in range(PERMUTATIONS):
                parts = [(own[k : k + step] ^ _SEEDS[p]) * _TURNS[p] for k in range(0, len(own), step)]
                values[i, p], values[i, PERMUTATIONS + p] = min(x.min() for x in parts), max(x.max() for x in parts)
    rest = np.flatnonzero(np.diff(first) <= step)
    i = 0
    while i < len(rest):
        j = i + 1
        while j < len(rest) and rest[j] == rest[j - 1] + 1 and first[rest[j] + 1] - first[rest[i]] <= step:
            j += 1
        a, b = rest[i], rest[j - 1] + 1
        own, at = sets[first[a] : first[b]], first[a:b] - first[a]
        for p in range(PERMUTATIONS):
            x = (own ^ _SEEDS[p]) * _TURNS[p]
            values[a:b, p] = np.minimum.reduceat(x, at)
            values[a:b, PERMUTATIONS + p] = np.maximum.reduceat(x, at)
        i = j
    bands = 2 * PERMUTATIONS // BAND
    out = np.empty((n, bands), dtype=U)
    for b in range(bands):
        h = np.full(n, b + 1, dtype=U)
        for v in range(b * BAND, (b + 1) * BAND):
            h = mix(h * U(0x9E3779B97F4A7C15) + values[:, v])
        out[:, b] = h
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        sets, first = shingle_sets(part.column(1))
        sizes = np.diff(first)
        full = np.flatnonzero(sizes)
        dense = np.concatenate(([0], np.cumsum(sizes[full])))
        bands = band_keys(sets, dense) if len(full) else np.empty((0, 2 * PERMUTATIONS // BAND), U)
        counts = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands.shape[1], 0))))
        # The set's name: two sums of mixed shingles, which do not depend on order.
        sums = [np.concatenate((np.zeros(1, U), np.cumsum(mix(sets ^ U(seed)))))[first] for seed in (0x1B873593, 0xCC9E2D51)]
        name = np.stack([np.diff(s) for s in sums], axis=1)
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(sizes, pa.int64()),
                pa.array([x.tobytes() if s else None for x, s in zip(name, sizes, strict=True)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(bands.reshape(-1).view(np.int64), pa.int64())),
            ],
            names=["id", "n_shingles", "set_name", "bands"],
        )


def _ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        sets, first = shingle_sets(part.column(1))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sets[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["id", "shingles"])


def confirm(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets with 100 * intersection >= percent * union, as a star for each connected part."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=m)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (sizes.sum() - both) else []
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = times[number] > 1
    # A set most of whose shingles stand alone can have no link here.
    alive = 100 * np.bincount(owner[shared], minlength=m) >= percent * sizes
    use = shared & alive[owner]
    owner, number = owner[use], number[use]
    rows = np.flatnonzero(alive)
    if len(rows) < 2:
        return []
    place = np.full(m, -1)
    place[rows] = np.arange(len(rows))
    used, number = np.unique(number, return_inverse=True)
    owner = place[owner]
    both = np.zeros((len(rows), len(rows)), dtype=np.float32)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for c in range(0, len(used), COLUMNS):
        i, j = np.searchsorted(number, [c, c + COLUMNS])
        part = np.zeros((len(rows), min(COLUMNS, len(used) - c)), dtype=np.float32)
        part[owner[i:j], number[i:j] - c] = 1
        both += part @ part.T
    count = np.rint(both).astype(np.int64)
    size = sizes[rows]
    linked = 100 * count >= percent * (size[:, None] + size[None, :] - count)
    np.fill_diagonal(linked, False)
    out, seen = [], np.zeros(len(rows), dtype=bool)
    for i in range(len(rows)):
        if seen[i]:
            continue
        seen[i] = True
        front = [i]
        while front:
            new = linked[front].any(0) & ~seen
            seen |= new
            front = np.flatnonzero(new).tolist()
            out += [(int(rows[i]), int(rows[k])) for k in front]
    return out


#: What names a task: the group, the round's kind of blocks, and the two blocks.
TASK = ("leader", "kind", "i", "j")


def _confirm_groups(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def links() -> pa.RecordBatch:
            pairs = [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in confirm(sets, percent) if ids[i] != ids[j]]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *task, own, shingles in zip(*(batch.column(c).to_pylist() for c in range(len(TASK) + 2)), strict=True):
                if task != key:
                    if len(sets) > 1:
                        yield links()
                    key, ids, sets = task, [], []
                ids.append(own)
                sets.append(np.frombuffer(shingles, dtype=U))
        if len(sets) > 1:
            yield links()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), component being the smallest node it reaches."""

    def once(least: DataFrame) -> DataFrame:
        """Kept, and sent everywhere if counted small, so that a hub's edges need not meet in one task."""
        return small(keep(least), 24)

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = once(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        # a < b: every node b is joined to the smallest of its smaller neighbours, and so are they.
        least = once(e.groupBy("b").agg(F.min("a").alias("m")))
        others = e.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        return others.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()

    edges = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        edges = keep(small_star(keep(large_star(edges))))
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))


def _blocks(size: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(size) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _dealt(blocks: str) -> Column:
    return F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")


def _to(blocks: str) -> Column:
    return F.sequence(F.lit(0), F.col(blocks) - 1)


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` (long), n_shingles, component_id and kept of every row of ``docs``."""
    base = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    rows = keep(base.mapInArrow(_sign, "id long, n_shingles long, set_name binary, bands array<bigint>"))
    named = rows.where("id is not null and set_name is not null")
    classes = keep(named.groupBy("set_name").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    each = classes.select("rep", "n", F.explode("bands").alias("band"))
    leaders = each.groupBy("band").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("band", "leader")
    # Kept first: then both sides of the join are plain exchanges, whose hot partitions can be split.
    members = keep(each.join(keep(leaders), "band").select("leader", "rep", "n").distinct())
    groups = keep(members.groupBy("leader").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")))
    dealt = members.join(groups.select("leader", _blocks("size", "shingles").alias("blocks")), "leader")

    def links_of(tasks: DataFrame) -> DataFrame:
        """Links within each task (``TASK``, rep), confirmed on the sets of the classes concerned."""
        wanted = keep(tasks.select("rep").distinct())
        sets = semi(base, wanted.select(F.col("rep").alias("id")), ["id"], wanted.count(), 16).mapInArrow(_ship, "id long, shingles binary").where(F.length("shingles") > 0)
        filled = tasks.join(sets, tasks["rep"] == sets["id"]).select(*TASK, "rep", "shingles")
        return filled.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(_confirm_groups(percent), "a long, b long")

    at = F.when(F.col("rep") == F.col("leader"), _to("blocks")).otherwise(F.array(_dealt("blocks")))
    first = keep(links_of(dealt.select("leader", F.lit(0).alias("kind"), F.explode(at).alias("i"), F.lit(0).alias("j"), "rep")))
    # Rows that share an id but not a set are one node all the same.
    own_class = keep(rows.select("id", "n_shingles", "set_name").join(classes.select("set_name", "rep"), "set_name", "left").select("id", "n_shingles", "rep"))
    shared = own_class.where("id is not null and rep is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    same = own_class.join(shared, "id").where("rep > a").select("a", F.col("rep").alias("b"))
    found = keep(components(first.unionByName(same)))
    rest = _rest(dealt.where("blocks > 1"), found)
    if not rest.isEmpty():
        found = keep(components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links_of(rest))))
    return own_class.join(small(found, 24), F.col("rep") == F.col("node"), "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "rep", "id"), F.lit(True)).alias("kept"),
    )


def _rest(dealt: DataFrame, found: DataFrame) -> DataFrame:
    """The second round's tasks (``TASK``, rep) for groups of several blocks (leader, rep, n): every class outside a group's
    largest component with each other (kind 1) and with that component (kind 2)."""
    known = dealt.select("leader", "rep", "n").join(small(found, 24), F.col("rep") == F.col("node"), "left").select("leader", "rep", "n", F.coalesce("component", "rep").alias("part"))
    known = keep(known)
    parts = known.groupBy("leader", "part").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    facts = parts.groupBy("leader").agg(F.max(F.struct("c", "s", "part")).alias("main"), F.sum("c").alias("all_c"), F.sum("s").alias("all_s")).where("all_c > main.c")
    facts = facts.select("leader", "main.part", F.col("main.c").alias("c"), F.col("main.s").alias("s"), (F.col("all_c") - F.col("main.c")).alias("rest_c"), (F.col("all_s") - F.col("main.s")).alias("rest_s"))
    facts = keep(facts.select("leader", F.col("part").alias("main"), _blocks("c", "s").alias("mains"), _blocks("rest_c", "rest_s").alias("rests")))
    open_ = known.join(facts, "leader")
    inside, outside = open_.where("part = main"), open_.where("part <> main")
    among = outside.select("leader", F.lit(1).alias("kind"), "rep", _dealt("rests").alias("own"), F.explode(_to("rests")).alias("other"))
    return keep(
        among.select("leader", "kind", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep")
        .unionByName(outside.select("leader", F.lit(2).alias("kind"), _dealt("rests").alias("i"), F.explode(_to("mains")).alias("j"), "rep"))
        .unionByName(inside.select("leader", F.lit(2).alias("kind"), F.explode(_to("rests")).alias("i"), _dealt("mains").alias("j"), "rep"))
    )
