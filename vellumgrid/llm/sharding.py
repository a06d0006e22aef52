"""Sharding by sampled splitters, without user functions.

Rows are ordered by a key (a hash of the id, the id, and a row number that tells ties apart). A
size-weighted sample of keys gives quantile boundaries of fine ranges, by which the rows are partitioned; ranges that come
out overfull are subdivided by a denser sample of their own rows, round after round, until none is left. Every row's place in the
order of all bytes follows from its range's start and a running sum within the range. Shard k takes the rows
whose first byte lies in the k-th of equal parts of all bytes, so shard sizes differ from the
mean by less than one text.

Null texts have size 1, null ids are keys like any other, repeated rows are rows of their own (so there are no ties) and
an empty table gives an empty one. A very long text is one row, which may fill a shard; texts are measured and not moved: what
is ranged are slim rows, checkpointed so that their row number stays. Other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.llm._arrow import columns
from vellumgrid.llm._tables import BROADCAST_BYTES, keep

#: Fine ranges for each shard, at least, and sampled keys for each range.
RANGES_PER_SHARD = 32
SAMPLES_PER_RANGE = 16
#: Rows for which a range is planned, at most: a task sorts one range, so ranges grow in number and not in size.
ROWS_PER_RANGE = 1_000_000
#: A range of more than this many times its share of bytes or rows is subdivided.
OVERFULL = 4.0


def _splitters(rows: DataFrame, step: float, rate: float) -> DataFrame:
    """Quantile boundaries: (range, key) of the sampled rows that begin a new part of ``step`` bytes in their range.

    A row is drawn with probability min(1, size * rate) and stands for max(size, 1 / rate) bytes. The
    sample's size is set by the number of ranges asked for, not by the table. A row of half a part or more stands alone: the
    row after it begins a part, too. So once every row is drawn, a range is one row or less than two parts.
    """
    u = F.pmod(F.xxhash64("key", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(u < F.col("size") * rate).select("range", "key", F.greatest(F.col("size").cast("double"), F.lit(1 / rate)).alias("stands_for"))
    order = Window.partitionBy("range").orderBy("key")
    total = F.sum("stands_for").over(order)
    part = F.floor(total / step)
    after = F.coalesce(F.lag("stands_for").over(order) >= step / 2, F.lit(False))
    return drawn.select("range", "key", part.alias("part"), F.floor((total - F.col("stands_for")) / step).alias("before"), after.alias("after")).where("part > before or after").select("range", "key")


def _bisect(bounds: Column, n: int, key: Column) -> Column:
    """How many of ``n`` sorted bounds are <= key, by halving."""
    steps, reach = [], 1
    while reach <= n:
        steps.insert(0, reach)
        reach *= 2
    if not steps:
        return F.lit(0)

    def step(at: Column, half: Column) -> Column:
        return F.when((at + half <= n) & (F.get(bounds, F.least(at + half, F.lit(n)) - 1) <= key), at + half).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _assign(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with ``range`` set to the number of splitters at or before their key.

    The splitters are one array, sent everywhere: a key of some 64 bytes for ROWS_PER_RANGE rows, checked against the bound.
    """
    n = bounds.count()
    if n * 64 > BROADCAST_BYTES:
        raise ValueError(f"{n} ranges are too many to send everywhere: raise ROWS_PER_RANGE")
    if not n:
        return rows.withColumn("range", F.lit(0))
    sorted_bounds = bounds.groupBy().agg(F.array_sort(F.collect_list("key")).alias("bounds"))
    return rows.crossJoin(F.broadcast(sorted_bounds)).withColumn("range", _bisect(F.col("bounds"), n, F.col("key"))).drop("bounds")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, shard (0 to ``shards`` - 1) and slot (gapless within the shard) of every row."""
    text = F.col("text")
    slim = columns(docs, id=id_col, text=text_col).select(
        "id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32")
    )
    slim = slim.withColumn("key", F.struct(F.xxhash64("id").alias("h"), F.col("id"), F.monotonically_increasing_id().alias("row")))
    # The row number tells ties apart; the checkpoint keeps it the same if a task is run again.
    slim = keep(slim.withColumn("range", F.lit(0)))
    total = slim.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return slim.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = shards * max(RANGES_PER_SHARD, math.ceil(total["rows"] / (shards * ROWS_PER_RANGE)))
    step = total["bytes"] / ranges
    rate = SAMPLES_PER_RANGE / step
    bounds = keep(_splitters(slim, step, rate).select("key").distinct())
    placed = _assign(slim, bounds)
    most_rows = max(64.0, OVERFULL * total["rows"] / ranges)
    density = 1
    while True:
        sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        overfull = sizes.where((F.col("rows") > 1) & ((F.col("bytes") > OVERFULL * step) | (F.col("rows") > most_rows))).select("range").collect()
        if not overfull:
            break
        # At most ranges / OVERFULL of them can be overfull by either measure.
        inside = placed.where(F.col("range").isin([r[0] for r in overfull]))
        # Denser every round: in the end every row is drawn, and keys differ, so that every range of two rows can be cut.
        density *= 4
        finer = _splitters(inside, step / 2, rate * density)
        by_rows = _splitters(inside.withColumn("size", F.lit(1).cast("long")), most_rows / 4, min(1.0, density * SAMPLES_PER_RANGE / most_rows))
        bounds = keep(bounds.unionByName(finer.select("key")).unionByName(by_rows.select("key")).distinct())
        placed = _assign(slim, bounds)
    sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"))
    # As many rows as ranges: a bounded number.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy("key")
    at = F.col("start") + F.sum("size").over(within) - F.col("size")
    ranked = placed.join(F.broadcast(starts), "range").select(
        "id", "size", "text_crc32", "range", F.row_number().over(within).alias("n"), F.least(F.lit(shards - 1), F.floor(at * shards / F.lit(total["bytes"]))).cast("int").alias("shard")
    )
    ranked = keep(ranked)
    cells = ranked.groupBy("shard", "range").agg(F.count("*").alias("rows"), (F.min("n") - 1).alias("skip"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "range", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("skip") - 1).alias("offset"))
    return ranked.join(F.broadcast(offsets), ["shard", "range"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("n") + F.col("offset")).cast("long").alias("slot"))
