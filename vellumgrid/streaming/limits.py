"""Daily and session caps, on stored events and on streams."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vellumgrid.functions import fixed as X


def daily_caps(calls: DataFrame, per_visitor: int = X.PER_VISITOR_DAILY, total: int = X.GLOBAL_DAILY, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Adds day (UTC) and admitted: the first calls of a visitor's day, and of these the first of the day.

    A call over the visitor's cap is not counted towards the day's, as a refused call costs nothing. Both
    rankings are cut at their caps, so each task drops what cannot be admitted before the shuffle, and a day
    gathers at most ``total`` calls of each task. ``order`` names a call.
    """
    dated = calls.withColumn("day", F.to_date("ts"))
    own, everyone = (Window.partitionBy(*by).orderBy(*order) for by in (("day", "user_id"), ("day",)))
    first = dated.select("day", "user_id", *order).withColumn("_own", F.row_number().over(own)).where(F.col("_own") <= per_visitor)
    admitted = first.withColumn("_all", F.row_number().over(everyone)).where(F.col("_all") <= total).select(*order, F.lit(True).alias("admitted"))
    return dated.join(admitted, list(order), "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def daily_counts(calls: DataFrame, watermark: str = "1 hour", per_visitor: int = X.PER_VISITOR_DAILY) -> DataFrame:
    """day, user_id, n and admitted, counted over tumbling UTC days; works on streams and on tables.

    The event time is cast to a timestamp with zone: watermarks refuse the one without.
    """
    timed = calls.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    timed = timed.withWatermark("ts", watermark) if timed.isStreaming else timed
    counted = timed.groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.to_date("w.start").alias("day"), "user_id", "n", F.least("n", F.lit(per_visitor)).alias("admitted"))


def session_caps(calls: DataFrame, gap: str = "30 minutes", cap: int = X.PER_SESSION, watermark: str = "1 hour") -> DataFrame:
    """user_id, start, n and admitted of every session, a session being calls less than ``gap`` apart."""
    timed = calls.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    timed = timed.withWatermark("ts", watermark) if timed.isStreaming else timed
    counted = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.least("n", F.lit(cap)).alias("admitted"))


#: A call: its time in microseconds, so that no time zone comes between.
CALL = "at long, event_id long, user_id long"


class _DayCaps(StatefulProcessor):
    """Keeps, of the calls of a day and a share of its visitors, those that would be admitted if no more came; hands them out when the day is over.

    A call that is out once stays out, since more calls only push others back: so no more than ``total`` calls are kept.
    """

    def __init__(self, per_visitor: int, total: int):
        self.per_visitor, self.total = per_visitor, total

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", CALL)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        known = {c[1]: tuple(c) for c in self.calls.get()}
        if not known:
            after = dt.datetime.combine(key[0] + dt.timedelta(days=1), dt.time(), dt.timezone.utc)
            self.handle.registerTimer(int(after.timestamp() * 1000))
        for frame in rows:
            known |= {i: (t, i, u) for t, i, u in zip(*(frame[c].tolist() for c in ("at", "event_id", "user_id")), strict=True)}
        kept, own = [], Counter()
        for call in sorted(known.values()):
            own[call[2]] += 1
            if own[call[2]] <= self.per_visitor:
                kept.append(call)
        self.calls.put(kept[: self.total])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        calls = [tuple(c) for c in self.calls.get()]
        self.calls.clear()
        yield pd.DataFrame({"day": [key[0]] * len(calls), **{name: [c[i] for c in calls] for i, name in enumerate(("at", "event_id", "user_id"))}})

    def close(self) -> None:
        pass


def closed_days(calls: DataFrame, watermark: str = "1 hour", per_visitor: int = X.PER_VISITOR_DAILY, total: int = X.GLOBAL_DAILY, shares: int = 32) -> DataFrame:
    """Of a stream of calls (ts, event_id, user_id): the first calls of each visitor's UTC day, at most ``total`` of each share of the visitors.

    They come when the watermark has passed the day's end, all of a day in one batch. Calls that come later than the watermark are
    dropped, those that come twice count once. Visitors are dealt into shares, so that a day is not one task's work.
    Needs the RocksDB state store.
    """
    timed = calls.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id")).where("ts is not null and event_id is not null and user_id is not null")
    keyed = timed.withWatermark("ts", watermark).withColumns({"day": F.to_date("ts"), "at": F.unix_micros("ts"), "share": F.pmod(F.xxhash64("user_id"), F.lit(shares))})
    closed = keyed.groupBy("day", "share").transformWithStateInPandas(_DayCaps(per_visitor, total), f"day date, {CALL}", "Append", "EventTime")
    return closed.select("day", F.timestamp_micros("at").alias("ts"), "event_id", "user_id")


def admit(batch: DataFrame, total: int = X.GLOBAL_DAILY) -> DataFrame:
    """The admitted calls of the days that a batch of ``closed_days`` holds: of all shares' first calls the first ``total``."""
    first = Window.partitionBy("day").orderBy("ts", "event_id")
    return batch.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= total).drop("_n")


def admit_stream(calls: DataFrame, path: str, checkpoint: str, watermark: str = "1 hour", per_visitor: int = X.PER_VISITOR_DAILY, total: int = X.GLOBAL_DAILY) -> StreamingQuery:
    """Write the admitted calls of every closed day below ``path``, a batch at a time; a batch that is repeated overwrites its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        admit(batch, total).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return closed_days(calls, watermark, per_visitor, total).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
