"""Filings that arrive as a stream replace theirs in the index when they are whole.

Beside the index lies the stream's own state, as numbered small files of which the highest counts: which version of each filing is in the index,
and under which name the chunks of filings that are not whole yet wait. A batch writes waiting chunks under a new name, changes the
index in one snapshot, and publishes its state last. A batch that failed anywhere is sent again and finds what was there before
it: nothing that waited is lost, and putting the same filings in twice changes no row.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumgrid.sources import index
from vellumgrid.sources.store import Store
from vellumgrid.sources.tables import keep

VERSION = ("company", "sha256")


def _state(spark: SparkSession, path: str) -> tuple[int, dict]:
    store = Store(spark, path)
    known = [n for n in store.names("stream") if n.endswith(".json") and n[0].isdigit()]
    return (int(known[-1].removesuffix(".json")), json.loads(store.read(f"stream/{known[-1]}"))) if known else (0, {"waiting": None, "filings": {}})


def _publish(spark: SparkSession, path: str, number: int, state: dict) -> None:
    store = Store(spark, path)
    passing = f"stream/_{uuid.uuid4().hex}"
    store.write(passing, json.dumps(state, sort_keys=True))
    if not store.rename(passing, f"stream/{number:012d}.json"):
        raise index.Conflict(f"state {number} of the stream into {path} exists")


def put_whole(batch: DataFrame, path: str) -> None:
    """Put the filings of a batch (chunks with their filing's sha256, n_chunks and, if known, arrived) that are whole by now into the index at ``path``.

    One version of a company is in the index: of those that are whole the one whose first chunk arrived last, of several the one of
    the largest sha256, and never one that arrived before the version in place. A chunk that comes twice counts once; a filing
    whose checksum is the one in the index changes nothing. Chunks of older versions stop waiting when a later one is in place.
    """
    spark = batch.sparkSession
    number, state = _state(spark, path)
    waiting = spark.read.schema(batch.schema).parquet(f"{path}/waiting/{state['waiting']}") if state["waiting"] else batch.limit(0)
    arrived = F.col("arrived").cast("string") if "arrived" in batch.columns else F.lit(None).cast("string")
    together = waiting.unionByName(batch).withColumn("_arrived", arrived)
    in_place = spark.createDataFrame([(c, *v) for c, v in state["filings"].items()], "company string, known_sha256 string, known_arrived string")
    once = keep(together.dropDuplicates([*VERSION, "fiscal_year", "page", "chunk"]))
    versions = once.groupBy(*VERSION).agg(F.count("*").alias("n"), F.max("n_chunks").alias("wanted"), F.min("_arrived").alias("at")).join(in_place, "company", "left")
    outdated = (F.col("sha256") == F.col("known_sha256")) | (F.col("at") < F.col("known_arrived"))
    versions = keep(versions.withColumn("outdated", F.coalesce(outdated, F.lit(False))))
    best = versions.where("n >= wanted and not outdated").groupBy("company").agg(F.max(F.struct("at", "sha256")).alias("v")).select("company", "v.sha256", "v.at")
    # A row for each filing of the batch that is whole.
    chosen = [tuple(r) for r in best.collect()]
    whole = spark.createDataFrame(chosen, "company string, chosen_sha256 string, chosen_at string")
    left = versions.join(whole, "company", "left").where("not outdated and n < wanted").where("chosen_at is null or at is null or at > chosen_at").select(*VERSION)
    rest = once.join(left, list(VERSION), "left_semi").drop("_arrived")
    name = None
    if not left.isEmpty():
        name = uuid.uuid4().hex
        rest.select(*batch.columns).write.mode("errorifexists").parquet(f"{path}/waiting/{name}")
    if chosen:
        new = once.join(whole.select("company", F.col("chosen_sha256").alias("sha256")), list(VERSION), "left_semi")
        index.replace_filings(new.drop("sha256", "n_chunks", "arrived", "_arrived"), path)
    _publish(spark, path, number + 1, {"waiting": name, "filings": state["filings"] | {c: [sha, at] for c, sha, at in chosen}})
    # What no state names any more; a failure here leaves it to the next batch.
    store = Store(spark, path)
    for old in store.names("waiting"):
        if old != name:
            store.delete(f"waiting/{old}")
    for old in store.names("stream")[:-1]:
        if old < f"{number + 1:012d}.json":
            store.delete(f"stream/{old}")


def upsert_filings(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch through ``put_whole``; a repeated batch changes nothing."""
    return chunks.writeStream.foreachBatch(lambda batch, _: put_whole(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
