"""A partitioned vector index: cells around learnt centroids, of which a question reads only the nearest.

Centroids come from spherical k-means over a bounded sample, the rows with the smallest hashes of their keys (``SAMPLE``); every row is then
assigned to the centroid it has the largest cosine with. A question probes the cells whose centroids it has the largest dot products with,
as many as the sample needed for ``RECALL``, and is ranked there by exact dot products. ``search.vector_topk`` without cells remains
the exact search. Rows without a vector, or with one of zeros, are in cell 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.operators.search import _matrix, vector_topk

#: Rows that the centroids and the number of probes are learnt from, at most, and questions among them.
SAMPLE, ASKING = 20_000, 500
#: Share of the exact neighbours that the probed cells of the sample's own questions have to hold.
RECALL = 0.95
STEPS = 15


@dataclass(frozen=True)
class Cells:
    centroids: np.ndarray  # unit rows
    probes: int

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        scores = vectors @ self.centroids.T
        return np.argsort(-scores, axis=1, kind="stable")[:, :n]


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def _kmeans(points: np.ndarray, n: int) -> np.ndarray:
    """Unit centroids; the first are spread, each far from those before it."""
    chosen, far = [0], 1 - points @ points[0]
    while len(chosen) < n and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - points @ points[chosen[-1]])
    centroids = points[chosen]
    for _ in range(STEPS):
        own = (points @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        moved = _unit(np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, centroids))
        if np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved
    return centroids


def fit(rows: DataFrame, cells: int | None = None, k: int = X.FUSION_DEPTH, sample: int = SAMPLE, recall: float = RECALL, key: str = "key", vector: str = "vector") -> Cells:
    """Learn centroids (the square root of the number of rows, unless said) and how many cells a question has to probe for its k nearest."""
    usable = rows.where(F.col(vector).isNotNull())
    total = usable.count()
    drawn = usable.select(F.col(vector).alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(sample).toArrow()
    if not drawn.num_rows:
        return Cells(np.zeros((1, 1)), 1)
    raw = _matrix(drawn.column("v").combine_chunks())
    centroids = _kmeans(_unit(raw), min(len(raw), cells or max(1, math.isqrt(total))))
    own = Cells(centroids, len(centroids))
    asking = raw[:ASKING]
    # As far down in the sample as the k-th of all rows is in the table.
    depth = max(1, min(len(raw), math.ceil(k * len(raw) / total)))
    best = np.argsort(-(asking @ raw.T), axis=1, kind="stable")[:, :depth]
    cell = own.nearest(_unit(raw), 1)[:, 0]
    place = np.argsort(own.nearest(asking, len(centroids)), axis=1)  # of each cell in a question's order
    needed = np.sort(np.take_along_axis(place, cell[best], axis=1).reshape(-1))
    return Cells(centroids, int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1)


def assign(rows: DataFrame, cells: Cells, key: str = "key", vector: str = "vector") -> DataFrame:
    """Every row with its ``cell``."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(names.index(vector))
            own = np.zeros(batch.num_rows, dtype=np.int64)
            there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            if len(there):
                own[there] = cells.nearest(_unit(_matrix(vectors.take(pa.array(there)))), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([str(c) for c in own], pa.string())], names=[*names, "cell"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, cell string")


def write(rows: DataFrame, cells: Cells, path: str, vector: str = "vector") -> None:
    """The assigned rows by cell, so that a probe reads its cells' files alone, and the centroids."""
    spark = rows.sparkSession
    assign(rows, cells, vector=vector).hint("rebalance", "cell").write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist(), cells.probes) for i, c in enumerate(cells.centroids)], "cell int, centroid array<double>, probes int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/centroids")


def open_cells(spark, path: str) -> tuple[DataFrame, Cells]:
    found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return spark.read.parquet(f"{path}/rows").withColumn("cell", F.col("cell").cast("string")), Cells(np.array([r["centroid"] for r in found]), found[0]["probes"])


def probed(queries: DataFrame, cells: Cells, query: str = "question_id", vector: str = "vector", probes: int | None = None) -> DataFrame:
    """question_id, vector and cell: a row for each cell that a question probes."""
    n = min(len(cells.centroids), probes or cells.probes)
    asked = queries.select(F.col(query).alias("q"), F.col(vector).alias("v")).where("v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = cells.nearest(_matrix(batch.column(1)), n)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[str(c) for c in row] for row in near], pa.list_(pa.string()))], names=["q", "v", "cells"])

    kinds = dict(asked.dtypes)
    near = asked.mapInArrow(run, f"q {kinds['q']}, v {kinds['v']}, cells array<string>")
    return near.select(F.col("q").alias(query), F.col("v").alias(vector), F.explode("cells").alias("cell"))


def search(assigned: DataFrame, queries: DataFrame, cells: Cells, k: int = X.FUSION_DEPTH, probes: int | None = None, key: str = "key", vector: str = "vector", query: str = "question_id") -> DataFrame:
    """question_id, key, score and rank of the k nearest rows of the probed cells; a row meets only the questions that probe its cell."""
    return vector_topk(assigned, probed(queries, cells, query, vector, probes), k, key, vector, query, company="cell", of="cell")
