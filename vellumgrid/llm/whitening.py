"""Embedding whitening by Chan's merging of moments.

Vectors are quantised to whole numbers, x = floor(scale * c), so that counts, sums and deviations are exact. The model is fitted to
every distinct x once:

1. Each partition computes its count, sums, local mean and centred scatter, batch by batch; Chan's formula merges two such
   moments without ever forming raw products, within a task and between tasks by ``treeReduce``.
2. The driver, which gets one d x d matrix however many rows there are, takes the eigenvectors of the covariance (divisor n).
3. A second pass over the same vectors projects them and merges the moments of the result the same way: the largest entry of its
   covariance less the identity is the model's ``identity_error``.

Vectors that are null or hold a null or an entry that is not finite take no part and are not returned. All others must have
one length to be whitened together: that of most distinct vectors (of several, the longest) is taken, others are not returned. Products
beyond a long's range are cut to it. Null ids and ids that repeat are answered row by row; equal vectors count once in the fit,
so hot copies change nothing. Components without variance (fewer distinct vectors than dimensions) cannot be whitened and are
left out; with one distinct vector, or none, the result is empty. Equal eigenvalues keep the solver's order; of a component's two signs the one that makes
its largest entry positive is taken. Deviations beyond a long are null. Other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm._arrow import columns, release
from vellumgrid.llm._tables import keep

SCALE = 256
COMPONENTS = 4
LONG = 2**63


@dataclass(frozen=True)
class Moments:
    n: int
    sums: list[int]  # exact; empty where only the floating moments are asked for
    mean: np.ndarray
    scatter: np.ndarray  # sum of (x - mean)(x - mean)^T

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        if rows.dtype == np.int64:
            most = int(np.abs(rows.astype(np.float64)).max(initial=0)) + 1
            sums = (rows if most * len(rows) < LONG else rows.astype(object)).sum(0).tolist()
        else:
            sums = []
        wide = rows.astype(np.float64)
        mean = wide.mean(0)
        centred = wide - mean
        return Moments(len(rows), sums, mean, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        delta = other.mean - self.mean
        mean = self.mean + delta * (other.n / n)
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], mean, scatter)


@dataclass(frozen=True)
class Model:
    n: int
    sums: list[int]
    components: np.ndarray  # d x k, unit columns
    values: np.ndarray  # k eigenvalues, falling
    explained: np.ndarray  # k shares of the trace
    identity_error: float = 0.0

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        centre = np.array([s / self.n for s in self.sums])
        return (rows.astype(np.float64) - centre) @ (self.components / np.sqrt(self.values))

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2, exact; null beyond a long."""
        most = self.n * int(np.abs(rows.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums)) + self.n
        if rows.shape[1] * most * most < LONG:
            return ((self.n * rows - np.array(self.sums, dtype=np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * rows.astype(object) - np.array(self.sums, dtype=object)) ** 2).sum(1)
        return [int(v) if v < LONG else None for v in exact.tolist()]


def quantise(vector: Column, scale: int = SCALE) -> Column:
    """Whole numbers; null if the vector is null, empty, or has an entry that is null or not finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(finite & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)).cast("long")))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of one length."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 0), dtype=np.int64)


def moments(vectors: DataFrame, project: Model | None = None) -> Moments:
    """Moments of the column x of a table that has rows, of one length each; with ``project`` those of the whitened vectors."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(0))
                own = Moments.of(rows if project is None else project.whiten(rows))
                total = own if total is None else total.merge(own)
        release()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["moments"])

    return vectors.select("x").mapInArrow(partition, "moments binary").rdd.map(lambda r: pickle.loads(r[0])).treeReduce(Moments.merge)


def fit(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vector_col: str = "embedding") -> Model | None:
    """The model of a table's distinct vectors; None if there are no two different ones."""
    x = columns(table, v=vector_col).select(quantise(F.col("v"), scale).alias("x")).where("x is not null")
    # Equal vectors meet here once from each task, however many there are.
    distinct = keep(x.distinct())
    width = distinct.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if width is None or width["count"] < 2:
        return None
    fitted = distinct.where(F.size("x") == width["width"])
    found = moments(fitted)
    values, vectors = np.linalg.eigh(found.scatter / found.n)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > values.max() * len(values) * np.finfo(np.float64).eps]
    own = vectors[:, order]
    own = own * np.where(own[np.abs(own).argmax(0), np.arange(own.shape[1])] < 0, -1.0, 1.0)
    model = Model(found.n, found.sums, own, values[order], values[order] / np.trace(found.scatter / found.n))
    check = moments(fitted, model)
    error = np.abs(check.scatter / check.n - np.eye(len(order))).max()
    return Model(model.n, model.sums, model.components, model.values, model.explained, float(error))


def whiten(table: DataFrame, model: Model | None, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, deviation and whitened (one number for each component) of every usable row."""
    frame = columns(table, id=id_col, v=vector_col).select("id", quantise(F.col("v"), scale).alias("x"))
    width = len(model.sums) if model else -1
    frame = frame.where(F.col("x").isNotNull() & (F.size("x") == width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviations(rows), pa.int64()), pa.array(list(model.whiten(rows)), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])
        release()

    return frame.mapInArrow(run, f"id {dict(frame.dtypes)['id']}, deviation long, whitened array<double>").withColumnRenamed("id", id_col)
