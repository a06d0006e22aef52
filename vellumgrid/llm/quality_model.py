"""Quality classifier: hashed word n-grams and logistic regression learnt by follow the regularised leader.

Texts are cut into runs of letters and digits (any byte of a non-ASCII character counts as a letter)
and runs of symbols; A-Z is folded. Features are the hashes of single runs and of adjacent pairs; a
pair of equal runs is one feature of its own, whatever the run is. A document's vector holds each
feature's share of its runs, so that a score is a sparse dot product of bounded size.

Learning uses at most ``sample`` distinct labelled texts, those with the smallest hashes; they are learnt one
after another in the order of that hash, so that the same table gives the same model. Neither ids nor other columns
enter the draw, the order or a score. Scoring covers every row and every whole text.

Rows with a null label do not teach; of several labels of one id, or of one text, the smallest counts, so there are no
ties, and repeated rows teach once. Null, empty and blank texts get the score of the bias alone; without any labelled
row every score is 0.5. An empty table gives an empty one. A text may be of any length: its vector is bounded by the
number of features and its words are hashed in blocks. Other columns, whatever their names, are dropped at once
unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm._arrow import column, columns, slices
from vellumgrid.llm._words import U, buffers, mix, span_hashes, spans

BITS = 18
#: Distinct texts learnt from, at most.
SAMPLE = 8000
#: Shares are multiplied by this before the dot product.
SCALE = 8.0

KINDS = np.full(256, 2, dtype=np.uint8)
KINDS[[0x20, *range(0x09, 0x0E)]] = 0
KINDS[0x30:0x3A] = KINDS[0x41:0x5B] = KINDS[0x61:0x7B] = KINDS[0x80:] = 1


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    epochs: int = 3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all documents, one after another, and each document's first."""
    data, offsets = buffers(texts)
    starts, ends, first = spans(data, offsets, KINDS)
    words = span_hashes(data, starts, ends, lower=True)
    pairs = mix(words * U(0x9FB21C651E98DF25) + np.roll(words, -1))
    pairs[words == np.roll(words, -1)] = U(0x5851F42D4C957F2D)
    out = np.empty((len(words), 2), dtype=np.int32)
    out[:, 0] = words >> U(64 - BITS)
    out[:, 1] = pairs >> U(64 - BITS)
    # The last run of a document has no successor: its own feature stands twice.
    last = first[1:][first[1:] > first[:-1]] - 1
    out[last, 1] = out[last, 0]
    return out.reshape(-1), first * 2


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> np.ndarray:
    """Weights after ``epochs`` passes; the last weight is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where(np.abs(zs) <= s.l1, 0.0, w)

    for _ in range(s.epochs):
        for label, at, x in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(size)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, label: str = "quality", sample: int = SAMPLE, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> np.ndarray | None:
    """Weights learnt from those labelled documents for which ``teaches`` (over the label table) holds."""
    known = labels.where(teaches).select(column(labels, id_col).alias("id"), column(labels, label).cast("int").alias("label")).where("label is not null and id is not null")
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    texts = columns(docs, id=id_col, text=text_col).withColumn("turn", F.xxhash64("text"))
    # The drawn rows are bounded by the parameter, not by the table, so they can be sent everywhere.
    drawn = texts.select("id", "turn").join(known, "id").groupBy("turn").agg(F.min("label").alias("label")).orderBy("turn").limit(sample)
    rows = texts.select("turn", "text").join(F.broadcast(drawn), "turn").groupBy("turn", "label").agg(F.max("text").alias("text")).select("label", "turn", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            at, first = features(part.column(2))
            out_at, out_x = [], []
            for i, j in zip(first[:-1], first[1:], strict=True):
                f, c = np.unique(at[i:j], return_counts=True)
                out_at.append(np.append(f, 1 << BITS).astype(np.int32).tobytes())
                out_x.append(np.append(c * (SCALE / max(1, j - i)), 1.0).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out_at, pa.binary()), pa.array(out_x, pa.binary())], names=["label", "turn", "at", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for b in batches for y, a, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([learn(rows, settings).tobytes()], pa.binary())], names=["weights"])

    found = rows.mapInArrow(vectors, "label int, turn long, at binary, x binary").repartition(1).sortWithinPartitions("turn", "at", "label").mapInArrow(train, "weights binary").collect()
    return np.frombuffer(bytes(found[0][0]), np.float32) if found else None


def score(docs: DataFrame, weights: np.ndarray | None, threshold: float = 0.7, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score and predicted (1 if score >= threshold) of every row, with the columns in ``keep``."""
    extra = {f"keep{i}": name for i, name in enumerate(keep)}
    frame = columns(docs, id=id_col, text=text_col, **extra)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "text" or text_col in keep)
    at_text = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in slices(batches, "text"):
            n = part.num_rows
            if w is None:
                total = np.zeros(n)
            else:
                at, first = features(part.column(at_text))
                sums = np.concatenate(([0.0], np.cumsum(w[at], dtype=np.float64)))
                total = w[-1] + SCALE * (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first))
            p = 1 / (1 + np.exp(-total))
            names = [x for x in part.schema.names if x != "text" or text_col in keep]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(x)) for x in names), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=[*names, "score", "predicted"])

    out = frame.mapInArrow(run, f"{schema}, score double, predicted int")
    return out.select(F.col("id").alias(id_col), *(F.col(a).alias(n) for a, n in extra.items() if n not in {id_col}), "score", "predicted")
