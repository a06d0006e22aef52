"""Where models plug in: embedder, cross-encoder, generator and judge, each made once in a worker process.

Everything between the models is deterministic. ``HashEmbedder`` is a stand-in that needs no weights; its
similarities mean shared words and nothing more.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions.text import tokens
from vellumgrid.sources.tables import keep

#: Bytes up to which a counted table is sent to every executor.
BROADCAST_BYTES = 48 << 20
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def rerank(self, question: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, question: str, prompt: str) -> str: ...


class HashEmbedder:
    """Each word adds a fixed random direction."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in re.findall(r"[^\W_]+", text.lower().removeprefix(QUERY_INSTRUCTION.lower())):
                seed = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "little")
                out[i] += np.random.default_rng(seed).standard_normal(self.dim)
        return out


def embed(text: Column, make: Callable[[], Embedder], dim: int) -> Column:
    """Unit vectors of ``dim`` numbers; another shape, or a vector without direction, is an error or null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            vectors = np.asarray(model.embed([t or "" for t in texts]), dtype=np.float64)
            if vectors.shape != (len(texts), dim):
                raise ValueError(f"the embedder gave {vectors.shape}, not {(len(texts), dim)}")
            norms = np.linalg.norm(vectors, axis=1)
            yield pd.Series([(v / n).astype(np.float32) if n else None for v, n in zip(vectors, norms, strict=True)])

    return run(text)


def rerank_score(question: Column, text: Column, make: Callable[[], Reranker]) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for questions, texts in batches:
            # One call for each question of a batch.
            out = np.empty(len(texts))
            for _, at in questions.reset_index(drop=True).groupby(questions.reset_index(drop=True), sort=False, dropna=False):
                out[at.index] = model.rerank(at.iloc[0], [texts.iloc[i] for i in at.index])
            yield pd.Series(out, dtype="float64")

    return run(question, text)


def generate(prompts: DataFrame, make: Callable[[], Generator], most: int | None = None) -> DataFrame:
    """question_id and raw for rows of question_id, question and prompt; only rows passed in are paid for, and with ``most`` the first of them."""
    if most is not None:
        prompts = within_budget(prompts, most, "question_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            ids, questions, texts = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([model.generate(q, t) for q, t in zip(questions, texts, strict=True)], pa.string())], names=["question_id", "raw"])

    return prompts.select(F.col("question_id").cast("string"), "question", "prompt").mapInArrow(run, "question_id string, raw string")


class Judge(Protocol):
    def judge(self, question: str, expected: str, answer: str, context: str) -> str: ...


VERDICT = "correct boolean, faithful boolean, computed array<struct<labelled:boolean,arithmetic_right:boolean>>"


def judge(samples: DataFrame, make: Callable[[], Judge]) -> DataFrame:
    """question_id, sample and the judge's verdict for rows of these with question, expected, text and context.

    The judge answers in JSON; what does not parse is an error, and its own list of computed figures overrules
    its word on faithfulness.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            ids, numbers, *rest = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int32()), pa.array([model.judge(*x) for x in zip(*rest, strict=True)], pa.string())], names=["question_id", "sample", "raw"])

    asked = samples.select(F.col("question_id").cast("string"), F.col("sample").cast("int"), "question", "expected", "text", "context").mapInArrow(run, "question_id string, sample int, raw string")
    read = asked.withColumn("v", F.from_json("raw", VERDICT, {"mode": "FAILFAST"}))
    own = F.coalesce("v.computed", F.array().cast("array<struct<labelled:boolean,arithmetic_right:boolean>>"))
    return read.select("question_id", "sample", "v.correct", judged_faithful(F.col("v.faithful"), own).alias("faithful"))


def judged_faithful(faithful: Column, computed: Column) -> Column:
    """A judge's verdict, overruled by its own list of computed figures (structs labelled, arithmetic_right)."""
    return faithful & ~F.exists(computed, lambda c: ~c["labelled"] | ~c["arithmetic_right"])


class CallLimit(Exception):
    """A budget of model calls is spent."""


def within_budget(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` rows by ``order``, which names a row: what a job may ask a model, however many tasks it has.

    The rows are chosen before any call, by a top-k that no task holds more than ``most`` rows of; all tasks together spend one
    budget, and a task that is run again asks for its own rows only.
    """
    first = keep(rows.select(*order).orderBy(*order).limit(most))
    return rows.join(F.broadcast(first) if most * 64 <= BROADCAST_BYTES else first, list(order), "left_semi")


class Budgeted:
    """A generator that may be asked ``most`` times, counted before each call, by one loop on one machine; for a job see ``within_budget``."""

    def __init__(self, generator: Generator, most: int, before_call: Callable[[int], None] = lambda n: None):
        self.generator, self.most, self.before_call, self.n = generator, most, before_call, 0

    def generate(self, question: str, prompt: str) -> str:
        if self.n >= self.most:
            raise CallLimit(f"{self.most} calls are spent")
        self.before_call(self.n)
        self.n += 1
        return self.generator.generate(question, prompt)


def overlap_score(question: Column, text: Column) -> Column:
    """A reranker without a model: the share of a question's terms that a text holds."""
    asked = F.array_distinct(tokens(question))
    return F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.size(asked), F.lit(1))
