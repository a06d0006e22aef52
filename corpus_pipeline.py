"""A corpus from raw documents to token identifiers, in stages that each call one operator.

Every stage works on all rows its predecessor kept and, but for the last, returns the columns of
``documents``. Null and blank texts: the quality model decides on them by its bias alone; they are no
one's near duplicate, hold no repeat and no benchmark window, and encode to no tokens. Ties go to the smallest
doc_id, repeated rows stay together (all or none of a doc_id's equal rows go), texts may be of any length that a task
holds, and columns other than those of ``documents``, whatever their names, are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import bpe, decontaminate, near_dedup, quality_model, substring_dedup
from vellumgrid.llm._tables import BROADCAST_BYTES, keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, learnt from all labels, scores below 0.7."""
    weights = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    scored = quality_model.score(docs, weights, threshold=0.7, keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near duplicates.

    Five-word shingles at a similarity of 0.8 or more. Repeated rows of one id stay together.
    """
    out = keep(near_dedup.near_duplicates(docs, percent=80).where(~F.col("kept")).select("doc_id").distinct())
    drop = F.broadcast(out) if out.count() * 16 <= BROADCAST_BYTES else out
    return docs.select(*COLUMNS).join(drop, "doc_id", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the words of 50-word windows that repeat an earlier document.

    A text that loses words becomes its other words joined by single spaces, with n_chars to match;
    a document that loses all its words goes. Texts without repeats stay as they are.
    """
    cut = substring_dedup.remove_repeats(docs, window=50, keep_cols=("lang", "source", "n_chars"))
    whole = F.col("n_removed") == 0
    text = F.when(whole, F.col("text")).otherwise(F.col("kept_text"))
    length = F.when(whole, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return cut.where(whole | (F.col("n_removed") < F.col("n_words"))).select("doc_id", text.alias("text"), "lang", "source", length.alias("n_chars"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark window (or a whole item that is shorter than one)."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text; a row has its identifiers, and whether they decode to the same bytes."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_cols=("lang", "source", "n_chars"))
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near", near), ("repeats", repeats), ("benchmark", benchmark), ("tokens", tokens)]

#: The classifier and the encoder cannot be expressed in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
