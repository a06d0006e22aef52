"""The corpus queries against their SQL, and the pipeline against a plain version of itself."""

from __future__ import annotations

import base64
import re
from array import array

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from vellumgrid.llm import oracle, quality_model, queries
from tests.llm.test_dedup import near_groups, without_repeats
from tests.llm.test_native import contaminated
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(queries.QUERIES[name], oracle.ORACLE_SQL[name], spark, SF, connect(SF)) > 0


def test_queries_return_every_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_sharding", "op4_quality", "op5_language", "op7_token_counts", "op9_byte_bpe"):
        rows = queries.QUERIES[name](spark, SF).collect()
        assert len(rows) == n == len({r["doc_id"] for r in rows})


def test_held_out_accuracy(spark):
    """Learnt without them, held-out languages and qualities are found again."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op5_language(spark, sf).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got >= 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op4_quality(spark, sf).where("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) >= 0.94 * len(rows)


def plain_pipeline(spark):
    """The same stages over a Python list; the classifier's verdicts are taken from its own scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    good = {r["doc_id"] for r in quality_model.score(docs, weights).where("score >= 0.7").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good)
    first = {i for (i, _, _, kept) in near_groups(rows, 80) if kept}
    rows = [r for r in rows if r[0] in first]
    cut = {}
    for i, n, removed, kept in without_repeats(rows):
        cut[i] = (n, removed, kept)
    rows = [(i, t if cut[i][1] == 0 else cut[i][2]) for i, t in rows if cut[i][1] == 0 or cut[i][1] < cut[i][0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for (i, _, hit, _) in contaminated(rows, items) if not hit}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {i: array("I", coder.encode_ordinary(t)).tobytes() for i, t in rows if i in clean}


def test_pipeline_equals_plain_version(spark):
    got = {r["doc_id"]: bytes(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == plain_pipeline(spark) and 0 < len(got) < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_take_hard_rows(spark, hard, tmp_path):
    """Nulls, copies, long texts and clashing columns pass through every stage; the columns stay those of documents."""
    docs = hard
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        docs = docs.withColumns({"id": F.lit(1), "key": F.lit("k"), "twin": F.lit(2)}) if name != "tokens" else docs
    assert docs.count() > 0


def test_stages_take_no_rows(spark, none, tmp_path):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(*corpus_pipeline.COLUMNS), SF).count() == 0


def test_stage_names():
    assert [re.sub(r"\W", "", n) for n, _ in corpus_pipeline.STAGES] == ["quality", "near", "repeats", "benchmark", "tokens"]
