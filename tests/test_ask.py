from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import models
from vellumgrid.plans import ask
from vellumgrid.sources import index

DIM = 512


class Quoter:
    """Answers with the first figure of its first extract, cited; says so if there is none."""

    def generate(self, question: str, prompt: str) -> str:
        page = prompt.split("page ")[1].split(",")[0]
        figure = next((w for w in prompt.split() if w[0].isdigit() and "." in w), None)
        return f"It was {figure} crore [page {page}]." if figure else X.REFUSAL


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = [
        ("BEL", 1, 0, "standalone", "total assets at the year end 8,743.37"), ("BEL", 1, 1, "standalone", "total liabilities 1,111.25"), ("BEL", 2, 0, "consolidated", "total assets of the group 9,999.99"),
        ("BEL", 3, 0, "unstated", "the chairman writes of radar and ships"), ("HCC", 1, 0, "standalone", "total assets 5.25 of another company"),
    ]
    df = spark.createDataFrame([(c, "FY25", p, k, s, 10, t) for c, p, k, s, t in rows], "company string, fiscal_year string, page int, chunk int, scope string, tokens int, text string")
    path = str(tmp_path_factory.mktemp("index") / "i")
    index.write_index(df.withColumn("vector", models.embed(F.col("text"), lambda: models.HashEmbedder(DIM), DIM)), path, "hash", DIM)
    return index.open_index(spark, path, "hash")


def asked(spark, *rows):
    return spark.createDataFrame(rows, "question_id string, question string, company string")


def make():
    return models.HashEmbedder(DIM)


@pytest.mark.parametrize("hybrid", [True, False])
def test_search_stays_in_its_filing_and_scope(spark, built, hybrid):
    got = ask.search(built, asked(spark, ("a", "What were BEL standalone total assets?", "BEL"), ("b", "total assets", None)), make, DIM, k=8, hybrid=hybrid).orderBy("question_id", "rank").collect()
    mine = [r for r in got if r["question_id"] == "a"]
    assert {(r["company"], r["page"]) for r in mine} == {("BEL", 1), ("BEL", 3)} and mine[0]["text"].startswith("total assets at")
    assert len({(r["company"], r["page"], r["chunk"]) for r in got if r["question_id"] == "b"}) == 5


def test_stored_terms_and_blocks_give_the_same(spark, built, tmp_path, monkeypatch):
    q = asked(spark, ("a", "What were BEL standalone total assets?", "BEL"), ("b", "total assets", None), ("c", "consolidated total assets of the group", "BEL"), ("d", "radar and ships", "HCC"))
    rows = lambda **kw: sorted((r["question_id"], r["rank"], r["company"], r["page"], r["chunk"], round(r["rrf"], 9), round(r["score"], 6)) for r in ask.search(built, q, make, DIM, k=8, **kw).collect())
    plain = rows()
    index.write_index(built, str(tmp_path / "i"), "hash", DIM)
    assert rows(stored=index.open_text_index(spark, str(tmp_path / "i"))) == plain
    monkeypatch.setattr("vellumgrid.operators.search.BROADCAST_BYTES", -1)
    monkeypatch.setattr("vellumgrid.operators.search.BLOCK_ROWS", 2)
    assert rows() == plain


def test_no_question_meets_a_foreign_filing(spark, built):
    plan = ask.search(built, asked(spark, ("a", "total assets", "BEL")), make, DIM)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin BuildRight, Inner, (" not in plan


def test_answers_are_guarded(spark, built):
    got = {r["question_id"]: r for r in ask.ask(built, asked(spark, ("a", "standalone total assets at the year end", "BEL"), ("z", "zebra quagga", "BEL")), make, DIM, Quoter, floor=0.4).collect()}
    assert got["a"]["text"] == "It was 8,743.37 crore [page 1]." and not got["a"]["ungrounded"]
    assert got["z"]["refused"] and "below the 0.4 floor" in got["z"]["reason"]
    narrow = ask.ask(built, asked(spark, ("a", "standalone total assets at the year end", "BEL")), make, DIM, Quoter, floor=0.4, widen=False).first()
    assert narrow["text"] == got["a"]["text"]


def test_embedders_are_checked(spark):
    with pytest.raises(Exception, match="the embedder gave"):
        spark.createDataFrame([("a",)], "t string").select(models.embed(F.col("t"), make, DIM + 1)).collect()


def test_overlap_score(spark):
    r = spark.createDataFrame([("total assets now", "Total assets: 5")], "q string, t string").select(models.overlap_score(F.col("q"), F.col("t"))).first()[0]
    assert round(r, 6) == round(2 / 3, 6)
