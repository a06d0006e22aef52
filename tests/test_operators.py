from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.operators import chunking, evals, evidence, guard, holdings, layout, search
from vellumgrid.plans import derived


def hits_of(spark, rows):
    return spark.createDataFrame([("q", "AAA", "FY25", *r) for r in rows], "question_id string, company string, fiscal_year string, page int, chunk int, tokens int, rank int")


def packed(spark, seeds, budget, chunks=None):
    chunks = chunks or [(p, c, 100) for p in (10, 20) for c in range(4)]
    index = spark.createDataFrame([("AAA", "FY25", *c) for c in chunks], "company string, fiscal_year string, page int, chunk int, tokens int")
    return [(r["page"], r["chunk"], r["sibling"]) for r in search.pack_context(hits_of(spark, seeds), index, budget=budget).orderBy("position").collect()]


def test_strong_page_wins(spark):
    got = packed(spark, [(10, 0, 100, 1), (20, 0, 100, 2)], 500)
    assert got == [(10, 0, False), (10, 1, True), (10, 2, True), (10, 3, True), (20, 0, False)]


def test_nothing_fits(spark):
    assert packed(spark, [(10, 0, 100, 1), (20, 0, 100, 2)], 50) == []


def test_small_seed_after_large_one(spark):
    chunks = [(10, 0, 400), (10, 1, 30), (20, 0, 90)]
    assert packed(spark, [(10, 0, 400, 1), (20, 0, 90, 2)], 120, chunks) == [(10, 1, True), (20, 0, False)]


def test_mixed_filings_are_an_error(spark):
    hits = hits_of(spark, [(10, 0, 100, 1)]).unionByName(hits_of(spark, [(20, 0, 100, 2)]).withColumn("company", F.lit("BBB")))
    index = spark.createDataFrame([("AAA", "FY25", 10, 0, 100)], "company string, fiscal_year string, page int, chunk int, tokens int")
    with pytest.raises(Exception, match="one filing"):
        search.pack_context(hits, index).collect()


def test_fusion(spark):
    a = spark.createDataFrame([("q", "A", 1), ("q", "B", 2)], "question_id string, key string, rank int")
    b = spark.createDataFrame([("q", "B", 1), ("q", "C", 2)], "question_id string, key string, rank int")
    got = [(r["key"], round(r["rrf"], 6)) for r in search.fuse(a, b).orderBy("rank").collect()]
    assert got == [("B", round(1 / 62 + 1 / 61, 6)), ("A", round(1 / 61, 6)), ("C", round(1 / 62, 6))]


def test_scope_filter(spark):
    rows = spark.createDataFrame([("A", s) for s in ("standalone", "consolidated", "mixed", "unstated")] + [("B", "standalone")], "company string, scope string")
    assert {r["scope"] for r in search.in_scope(rows, "A", "standalone").collect()} == {"standalone", "mixed", "unstated"}
    with pytest.raises(ValueError):
        search.in_scope(rows, "A", "both")


def page(spark, rows, **more):
    df = spark.createDataFrame([("C", "FY25", 1, "\n".join(rows))], "company string, fiscal_year string, page long, text string")
    return chunking.page_context(df).withColumns({k: F.lit(v) for k, v in more.items()})


@pytest.mark.parametrize("unit", ["(All amounts are in Rs. Lakhs, except otherwise stated)", "(₹ in thousands)", "₹ in Millions", "Rupees crores", "(000s omitted)"])
def test_every_chunk_has_its_unit(spark, unit):
    rows = ["Standalone Balance Sheet", unit, "As at March 31, 2025 | As at March 31, 2024"] + [f"Item number {i} of the table | {i},234.56 | {i},111.22" for i in range(40)]
    chunks = [r["text"] for r in chunking.chunk_pages(page(spark, rows)).orderBy("chunk").collect()]
    assert len(chunks) > 1
    assert all(unit in c and "Standalone Balance Sheet" in c and "As at March 31, 2025" in c for c in chunks)
    assert all(r["tokens"] <= X.CHUNK_TOKENS for r in chunking.chunk_pages(page(spark, rows)).collect())
    assert [r for c in chunks for r in c.split("\n") if r.startswith("Item")] == rows[3:]


def test_new_header_closes_the_chunk(spark):
    rows = ["As at March 31, 2025 | As at March 31, 2024", "A | 1.5 | 2.5", "year ended March 31, 2025 | year ended March 31, 2024", "B | 3.5 | 4.5"]
    assert [r["text"] for r in chunking.chunk_pages(page(spark, rows)).orderBy("chunk").collect()] == ["\n".join(rows[:2]), "\n".join(rows[2:])]


def test_prose_overlaps_and_leaders_go(spark):
    rows = [f"Sentence {i} runs on over several words here" for i in range(40)] + ["Stores consumed" + "." * 500 + " | 689.42 | 540.88"]
    chunks = [r["text"] for r in chunking.chunk_pages(page(spark, rows)).orderBy("chunk").collect()]
    assert all(set(a.split("\n")) & set(b.split("\n")) for a, b in zip(chunks[:-1], chunks[1:], strict=True))
    assert "...." not in "".join(chunks) and "689.42 | 540.88" in chunks[-1]


def test_excluded_pages_have_no_chunks(spark):
    assert chunking.chunk_pages(page(spark, ["a b c"], excluded="few")).count() == 0


CONTEXT = [(114, "TOTAL ASSETS | 8,743.37 | 6,111.25"), (98, "Revenue | 146.98"), (98, "Costs | 11,146.51")]


def verdict(spark, raw, score=0.9, context=CONTEXT):
    a = spark.createDataFrame([("q", raw)], "question_id string, raw string")
    h = spark.createDataFrame([("q", score)], "question_id string, score double")
    c = spark.createDataFrame([("q", p, t) for p, t in context], "question_id string, page int, text string")
    return guard.guarded_answers(a, h, c).first()


def test_wrong_page_is_moved(spark):
    r = verdict(spark, "Assets were 8,743.37 crore [page 6].")
    assert r["text"] == "Assets were 8,743.37 crore [page 114]." and [(x["cited"], x["page"]) for x in r["recited"]] == [([6], 114)] and not r["invalid_citations"]


def test_unprinted_figures_are_flagged(spark):
    r = verdict(spark, "It fell by 1,234.56 crore [page 98].")
    assert not r["refused"] and [(x["figure"], x["pages"]) for x in r["ungrounded"]] == [("1,234.56", [98])]


def test_computed_label_exempts_its_claim(spark):
    assert verdict(spark, "It fell by 1,234.56 crore [page 98]. (computed from [page 98])")["ungrounded"] == []


def test_tail_is_held_to_all_cited_pages(spark):
    r = verdict(spark, "Revenue 146.98 [page 98] and assets [page 114]. Also 11,146.51 and 9,999.99")
    assert [x["figure"] for x in r["ungrounded"]] == ["9,999.99"]


def test_invented_citations_are_withheld(spark):
    r = verdict(spark, "Something happened [page 7].")
    assert r["refused"] and r["text"] == X.REFUSAL and r["reason"] == "every citation was to a page not retrieved ([7])"
    assert verdict(spark, "No page.")["reason"] == "the answer carried no citation"


def test_refusals_and_gate(spark):
    r = verdict(spark, X.REFUSAL + " But see 146.98 [page 98].")
    assert r["refused"] and r["reason"].endswith("(text after the refusal removed)")
    assert verdict(spark, "Revenue 146.98 [page 98].", 0.5)["reason"] == "best similarity 0.500 is below the 0.67 floor"
    assert verdict(spark, "Revenue 146.98 [page 98].", context=[])["refused"]


def test_only_questions_above_the_floor_are_generated(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "question_id string")
    h = spark.createDataFrame([("a", 0.7), ("a", 0.1), ("b", 0.6)], "question_id string, score double")
    assert [r[0] for r in guard.needs_generation(q, h).collect()] == ["a"]


def fund_rows(spark):
    rows = [("F", "S", 8 + i, "domestic equity", 10.0 - i // 2, f"CO{i}", f"Name{i} Limited") for i in range(12)] + [("F", "S", 30, "debt", 5.0, None, "Bond"), ("F", "S", 31, "net current assets", -0.6, None, "Net Current Assets")]
    return spark.createDataFrame(rows, "fund string, sheet string, row int, asset_type string, weight_pct double, company string, name string")


def test_ranks_break_ties_on_rows(spark):
    got = {r["row"]: (r["rank"], r["eligible"]) for r in holdings.rank_holdings(fund_rows(spark)).collect()}
    assert [got[8 + i] for i in range(12)] == [(i + 1, i < 10) for i in range(12)] and got[30] == (None, False)


def snapshot(spark, **change):
    total = fund_rows(spark).agg(F.sum("weight_pct")).first()[0]
    row = {"fund": "F", "holding_count": 14, "disclosed_total_pct": total, "portfolio_date": "2026-09-30", "factsheet_date": "2026-09-30", "source_url": "https://x.y/z", "source_sha256": "a" * 64, "expense_kind": "TER"} | change
    return spark.createDataFrame([tuple(row.values())], "fund string, holding_count int, disclosed_total_pct double, portfolio_date string, factsheet_date string, source_url string, source_sha256 string, expense_kind string")


@pytest.mark.parametrize(
    ("change", "rule"),
    [({}, None), ({"holding_count": 15}, "count"), ({"disclosed_total_pct": 1.0}, "total"), ({"source_url": "http://x.y"}, "source"), ({"expense_kind": "OCF"}, "expense"), ({"portfolio_date": "soon"}, "date")],
)
def test_constraints(spark, change, rule):
    got = [r["rule"] for r in holdings.snapshot_violations(holdings.rank_holdings(fund_rows(spark)), snapshot(spark, **change)).collect()]
    assert got == ([rule] if rule else [])


def test_tampered_ranks(spark):
    bad = holdings.rank_holdings(fund_rows(spark)).withColumn("rank", F.when(F.col("row") == 8, 2).otherwise(F.col("rank")))
    assert [(r["rule"], r["n"]) for r in holdings.snapshot_violations(bad, snapshot(spark)).collect()] == [("rank", 1)]


def test_missing_rows(spark):
    got = {r["rule"] for r in holdings.snapshot_violations(holdings.rank_holdings(fund_rows(spark).limit(0)), snapshot(spark)).collect()}
    assert got == {"count", "total"}


def test_coverage_needs_rank_and_filing(spark):
    filings = spark.createDataFrame([("CO0",), ("CO10",)], "company string")
    got = {r["company"]: r["indexed"] for r in holdings.coverage(holdings.rank_holdings(fund_rows(spark)), filings).collect()}
    assert got["CO0"] and not got["CO10"] and not got["CO1"] and not got[None]


def test_holdings_from_cells(spark):
    cells = [("S", 9, "A", "Alpha Ltd"), ("S", 9, "B", "IN1"), ("S", 9, "C", "14.871"), ("S", 10, "A", "Beta"), ("S", 10, "C", "$0.00"), ("S", 99, "A", "Total")]
    df = spark.createDataFrame(cells, "sheet string, row int, col string, value string")
    sections = spark.createDataFrame([("F", "S", 9, 20, "domestic equity")], "fund string, sheet string, start int, end int, asset_type string")
    got = {r["row"]: (r["name"], r["isin"], r["weight_pct"], r["weight_display"]) for r in holdings.holdings_from_cells(df, sections, "A", "B", "C").collect()}
    assert got == {9: ("Alpha Ltd", "IN1", 14.871, "14.87%"), 10: ("Beta", "", 0.0, "<0.005%")}
    expected = spark.createDataFrame([("S", 9, "A", "Alpha Ltd"), ("S", 8, "A", "Name")], "sheet string, row int, col string, value string")
    assert [r["row"] for r in holdings.layout_violations(df, expected).collect()] == [8]


LINE = "company string, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, block int, height double, width double"


def read_page(spark, boxes, width=600.0, height=800.0):
    rows = [("C", 1, i, t, float(x0), float(y0), float(x1), y0 + 10.0, 9.0, b, height, width) for i, (t, x0, y0, x1, b) in enumerate(boxes)]
    r = layout.clean_pages(layout.repaired(spark.createDataFrame(rows, LINE))).first()
    return r["text"].split("\n"), r["columns"], r["spread"]


def test_rows_and_cells(spark):
    boxes = [("2,365.71", 300, 102, 340, 1), ("Trade receivables", 50, 100, 150, 0), ("6", 200, 101, 206, 2), ("1,852.73", 342, 102, 380, 3), ("•", 50, 120, 54, 4), ("An item", 80, 120, 140, 4)]
    boxes += [("(₹", 50, 140, 60, 5), ("in", 62, 140, 70, 5), ("crore)", 72, 140, 99, 5), ("Total assets", 101, 140, 160, 5), ("1.5 2.5", 300, 160, 340, 6), ("As at", 50, 180, 70, 7), ("March 31, 2025", 72, 180, 120, 7), ("3.5", 122, 180, 130, 7)]
    rows, columns, _ = read_page(spark, boxes)
    assert rows == ["Trade receivables | 6 | 2,365.71 | 1,852.73", "• An item", "(₹ in crore) | Total assets", "1.5 | 2.5", "As at March 31, 2025 | 3.5"] and columns == 1


def test_stacked_periods_and_wrapped_labels(spark):
    boxes = [("As at", 200, 100, 240, 0), ("As at", 300, 100, 340, 0), ("March 31, 2025", 195, 109, 260, 0), ("March 31, 2024", 295, 109, 360, 0), ("Dues of creditors other than", 50, 140, 180, 0), ("small enterprises", 50, 155, 130, 0), ("1,935.74", 200, 155, 240, 0), ("1,706.06", 300, 155, 340, 0)]
    boxes += [("considered", 50, 170, 100, 0), ("good", 50, 185, 80, 0), ("b) Advances", 50, 200, 100, 0)]
    assert read_page(spark, boxes)[0] == ["As at March 31, 2025 | As at March 31, 2024", "Dues of creditors other than small enterprises considered good | 1,935.74 | 1,706.06", "b) Advances"]


def test_heading_over_three_lines(spark):
    boxes = [("for the year ended", 200, 100, 260, 0), ("31 March 2025 to", 200, 111, 260, 0), ("31 March 2026", 200, 122, 260, 0), ("31 March 2027", 200, 145, 260, 0)]
    # A finished heading takes nothing from below it.
    boxes += [("As at March 31, 2024", 200, 300, 260, 0), ("March 31, 2023", 200, 311, 260, 0)]
    assert read_page(spark, boxes)[0] == ["for the year ended 31 March 2025 to 31 March 2026", "31 March 2027", "As at March 31, 2024", "March 31, 2023"]


def test_two_columns_are_read_in_turn(spark):
    boxes = [b for i in range(6) for b in [(f"left {i}", 50, 100 + i * 37, 270, 2 * i), (f"right {i}", 320, 113 + i * 37, 540, 2 * i + 1)]]
    rows, columns, _ = read_page(spark, boxes)
    assert columns == 2 and rows == [f"left {i}" for i in range(6)] + [f"right {i}" for i in range(6)]
    # Blocks that start level are a grid, whatever their width.
    level = [(t, x0, 100 + (b // 2) * 37, x1, b) for t, x0, _, x1, b in boxes]
    assert read_page(spark, level)[:2] == ([f"left {i} | right {i}" for i in range(6)], 1)


def test_bands_and_strays(spark):
    boxes = [b for i in range(6) for b in [(f"left {i}", 50, 100 + i * 37, 270, 2 * i), (f"right {i}", 320, 113 + i * 37, 540, 2 * i + 1)]]
    boxes += [("A heading across", 50, 205, 540, 20), ("caption", 430, 330, 500, 21)]
    rows, columns, _ = read_page(spark, boxes)
    # The caption stands in the band under the heading and goes with the nearer column.
    assert columns == 2 and rows == ["left 0", "left 1", "left 2", "right 0", "right 1", "right 2", "A heading across", "left 3", "left 4", "left 5", "right 3", "right 4", "right 5", "caption"]


def test_spread_is_read_half_by_half(spark):
    boxes = [b for i in range(5) for b in [(f"left {i}", 50, 100 + i * 20, 300, i), (f"right {i}", 700, 100 + i * 20, 950, 10 + i)]]
    rows, _, spread = read_page(spark, boxes, 1000.0, 700.0)
    assert spread and rows == [f"left {i}" for i in range(5)] + [f"right {i}" for i in range(5)]


def test_page_of_furniture_only(spark):
    rows = [("C", p, 0, "Annual Report", 50.0, 780.0, 90.0, 790.0, 7.0, 0, 800.0, 600.0) for p in range(1, 5)] + [("C", p, 1, "Body text of the page " * 3, 50.0, 400.0, 90.0, 410.0, 9.0, 1, 800.0, 600.0) for p in range(1, 4)]
    got = {r["page"]: (r["text"], r["furniture"], r["n_words"]) for r in layout.clean_pages(spark.createDataFrame(rows, LINE)).collect()}
    assert got[4] == ("", ["Annual Report"], 0) and got[1][2] == 15 and len(got) == 4


def test_glyphs_are_repaired_first(spark):
    boxes = [("(` in  crore)", 50, 100, 90, 0), ("ﬁnance C crore", 50, 130, 90, 1), ("C crore", 50, 160, 90, 2)]
    assert read_page(spark, boxes)[0] == ["(₹ in crore)", "finance C crore", "₹ crore"]


def test_upright(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0, d, 600.0, 800.0) for d in (0.0, -1.0, 1.0)], "x0 double, y0 double, x1 double, y1 double, dy double, width double, height double")
    assert [tuple(r)[:4] for r in layout.upright(df).collect()] == [(10, 20, 30, 40), (760, 10, 780, 30), (20, 570, 40, 590)]


def test_memos(spark):
    reg = spark.createDataFrame([("r", "E1", "Fact one [page 1].", "A"), ("r", "E2", "Fact two [page 2].", "A"), ("r", "E3", "Fact three.", "B"), ("r", "E4", "w " * 450, "B")], "request_id string, id string, text string, source string")
    cases = {'{"evidence_ids": ["E1", "E2", "E3"]}': "", "prose": "The agent did not return an evidence selection", '["E1"]': "Invalid evidence selection", '{"evidence_ids": ["E1"], "x": 1}': "Invalid evidence selection", '{"evidence_ids": "E1"}': "Invalid evidence selection",
             '{"evidence_ids": ["E1", "E1"]}': "Missing, repeated or unknown evidence", '{"evidence_ids": [1]}': "Missing, repeated or unknown evidence", '{"evidence_ids": []}': "Missing, repeated or unknown evidence", '{"evidence_ids": ["E9"]}': "Missing, repeated or unknown evidence", '{"evidence_ids": ["E4"]}': "The memo exceeds one page of text"}
    for raw, reason in cases.items():
        r = evidence.memos(spark.createDataFrame([("r", raw)], "request_id string, raw string"), reg).first()
        assert (r["reason"], r["refused"]) == (reason, reason != ""), raw
        if not reason:
            assert r["text"] == "**A**\n\nFact one [page 1].\n\nFact two [page 2].\n\n**B**\n\nFact three."


def test_grades_and_threshold(spark):
    rows = [(True, False, "x [page 1]", "x [page 1]", True, True, 0, 0), (True, False, "x", "x", True, True, 0, 1), (False, True, X.REFUSAL, X.REFUSAL, False, False, 0, 0), (False, True, X.REFUSAL, X.REFUSAL + " But", False, False, 0, 0)]
    df = spark.createDataFrame(rows, "answerable boolean, refused boolean, text string, raw string, correct boolean, faithful boolean, n_invalid int, n_ungrounded int")
    assert [(r["leaked"], r["passed"]) for r in evals.grade(df).collect()] == [(False, True), (False, False), (False, True), (True, False)]
    rng = random.Random(1)
    scores = [(round(rng.random(), 2), rng.random() < 0.5) for _ in range(60)]
    got = evals.fit_threshold(spark.createDataFrame(scores, "score double, answerable boolean")).first()
    values = sorted({s for s, _ in scores})
    errors = lambda t: sum((s < t) == a for s, a in scores)
    best = min(((a + b) / 2 for a, b in zip(values, values[1:], strict=False)), key=lambda t: (errors(t), -t))
    assert math.isclose(got["threshold"], best) and got["errors"] == errors(best)


def test_threshold_over_many_ranges(spark, monkeypatch):
    """Ranges of any size give what one sorted pass over all scores gives."""
    rng = random.Random(3)
    rows = [(rng.choice([rng.random(), rng.randrange(8) / 4]), rng.random() < 0.5) for _ in range(400)] + [(None, True)]
    df = spark.createDataFrame(rows, "score double, answerable boolean")
    known = sorted({s for s, _ in rows if s is not None})
    cuts = [(sum(a and s < t or not a and s >= t for s, a in rows if s is not None), -t) for t in ((x + y) / 2 for x, y in zip(known, known[1:], strict=False))]
    expected = min(cuts)
    for size in (100_000, 50, 3, 1):
        monkeypatch.setattr(evals, "RANGE_SCORES", size)
        got = evals.fit_threshold(df).first()
        assert (got["errors"], -got["threshold"]) == expected, size
    assert evals.fit_threshold(df.limit(0)).first()["threshold"] is None


def test_named_holdings_are_found_by_their_first_letters(spark):
    """What a comparison of every holding of a fund with every question finds, and nothing else."""
    import re

    names = ["Bharat Electronics Limited", "Bharat Electronics Ltd. Bonds", "ITC Ltd", "HDFC Bank", "Bank", "Net Current Assets", "Limited", "Larsen & Toubro", "ab", None]
    codes = ["BEL", None, "ITC", "M&M", "B", None, None, "LT", "AB", "ZZ"]
    rows = [(fund, name, code, f"{i}.00%", "S", i + 9, i + 1, True) for fund in (1, 2) for i, (name, code) in enumerate(zip(names, codes, strict=True)) if fund == 1 or i % 2]
    asked = [(1, "what is the bel weight?"), (1, "weight of bharat electronics?"), (1, "weight of bharat electronics  bonds"), (2, "bharat electronics and hdfc bank holding"), (1, "the switching cost of m&m"), (1, "weight of larsen & toubro limited"), (2, "label"), (1, ""), (3, "bank"), (1, "b"), (1, "rabbit holding zz.")]
    asked = [(f"q{i}", *a) for i, a in enumerate(asked)]
    expected = set()
    for q, fund, text in asked:
        for f, name, code, *_, row, _, _ in rows:
            short = None if name is None else re.sub(r"\b(?:limited|ltd)\.?", "", name.lower()).strip()
            if f == fund and (short is not None and short in text or code and re.search(r"\b" + re.escape(code.lower()) + r"\b", text)):
                expected.add((q, row))
    held = spark.createDataFrame(rows, "fund int, name string, company string, weight_display string, sheet string, row int, rank int, eligible boolean")
    got = holdings.named(spark.createDataFrame(asked, "question_id string, fund int, q string"), held).collect()
    assert sorted((r["question_id"], r["row"]) for r in got) == sorted(expected) and len(expected) > 15
    plan = holdings.named(spark.createDataFrame(asked, "question_id string, fund int, q string"), held)._jdf.queryExecution().optimizedPlan().toString()
    assert "key" in plan.split("Join Inner")[1].split("\n")[0]


def test_lines_are_made_once_for_furniture(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def drawn(i):
        made.add(1)
        return f"Annual Report {i}" if i % 5 == 0 else f"row {i}"

    at = F.col("id") % 5
    rows = spark.range(50).select(F.lit("A").alias("company"), (F.col("id") / 5).cast("int").alias("page"), at.alias("line"), drawn("id").alias("text"), (at * 100.0 + 20).alias("y0"), (at * 100.0 + 30).alias("y1"), F.when(at == 0, 7.0).otherwise(9.0).alias("size"), F.lit(800.0).alias("height"))
    layout.repaired(rows).write.format("noop").mode("overwrite").save()
    once = made.value
    assert layout.furniture(layout.repaired(rows)).count() == 10 and made.value == 2 * once


def test_holdings_scan_the_items_once(spark):
    rows = derived.holdings_rows(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") > 0 and len(rows.inputFiles()) == 2 and plan.count("Relation [l_orderkey") + plan.count("Relation[l_orderkey") <= 1
    again = derived.spark_rows(spark, "/root/testdata/sf0.001", derived.HOLDINGS)
    assert rows.exceptAll(again).count() == again.exceptAll(rows).count() == 0


def test_pages_are_read_from_one_row_each(spark):
    boxes = [("1. Assets", 50, 100, 90, 0), ("a)", 50, 120, 60, 0), ("Loans", 120, 121, 160, 0), ("5 6", 300, 120, 340, 1), ("-", 50, 140, 54, 0), ("7 % of all", 300, 140, 340, 1)]
    assert read_page(spark, boxes)[0] == ["1. Assets", "a) Loans | 5 | 6", "- 7 % of all"]
    rows = [("C", 1, i, t, float(x0), float(y0), float(x1), y0 + 10.0, 9.0, b, 800.0, 600.0) for i, (t, x0, y0, x1, b) in enumerate(boxes)]
    plan = re.sub(r"#\d+L?", "", layout.clean_pages(layout.repaired(spark.createDataFrame(rows, LINE)))._jdf.queryExecution().optimizedPlan().toString())
    # No page is sorted or gathered again after its lines were brought together.
    assert "windowspecdefinition(company, page" not in plan and plan.count("Aggregate [company, page]") == 2
