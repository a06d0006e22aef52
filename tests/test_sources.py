from __future__ import annotations

import hashlib
import io
import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from vellumgrid.functions import models
from vellumgrid.operators import layout
from vellumgrid.sources import files, formats, index
from vellumgrid.streaming import limits, upserts

SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>14.87</v></c><c r="C3" t="b"><v>1</v></c></row>
<row r="7"><c r="A7" t="inlineStr"><is><t>in</t><t>line</t></is></c><c r="B7" t="str"><f>A1</f><v>cached</v></c><c r="AA7"/></row></sheetData></worksheet>"""


def workbook() -> bytes:
    out = io.BytesIO()
    ns = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets><sheet name="Holdings" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}/spreadsheetml/2006/main"><si><t>no</t></si><si><r><t>Bharat </t></r><r><t>Ltd</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
    return out.getvalue()


def test_sheets_keep_their_row_numbers(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    got = {(r["row"], r["col"]): (r["kind"], r["value"]) for r in files.read_sheets(spark, str(tmp_path / "*.xlsx")).collect()}
    assert got == {(3, "A"): ("string", "Bharat Ltd"), (3, "B"): ("number", "14.87"), (3, "C"): ("bool", "1"), (7, "A"): ("string", "inline"), (7, "B"): ("string", "cached")}


def test_checksums(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    sha = hashlib.sha256(b"%PDF-1.7 x").hexdigest()
    expected = spark.createDataFrame([("a.pdf", sha), ("b.pdf", sha), ("c.pdf", sha)], "file string, sha256 string")
    checked = files.checksums(spark, str(tmp_path / "*.pdf"), expected)
    assert {r["file"]: (r["verified"], r["is_pdf"]) for r in checked.collect()} == {"a.pdf": (True, True), "b.pdf": (False, False), "c.pdf": (False, None)}
    with pytest.raises(Exception, match="checksum mismatch"):
        files.verify_or_fail(checked).select("sha256").collect()


def test_pages_are_numbered_and_empty_ones_kept(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\f\fthree")
    got = files.read_pages(spark, str(tmp_path / "*.txt"), lambda b: b.decode().split("\f"))
    assert [(r["page"], r["text"]) for r in got.orderBy("page").collect()] == [(1, "one"), (2, ""), (3, "three")]


def test_jsonl_is_not_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([("A", "FY25", 1, 0, "unstated", 3, None)], files.CHUNK_SCHEMA)
    path = str(tmp_path / "out")
    files.write_jsonl(rows, path)
    assert files.read_jsonl(spark, path).collect() == rows.collect()
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_jsonl(rows, path)


def test_manifest_and_registry(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"company": "BEL", "sha256": "%s", "quality_exclusions": {"3": "blurred"}}]' % ("a" * 64))
    (tmp_path / "bad.json").write_text('[{"company": "b el", "sha256": "x"}]')
    assert files.read_manifest(spark, str(tmp_path / "good.json")).first()["quality_exclusions"] == {"3": "blurred"}
    with pytest.raises(Exception, match="malformed"):
        files.read_manifest(spark, str(tmp_path / "bad.json")).collect()
    known = spark.createDataFrame([("BEL",)], "code string")
    assert files.register(known, spark.createDataFrame([("HCC",)], "code string")).count() == 2
    for code in ("BEL", "b"):
        with pytest.raises(Exception, match="code"):
            files.register(known, spark.createDataFrame([(code,)], "code string")).collect()


def test_links(spark):
    html = """<a href="/a.pdf?x=1">First <b>A</b></a><a href='http://o.org/b.pdf#p'>B &amp; C</a><a class=x href="/a.pdf">again</a><a href="c.html">C</a><a href="//cdn.x/d.PDF">D</a>"""
    pages = spark.createDataFrame([(1, "https://h.com/dir/page?q=2", html), (2, "https://h.com", None)], "page_id long, url string, html string")
    got = [(r["url"], r["label"]) for r in files.html_links(pages).orderBy("pos").collect()]
    assert got == [("https://h.com/a.pdf", "First A"), ("http://o.org/b.pdf", "B & C"), ("https://h.com/dir/c.html", "C"), ("https://cdn.x/d.PDF", "D")]
    assert files.html_links(pages, ".pdf").count() == 3


def chunks(spark, rows):
    return spark.createDataFrame([(c, "FY25", p, 0, "unstated", 3, t, [1.0, 0.0]) for c, p, t in rows], "company string, fiscal_year string, page int, chunk int, scope string, tokens int, text string, vector array<float>")


def test_index_round_trip_and_replacement(spark, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(chunks(spark, [("A", 1, "a"), ("A", 2, "b"), ("B", 1, "c")]), path, "hash", 2)
    assert index.open_index(spark, path, "hash").count() == 3
    with pytest.raises(ValueError, match="embedded with"):
        index.open_index(spark, path, "other")
    new = chunks(spark, [("A", 9, "new")])
    expected = {(r["company"], r["page"]) for r in index.replaced(index.open_index(spark, path, "hash").select(*new.columns), new).collect()}
    index.replace_filings(new, path)
    rows = index.open_index(spark, path, "hash")
    assert {(r["company"], r["page"]) for r in rows.collect()} == expected == {("A", 9), ("B", 1)}
    plan = rows.where("company = 'B'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(company" in plan
    with pytest.raises(Exception, match="not of 3 numbers"):
        index.write_index(new, path, "hash", 3)


def test_stale_rows(spark):
    a, b = spark.range(3).select(F.col("id").alias("x")), spark.range(1, 4).select(F.col("id").alias("x"))
    assert {(r["x"], r["change"]) for r in index.stale(a, b).collect()} == {(0, "removed"), (3, "added")}


def test_streamed_counts_equal_stored_ones(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limits.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r["day"], r["user_id"], r["n"], r["admitted"])
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, limits.daily_counts(events).collect()))


def test_streamed_filings_replace_theirs(spark, tmp_path):
    """A filing that comes in two batches replaces the old one when it is whole; the same filing again changes nothing."""
    path = str(tmp_path / "index")
    index.write_index(chunks(spark, [("A", 1, "a"), ("B", 1, "c")]), path, "hash", 2)
    rows = lambda: {(r["company"], r["page"], r["text"]) for r in index.open_index(spark, path, "hash").collect()}
    send = lambda n, sha, name, *given: chunks(spark, list(given)).withColumns({"sha256": F.lit(sha), "n_chunks": F.lit(n)}).write.mode("append").parquet(str(tmp_path / name))

    def run():
        stream = spark.readStream.schema(chunks(spark, []).withColumns({"sha256": F.lit(""), "n_chunks": F.lit(0)}).schema).parquet(str(tmp_path / "in"))
        upserts.upsert_filings(stream, path, str(tmp_path / "checkpoint")).awaitTermination(120)

    send(2, "s1", "in", ("A", 5, "new"))
    run()
    assert rows() == {("A", 1, "a"), ("B", 1, "c")}
    send(2, "s1", "in", ("A", 6, "rest"))
    run()
    assert rows() == {("A", 5, "new"), ("A", 6, "rest"), ("B", 1, "c")}
    send(2, "s1", "in", ("A", 5, "changed under the same name"), ("A", 6, "rest"))
    run()
    assert rows() == {("A", 5, "new"), ("A", 6, "rest"), ("B", 1, "c")}


def test_manifest_and_registry_refuse_repetitions(spark, tmp_path):
    row = {"company": "AB", "fiscal_year": "FY25", "sha256": "a" * 64}
    (tmp_path / "m.json").write_text(json.dumps([row, row]))
    with pytest.raises(Exception, match="malformed manifest row"):
        files.read_manifest(spark, str(tmp_path / "m.json")).collect()
    known = spark.createDataFrame([("AB",)], "code string")
    with pytest.raises(Exception, match="repeated code"):
        files.register(known, spark.createDataFrame([("CD",), ("CD",)], "code string")).collect()


def test_written_only_on_change(tmp_path):
    path = str(tmp_path / "t.md")
    assert files.write_if_changed(path, "a") and not files.write_if_changed(path, "a") and files.write_if_changed(path, "b")


class Boxes:
    """Pages parted by form feeds; a page that says so hangs, fails or ends the process."""

    def pages(self, content):
        if content.startswith(b"broken"):
            raise ValueError("not a paged file")
        return content.count(b"\f") + 1

    def page(self, content, n):
        text = content.decode().split("\f")[n - 1]
        if text == "hang":
            time.sleep(600)
        if text == "die":
            os._exit(3)
        if text == "fail":
            raise KeyError("glyph")
        return 800.0, 600.0, [([(t[:2], 12.0), (t[2:], 9.0)], 50, 100 + 20 * i, 200, 110 + 20 * i, 0.0, i) for i, t in enumerate(text.split("\n"))]


def test_line_boxes_from_an_injected_reader(spark, tmp_path):
    (tmp_path / "f.txt").write_text("first line\nsecond\fnext page")
    got = files.read_lines(spark, str(tmp_path / "f.txt"), Boxes).orderBy("page", "line").collect()
    assert [(r["page"], r["line"], r["text"], r["size"], r["problem"]) for r in got] == [(1, 0, "first line", 9.0, None), (1, 1, "second", 9.0, None), (2, 0, "next page", 9.0, None)]
    pages = layout.clean_pages(layout.repaired(files.read_lines(spark, str(tmp_path / "f.txt"), Boxes).where("problem is null").drop("problem").withColumnRenamed("path", "company")))
    assert {(r["page"], r["text"]) for r in pages.collect()} == {(1, "first line\nsecond"), (2, "next page")}


def test_a_page_that_hangs_is_ended(spark, tmp_path):
    """It loses itself, not the file, the task or the other files."""
    (tmp_path / "a.txt").write_text("one\fhang\fthree\fdie\ffive\ffail\fseven")
    (tmp_path / "b.txt").write_text("broken\fx")
    (tmp_path / "c.txt").write_text("fine")
    began = time.monotonic()
    got = files.read_lines(spark, str(tmp_path / "*.txt"), Boxes, seconds=1.5).collect()
    assert time.monotonic() - began < 60
    by_page = {(r["path"][-5:], r["page"]): (r["text"], r["problem"]) for r in got}
    assert by_page == {
        ("a.txt", 1): ("one", None), ("a.txt", 2): (None, "timed out"), ("a.txt", 3): ("three", None), ("a.txt", 4): (None, "the reader died"), ("a.txt", 5): ("five", None),
        ("a.txt", 6): (None, "KeyError: 'glyph'"), ("a.txt", 7): ("seven", None), ("b.txt", 0): (None, "ValueError: not a paged file"), ("c.txt", 1): ("fine", None),
    }


def test_workbooks_as_a_data_source(spark, tmp_path):
    formats.register(spark)
    for name in ("a", "b"):
        (tmp_path / f"{name}.xlsx").write_bytes(workbook())
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("x")
    read = spark.read.format("workbook").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 3 and read.columns == ["path", "sheet", "row", "col", "kind", "value", "problem"]
    plain = {(r["path"].split("/")[-1], *r[1:]) for r in files.read_sheets(spark, str(tmp_path / "[ab].xlsx")).collect()}
    assert {(r["path"].split("/")[-1], *r[1:6]) for r in read.where("problem is null").collect()} == plain and len(plain) == 10
    assert [(r["path"].split("/")[-1], r["problem"].split(":")[0]) for r in read.where("problem is not null").collect()] == [("broken.xlsx", "BadZipFile")]
    some = spark.read.format("workbook").option("sheets", "Holdings, Notes").load(str(tmp_path / "a.xlsx"))
    assert some.rdd.getNumPartitions() == 2 and some.where("sheet = 'Holdings' and problem is null").count() == 5 and some.where("problem like '%no sheet Notes%'").count() == 1
    with pytest.raises(Exception, match="broken.xlsx"):
        spark.read.format("workbook").option("mode", "FAILFAST").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("workbook").load(str(tmp_path / "nowhere")).collect()


def test_paged_files_as_a_data_source(spark, tmp_path):
    formats.register(spark)
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("\f".join(f"file {i} page {n}\nmore" for n in range(1, 8)))
    (tmp_path / "x.txt").write_text("broken")
    load = lambda **o: spark.read.format("paged_lines").options(reader="tests.test_sources:Boxes", suffix=".txt", **o).load(str(tmp_path))
    one, three = load(), load(parts=3)
    assert (one.rdd.getNumPartitions(), three.rdd.getNumPartitions()) == (4, 12)
    rows = lambda frame: sorted((r["path"], r["page"], r["line"] or 0, r["text"] or "", r["problem"] or "") for r in frame.collect())
    assert rows(one) == rows(three) == rows(files.read_lines(spark, str(tmp_path / "*.txt"), Boxes).withColumn("path", F.regexp_replace("path", "^file:", ""))) and len(rows(one)) == 43
    with pytest.raises(Exception, match="reader is needed"):
        spark.read.format("paged_lines").load(str(tmp_path)).collect()


class Fixed:
    def judge(self, question, expected, answer, context):
        return json.dumps({"correct": expected in answer, "faithful": True, "computed": [{"labelled": "computed" in answer, "arithmetic_right": True}] if "sum" in answer else []})

    def generate(self, question, prompt):
        return "x"

    def rerank(self, question, texts):
        return [float(len(texts))] * len(texts)


def test_judge_budget_and_rerank_hooks(spark):
    rows = [("a", 1, "q", "5.25", "It is 5.25", "c"), ("b", 1, "q", "5.25", "The sum is 5.25", "c"), ("c", 2, "q", "9", "The sum (computed) is 8", "c")]
    got = models.judge(spark.createDataFrame(rows, "question_id string, sample int, question string, expected string, text string, context string"), Fixed)
    assert {(r["question_id"], r["sample"], r["correct"], r["faithful"]) for r in got.collect()} == {("a", 1, True, True), ("b", 1, True, False), ("c", 2, False, True)}
    counted = []
    model = models.Budgeted(Fixed(), 2, counted.append)
    assert [model.generate("q", "p"), model.generate("q", "p")] == ["x", "x"] and counted == [0, 1]
    with pytest.raises(models.CallLimit):
        model.generate("q", "p")
    pairs = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q1", "c")], "q string, t string").coalesce(1)
    assert sorted(r[0] for r in pairs.select(models.rerank_score(F.col("q"), F.col("t"), Fixed)).collect()) == [1.0, 2.0, 2.0]


class Counting:
    def __init__(self, asked):
        self.asked = asked

    def generate(self, question, prompt):
        self.asked.add(1)
        return prompt.upper()


@pytest.mark.parametrize(("most", "expected"), [(3, 3), (0, 0), (100, 20)])
def test_all_tasks_spend_one_budget(spark, most, expected):
    asked = spark.sparkContext.accumulator(0)
    prompts = spark.createDataFrame([(f"q{i:02}", "?", f"p{i}") for i in range(20)], "question_id string, question string, prompt string").repartition(5)
    got = models.generate(prompts, lambda: Counting(asked), most).collect()
    assert asked.value == expected and sorted(r["question_id"] for r in got) == [f"q{i:02}" for i in range(expected)]
