"""Readers and writers: JSON lines, manifests, page texts, checksums, links, sheets."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import text as T
from vellumgrid.sources import paged

CHUNK_SCHEMA = "company string, fiscal_year string, page int, chunk int, scope string, tokens int, text string"
MANIFEST_SCHEMA = "company string, name string, fiscal_year string, file string, source_url string, listing string, sha256 string, retrieved string, pages_without_text array<int>, quality_exclusions map<string,string>"


def read_jsonl(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line; results are never overwritten unless asked."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The filings' manifest, checked on load: one row a company, a well-formed code and checksum."""
    rows = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").json(path)
    repeated = F.count("*").over(Window.partitionBy("company")) > 1
    broken = repeated | F.coalesce(~T.matches(F.col("company"), X.COMPANY_CODE) | ~T.matches(F.col("sha256"), X.SHA256), F.lit(True))
    return rows.withColumn("company", F.when(broken, F.raise_error(F.concat(F.lit("malformed manifest row: "), F.coalesce("company", F.lit("?"))))).otherwise(F.col("company")))


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (code, ...) appended; a malformed or known code is an error."""
    known = registry.select(F.col("code").alias("known")).distinct()
    checked = new.withColumn("again", F.count("*").over(Window.partitionBy("code")) > 1).join(known, F.col("code") == F.col("known"), "left")
    bad = F.when(~F.coalesce(T.matches(F.col("code"), X.COMPANY_CODE), F.lit(False)), "malformed code").when(F.col("known").isNotNull(), "known code").when(F.col("again"), "repeated code")
    checked = checked.withColumn("code", F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("code"))).drop("known", "again")
    return registry.unionByName(checked, allowMissingColumns=True)


def checksums(spark: SparkSession, paths: str, expected: DataFrame | None = None) -> DataFrame:
    """path, length, sha256 and is_pdf of files, and with ``expected`` (file, sha256) whether they verify."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"), F.startswith("content", F.lit(b"%PDF")).alias("is_pdf"))
    if expected is None:
        return files
    own = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    wanted = expected.select("file", F.col("sha256").alias("expected"))
    return wanted.join(own, "file", "left").withColumn("verified", F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False)))


def verify_or_fail(checked: DataFrame) -> DataFrame:
    """``checked`` as it is, or an error when it is computed, if any file does not verify."""
    return checked.withColumn("sha256", F.when(F.col("verified"), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("checksum mismatch: "), F.col("file")))))


def read_pages(spark: SparkSession, paths: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """path, page (from 1) and text of every page, empty ones included, by an injected parser."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts = parse(content)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts, pa.string())], names=["path", "page", "text"])

    return files.mapInArrow(run, "path string, page int, text string")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_cells(content: bytes, only: str | None = None) -> Iterator[tuple[str, int, str, str, str]]:
    """(sheet, row, column letters, kind, value) of every stored cell value, of one sheet if named; formulas are not evaluated."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", _NS)) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = ET.fromstring(book.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)
        if only is not None and only not in [s.get("name") for s in sheets]:
            raise KeyError(f"no sheet {only}")
        for sheet in sheets:
            if only not in (None, sheet.get("name")):
                continue
            target = targets[sheet.get(_REL)].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            for cell in ET.fromstring(book.read(part)).iterfind(".//m:c", _NS):
                letters, number = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                kind, value = cell.get("t", "n"), cell.find("m:v", _NS)
                if kind == "inlineStr":
                    yield sheet.get("name"), int(number), letters, "string", "".join(t.text or "" for t in cell.iterfind(".//m:t", _NS))
                elif value is not None and value.text is not None:
                    if kind == "s":
                        yield sheet.get("name"), int(number), letters, "string", shared[int(value.text)]
                    elif kind == "n":
                        yield sheet.get("name"), int(number), letters, "number", repr(float(value.text))
                    else:
                        yield sheet.get("name"), int(number), letters, {"b": "bool", "e": "error"}.get(kind, "string"), value.text


def read_sheets(spark: SparkSession, paths: str) -> DataFrame:
    """path, sheet, row, col, kind and value: workbooks as long cell grids with their own row numbers."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = list(sheet_cells(content))
                columns = list(zip(*cells, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(cells), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.string()) for c in columns[2:])],
                    names=["path", "sheet", "row", "col", "kind", "value"],
                )

    return files.mapInArrow(run, "path string, sheet string, row int, col string, kind string, value string")


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    """The common named entities; the ampersand last, so that nothing is unescaped twice."""
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def absolute(base: Column, href: Column) -> Column:
    """An address as seen from its page."""
    scheme, host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(T.matches(href, "^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(host, href))
        .otherwise(F.concat(folder, href))
    )


def html_links(pages: DataFrame, extension: str | None = None) -> DataFrame:
    """page_id, url, label and pos of each page's links: absolute, first label of an address kept, in page order.

    ``extension`` (such as ".pdf") keeps only addresses that end with it.
    """
    html = F.coalesce("html", F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(X.LINK), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(X.LINK), F.lit(2)).alias("label"))
    each = pages.select("page_id", F.col("url").alias("base"), F.posexplode_outer(pairs).alias("at", "link")).where("link is not null")
    label = F.trim(F.regexp_replace(unescape(F.regexp_replace("link.label", r"<[^>]+>", " ")), r"(?U)\s+", " "))
    each = each.select("page_id", "at", absolute(F.col("base"), unescape(F.col("link.href"))).alias("url"), label.alias("label"))
    if extension:
        each = each.where(F.endswith(F.lower("url"), F.lit(extension.lower())))
    first = each.groupBy("page_id", "url").agg(F.min(F.struct("at", "label")).alias("f"))
    return first.select("page_id", "url", "f.label", F.col("f.at").alias("pos"))


def sources_table(manifest: DataFrame) -> DataFrame:
    """The manifest as the lines of a Markdown table: place (0 and 1 the head, 2 the rows), company and line.

    A row for each filing, wherever it is: the table is put in order when it is written.
    """
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "company", "name", "fiscal_year", "source_url", "sha256"), F.lit(" |"))
    head = manifest.sparkSession.createDataFrame([(0, "", "| Company | Name | Year | Source | SHA-256 |"), (1, "", "|---|---|---|---|---|")], "place int, company string, line string")
    return head.unionByName(manifest.select(F.lit(2).alias("place"), "company", row.alias("line")))


def write_table(lines: DataFrame, path: str) -> None:
    """Lines in order as text files whose names are in that order: sorted by ranges, so that no task holds them all."""
    lines.orderBy("place", "company", "line").select("line").write.mode("errorifexists").text(path)


def write_if_changed(path: str, text: str) -> bool:
    """Write a small generated file only if its text is another; says whether it was written."""
    try:
        with open(path, encoding="utf-8") as f:
            if f.read() == text:
                return False
    except FileNotFoundError:
        pass
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return True


LINE_SCHEMA = "path string, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, dy double, block int, height double, width double, problem string"
_LINE_NAMES = [f.split()[0] for f in LINE_SCHEMA.split(", ")]
_LINES = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]]) for f in LINE_SCHEMA.split(", ")])


def line_rows(path: str, page: int, height: float, width: float, lines: list) -> Iterator[tuple]:
    """Rows of LINE_SCHEMA for a page; a line's size is that of its longest span."""
    for i, (spans, x0, y0, x1, y1, dy, block) in enumerate(lines):
        size = max(spans, key=lambda s: len(s[0].strip()))[1] if spans else 0.0
        yield path, page, i, "".join(s[0] for s in spans), float(x0), float(y0), float(x1), float(y1), float(size), float(dy), block, float(height), float(width), None


def read_lines(spark: SparkSession, paths: str, reader: Callable[[], paged.Reader], seconds: float = paged.SECONDS) -> DataFrame:
    """Line boxes of paged files by an injected reader, as the layout operators take them once ``problem`` is null.

    Pages are read in a process of their own. One that takes longer than ``seconds`` is ended and is a row with the problem
    "timed out"; so is one whose reading fails, with its error, and page 0 for a file that cannot be opened. The other pages go on.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for page, read, problem in paged.read(own, content, seconds):
                    rows = [(path, page, *[None] * 11, problem)] if problem is not None else list(line_rows(path, page, *read))
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(_LINE_NAMES, r, strict=True)) for r in rows], schema=_LINES)

    return files.mapInArrow(run, LINE_SCHEMA)
