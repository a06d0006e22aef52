"""One lineage from a filing's lines to its chunks: clean, tables, scope, quality, exclusions, chunk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import text as T
from vellumgrid.operators import chunking, ingest, layout

PAGE = ["company", "page"]


def clean(lines: DataFrame) -> DataFrame:
    """Pages (company, page, text, title, units, headers, columns, spread, furniture, n_words, excluded) of a filing's lines."""
    pages = layout.clean_pages(layout.repaired(lines))
    few = F.when(F.col("n_words") < X.MIN_BODY_WORDS, f"fewer than {X.MIN_BODY_WORDS} body words")
    return chunking.page_context(pages, F.col("title")).withColumn("excluded", few)


def swap_tables(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """Pages with the text of a table reader (company, page, markdown, found, and timed_out if it gave up) where that passes the gates.

    Furniture rows are taken out of a reading first; headers then are the reading's, units are added, the title stays.
    Adds table_reader and table_gate (why a reading was not taken). Excluded pages are not looked at.
    """
    late = F.coalesce("timed_out", F.lit(False)) if "timed_out" in readings.columns else F.lit(False)
    # Repeated rows stay: the gate has to see them.
    kept = F.filter(T.table_rows(F.coalesce("markdown", F.lit(""))), lambda r: ~F.coalesce(F.array_contains("furniture", r), F.lit(False)))
    own = readings.select(*PAGE, "markdown", "found", late.alias("late"))
    joined = pages.join(own, PAGE, "left").withColumn("rows", kept)
    open_ = F.col("excluded").isNull()
    gate = F.when(F.col("late"), "timed out").otherwise(T.table_gate(F.col("found"), F.col("rows"), F.col("text")))
    judged = joined.withColumn("table_gate", F.when(open_, gate)).withColumn("taken", open_ & F.col("table_gate").isNull())
    found_units = F.filter(F.flatten(F.transform("rows", T.cells)), T.is_unit_declaration)
    taken = F.col("taken")
    return judged.withColumns(
        {
            "text": F.when(taken, F.array_join("rows", "\n")).otherwise(F.col("text")),
            "headers": F.when(taken, F.array_distinct(F.filter("rows", T.is_period_header))).otherwise(F.col("headers")),
            "units": F.when(taken, F.array_distinct(F.concat("units", found_units))).otherwise(F.col("units")),
            "table_reader": F.when(open_, F.when(taken, "tables").otherwise("lines")),
        }
    ).drop("rows", "taken", "markdown", "found", "late")


def judge_pages(pages: DataFrame, raw: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Adds scope (by the headings of the raw pages: company, page, text), leaves out interleaved prose, and lets a reviewer's reasons win."""
    scopes = raw.select(*PAGE, T.heading_scope(F.coalesce("text", F.lit(""))).alias("scope"))
    mixed = F.when(T.interleaved_prose(F.col("text")), "quality check: possible interleaved prose columns")
    judged = pages.withColumn("excluded", F.coalesce("excluded", mixed)).join(scopes, PAGE, "left").withColumn("scope", F.coalesce("scope", F.lit("unstated")))
    return judged if manifest is None else ingest.manual_exclusions(judged, manifest)


def build(lines: DataFrame, raw: DataFrame, manifest: DataFrame, readings: DataFrame | None = None, count: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """The chunks of all filings of the manifest (company, fiscal_year, quality_exclusions), in one plan: no filing is a job of its own."""
    years = manifest.select("company", "fiscal_year")
    pages = clean(lines.join(years.select("company"), "company", "left_semi"))
    pages = pages if readings is None else swap_tables(pages, readings)
    return chunking.chunk_pages(judge_pages(pages, raw, manifest).join(years, "company"), count=count)
