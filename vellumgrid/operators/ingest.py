"""Ingest decisions: candidate reports and their years, manifest upserts, exclusions, profiles, fund builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import text as T
from vellumgrid.operators import holdings, layout
from vellumgrid.sources.tables import keep

#: Unlabelled candidates whose reports are opened to find their year.
MAX_UNLABELLED = 6


def manual_exclusions(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """``pages`` with ``excluded`` replaced by a reviewer's reason where the manifest maps the page to one."""
    reasons = manifest.select("company", F.explode("quality_exclusions").alias("at", "reason")).select("company", F.col("at").cast("long").alias("page"), "reason")
    joined = pages.join(reasons, ["company", "page"], "left")
    return joined.withColumn("excluded", F.coalesce("reason", "excluded")).drop("reason")


def candidates(links: DataFrame, manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds fiscal_year to links (company, url, label, given, pos): given, else the label's only year, else what
    the manifest or an earlier look knows of the address."""
    years = F.array_distinct(T.fiscal_year_labels(F.col("label")))
    own = links.withColumn("labelled", F.when(F.size(years) == 1, years[0]))
    known = manifest.select(F.col("source_url").alias("url"), F.col("fiscal_year").alias("known")).dropDuplicates(["url"])
    before = seen.select("url", F.col("fiscal_year").alias("before")).dropDuplicates(["url"])
    found = own.join(known, "url", "left").join(before, "url", "left")
    return found.withColumn("fiscal_year", F.coalesce("given", "labelled", "known", "before")).drop("labelled", "known", "before")


def to_open(found: DataFrame, n: int = MAX_UNLABELLED) -> DataFrame:
    """The first few candidates of each company that still have no year."""
    order = Window.partitionBy("company").orderBy("pos")
    return found.where("fiscal_year is null").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def latest(found: DataFrame) -> DataFrame:
    """company, fiscal_year, url and pos of each company's latest dated report, the first on a tie."""
    number = F.substr("fiscal_year", F.lit(3)).cast("int")
    best = found.where("fiscal_year is not null").groupBy("company").agg(F.max(F.struct(number.alias("n"), (-F.col("pos")).alias("p"), "fiscal_year", "url")).alias("b"))
    return best.select("company", "b.fiscal_year", "b.url", (-F.col("b.p")).alias("pos"))


def upsert_manifest(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """One row a company: new rows take the place of the old ones unless these are as late and have the same checksum."""
    number = lambda c: F.substr(c, F.lit(3)).cast("int")
    old = manifest.select("company", F.col("fiscal_year").alias("_year"), F.col("sha256").alias("_sha"))
    current = (number("_year") >= number("fiscal_year")) & (F.col("sha256") == F.col("_sha"))
    taken = new.join(old, "company", "left").where(~F.coalesce(current, F.lit(False))).drop("_year", "_sha")
    return manifest.join(taken.select("company"), "company", "left_anti").unionByName(taken)


def ingest_profile(pages: DataFrame) -> DataFrame:
    """company, n_pages, n_excluded, n_titled, n_multi_column, n_glyphs left unrepaired, and chars."""
    residue = F.regexp_count("text", F.lit("[`ﬀﬁﬂﬃﬄ\\x00-\\x08\\x0b-\\x1f\\x7f]")) > 0
    return pages.groupBy("company").agg(
        F.count("*").alias("n_pages"), F.count("excluded").alias("n_excluded"), F.count("title").alias("n_titled"), F.count_if(F.col("columns") > 1).alias("n_multi_column"), F.count_if(residue).alias("n_glyphs"), F.sum(F.length("text")).alias("chars")
    )


def furniture_profile(lines: DataFrame) -> DataFrame:
    """company, signature and number of pages of its running heads and footers."""
    lines = keep(lines)
    running = lines.join(layout.running(lines), ["company", "page", "line"], "left_semi")
    return running.groupBy("company", T.signature(F.col("text")).alias("signature")).agg(F.countDistinct("page").alias("pages"))


def build_funds(cells: DataFrame, checks: DataFrame, sections: DataFrame, reviewed: DataFrame, name_col: str, isin_col: str, weight_col: str) -> DataFrame:
    """Ranked holdings from sheets whose reviewed cells are as expected; a changed layout is an error."""
    changed = holdings.layout_violations(cells, checks).groupBy("sheet").agg(F.min(F.concat("col", F.col("row").cast("string"))).alias("_at"))
    rows = holdings.map_companies(holdings.holdings_from_cells(cells, sections, name_col, isin_col, weight_col), reviewed)
    checked = rows.join(changed, "sheet", "left")
    sheet: Column = F.when(F.col("_at").isNotNull(), F.raise_error(F.concat(F.lit("layout changed at "), F.col("_at")))).otherwise(F.col("sheet"))
    return holdings.rank_holdings(checked.withColumn("sheet", sheet).drop("_at"))


def filing_label(name: Column, company: Column, fiscal_year: Column) -> Column:
    return F.concat(F.coalesce(name, company), F.lit(" ("), company, F.lit(") "), fiscal_year)


def named_by_code(question: Column, name: Column, company: Column) -> Column:
    """A filing's legal name in a question as its code."""
    return F.regexp_replace(question, F.concat(F.lit("(?iU)\\b\\Q"), name, F.lit("\\E")), company)


def link_citations(text: Column, url: Column) -> Column:
    """Every [page N] as a link to that page of the filing."""
    base = F.regexp_replace(F.replace(F.split_part(url, F.lit("#"), F.lit(1)), F.lit(" "), F.lit("%20")), r"\\", "%5C")
    quoted = F.regexp_replace(base, r"\$", r"\\\$")
    return F.regexp_replace(text, F.lit(X.CITATION), F.concat(F.lit("[page $1]("), quoted, F.lit("#page=$1)")))
