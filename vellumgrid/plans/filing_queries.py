"""Queries over the lineage of a filing, and over functions that stand alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import models
from vellumgrid.functions import text as T
from vellumgrid.operators import evidence, holdings, ingest, layout, search, tools
from vellumgrid.plans import derived as D
from vellumgrid.plans import filing
from vellumgrid.plans.evidence_queries import RANKED_SQL, ranked
from vellumgrid.plans.text_queries import CLEAN_SQL, FURNITURE_SQL
from vellumgrid.sources import files
from vellumgrid.sources.tables import keep

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.line_rows(spark, sf_dir)


#: Some pages have a table reading: the page's own rows as a table (taken), one without its figures (refused), or none in time.
FILING_SQL = rf"""
with pages as ({CLEAN_SQL}),
facts as (
  select *, len(regexp_extract_all(replace(replace(text, ' | ', ' '), chr(10), ' '), '[^ ]+')) < 50 as few, case when columns = 2 or spread then 'no table found' when page % 5 = 3 and text like '%Total | %' then '2 figure(s) lost' when page % 5 = 0 then 'timed out' when page % 5 <> 2 then 'no table found' end as gate,
    case when page % 10 = 0 then 'reviewed ' || page end as reason from pages)
select company, page, coalesce(reason, case when few then 'fewer than 50 body words' end) as excluded, case when not few then case when gate is null then 'tables' else 'lines' end end as table_reader, case when not few then gate end as table_gate,
  case page % 4 when 0 then 'standalone' when 1 then 'consolidated' else 'unstated' end as scope, '(₹ in crore)' as units, coalesce(regexp_extract(text, '(^|\n)(As at March 31, 2025 \| As at March 31, 2024)', 2), '') as headers,
  case when few or gate is not null then text else array_to_string(list_transform(string_split(text, chr(10)), lambda r: case when len(string_split(r, ' | ')) = 2 and split_part(r, ' | ', 1) = split_part(r, ' | ', 2) then split_part(r, ' | ', 1) || ' |' else r end), chr(10)) end as text
from facts
"""


@query(FILING_SQL)
def filing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing's pages cleaned, re-read as tables, scoped and judged."""
    # Pages are read three times below: as such, as readings and for their keys.
    pages = keep(filing.clean(lines(spark, sf_dir)))
    plain = (F.col("columns") == 1) & ~F.col("spread")
    table = F.concat(F.lit("|"), F.replace("text", F.lit("\n"), F.lit("|\n|")), F.lit("|"))
    poor = (F.col("page") % 5 == 3) & F.contains("text", F.lit("Total | "))
    markdown = F.when(poor, "|no figures|here|").otherwise(F.replace(table, F.lit(" | "), F.lit("|")))
    readings = pages.where(plain & ((F.col("page") % 5).isin(0, 2) | poor)).select("company", "page", markdown.alias("markdown"), F.lit(True).alias("found"), (F.col("page") % 5 == 0).alias("timed_out"))
    heading = F.when(F.col("page") % 4 == 0, "Standalone Balance Sheet").when(F.col("page") % 4 == 1, "Consolidated Balance Sheet").otherwise("Report")
    keys = pages.select("company", "page")
    reason = F.map_from_entries(F.collect_list(F.when(F.col("page") % 10 == 0, F.struct(F.col("page").cast("string"), F.concat(F.lit("reviewed "), F.col("page").cast("string"))))))
    judged = filing.judge_pages(filing.swap_tables(pages, readings), keys.withColumn("text", heading), keys.groupBy("company").agg(reason.alias("quality_exclusions")))
    return judged.select("company", "page", "excluded", "table_reader", "table_gate", "scope", F.array_join("units", ";").alias("units"), F.array_join("headers", ";").alias("headers"), "text")


@query(f"""
with pages as ({CLEAN_SQL}), kept as (select company, page, text from pages where len(regexp_extract_all(replace(replace(text, ' | ', ' '), chr(10), ' '), '[^ ]+')) >= 50 and page % 10 <> 0)
select company, page, string_agg(distinct row, chr(10) order by row) as rows from (select company, page, unnest(string_split(text, chr(10))) as row from kept) r group by company, page
""")
def filing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a page that is not left out stands in a chunk of it (O3, P12): the rows that its chunks hold."""
    own = keep(lines(spark, sf_dir))
    keys = own.select("company", "page").distinct()
    reason = F.map_from_entries(F.collect_list(F.when(F.col("page") % 10 == 0, F.struct(F.col("page").cast("string"), F.lit("reviewed")))))
    manifest = keys.groupBy("company").agg(reason.alias("quality_exclusions")).withColumn("fiscal_year", F.lit("FY25"))
    chunks = filing.build(own, keys.withColumn("text", F.lit("")), manifest)
    rows = chunks.select("company", "page", F.explode(F.split("text", "\n")).alias("row")).distinct()
    return rows.groupBy("company", F.col("page").cast("int").alias("page")).agg(F.array_join(F.array_sort(F.collect_list("row")), "\n").alias("rows"))


@query(f"select company, regexp_replace(lower(text), '\\d+', '#', 'g') as signature, count(distinct page) as pages from ({D.LINES_SQL}) l semi join ({FURNITURE_SQL}) f using (company, page, line) group by 1, 2")
def furniture_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running heads and footers with the pages they stand on."""
    return ingest.furniture_profile(layout.repaired(lines(spark, sf_dir)))


@query("""
with old as (select 'C' || p_partkey as company, 'FY' || (20 + p_partkey % 5) as fiscal_year, 'a' || p_partkey as sha256 from part where p_partkey % 2 = 0),
new as (select 'C' || p_partkey as company, 'FY' || (20 + p_size % 5) as fiscal_year, case when p_size % 3 = 0 then 'a' else 'b' end || p_partkey as sha256 from part where p_partkey % 3 = 0),
taken as (select new.* from new left join old using (company) where old.company is null or old.fiscal_year < new.fiscal_year or old.sha256 <> new.sha256)
select * from taken union all select * from old anti join taken using (company)
""")
def manifest_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New reports over old ones, unless these are as late and the same."""
    part, key = D.load(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    row = lambda year, sha: [F.concat(F.lit("C"), key).alias("company"), F.concat(F.lit("FY"), (20 + year % 5).cast("string")).alias("fiscal_year"), F.concat(sha, key).alias("sha256")]
    old = part.where("p_partkey % 2 = 0").select(*row(F.col("p_partkey"), F.lit("a")))
    new = part.where("p_partkey % 3 = 0").select(*row(F.col("p_size"), F.when(F.col("p_size") % 3 == 0, "a").otherwise("b")))
    return ingest.upsert_manifest(old, new)


@query(f"""
with rows as (
  select fund, sheet, row, asset_type, name, isin, floor(weight_pct * 100 + 0.5) / 100 as weight_pct, case when try_cast(right(isin, 3) as int) % 2 = 0 then 'K' || right(isin, 5) end as company from ({D.HOLDINGS_SQL})),
r as (select *, case when asset_type = 'domestic equity' then row_number() over (partition by fund, asset_type = 'domestic equity' order by weight_pct desc, row) end as rank from rows)
select fund, row, name, isin, company, weight_pct, rank, coalesce(rank <= 10, false) as eligible from r
""")
def fund_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings built from a long cell grid: reviewed layout, sections, company codes, ranks."""
    own = D.holdings_rows(spark, sf_dir).withColumn("sheet", F.concat(F.lit("F"), F.col("fund").cast("string"), F.when(F.col("asset_type") == holdings.EQUITY, "e").otherwise("d")))
    cell = F.array(*[F.struct(F.lit(c).alias("col"), F.col(v).cast("string").alias("value")) for c, v in (("A", "name"), ("B", "isin"), ("C", "weight_pct"))])
    cells = own.select("sheet", "row", F.explode(cell).alias("c")).select("sheet", "row", "c.col", "c.value")
    sections = own.groupBy(F.col("fund"), "sheet", "asset_type").agg(F.min("row").alias("start"), F.max("row").alias("end"))
    reviewed = own.select("isin").distinct().where(F.substring("isin", -3, 3).cast("int") % 2 == 0).withColumn("company", F.concat(F.lit("K"), F.substring("isin", -5, 5)))
    checks = cells.where("col = 'A' and row = 9")
    built = ingest.build_funds(cells, checks, sections, reviewed, "A", "B", "C")
    return built.select("fund", "row", "name", "isin", "company", F.round("weight_pct", 2).alias("weight_pct"), "rank", "eligible")


@query(f"select distinct fund, company, 'FY25' as fiscal_year from ({RANKED_SQL}) where rank <= 10 and company is not null and company like '%7'")
def accessible_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings that a fund's first ten holdings open to its tools."""
    rows = ranked(spark, sf_dir)
    filings = rows.where("company like '%7'").select("company").distinct().withColumn("fiscal_year", F.lit("FY25"))
    return evidence.accessible(filings, rows).select("fund", "company", "fiscal_year")


@query("""
select s_suppkey as fund, case s_suppkey % 6 when 0 then true when 1 then false when 2 then false when 3 then s_suppkey % 2 = 0 when 4 then false else true end as allowed from supplier
""")
def disclosures_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May a field be read for a request: its date, plan, topic and kind of ratio."""
    cases = [("Top 10 holdings as of 30 September 2026", "top_holdings"), ("Top 10 holdings in August 2025", "top_holdings"), ("Expense of the regular plan", "expense_ratio"), ("What is the total expense ratio", "expense_ratio"), ("Should I buy it, what is the benchmark", "benchmark"), ("Exit load on 2026-08-31", "exit_load")]
    fund = F.col("s_suppkey")
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in cases]), (fund % 6 + 1).cast("int"))
    allowed = tools.disclosure_allowed(pick(0), pick(1), F.lit("2026-09-30"), F.lit("2026-08-31"), F.when(fund % 2 == 0, "TER").otherwise("BER"))
    return D.load(spark, sf_dir, "supplier").select(fund.alias("fund"), allowed.alias("allowed"))


@query("select item_id, unnest(range(1, 4))::int as sample from benchmark")
def question_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question three times."""
    return tools.samples(D.load(spark, sf_dir, "benchmark").select("item_id"), 3)


@query("select s_suppkey, s_name || ' (C' || s_suppkey || ') FY25' as label, 'Assets of C' || s_suppkey || ' in FY25' as coded from supplier")
def filing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings as they are shown, and their legal names in questions as codes."""
    code = F.concat(F.lit("C"), F.col("s_suppkey").cast("string"))
    question = F.concat(F.lit("Assets of "), F.upper("s_name"), F.lit(" in FY25"))
    return D.load(spark, sf_dir, "supplier").select("s_suppkey", ingest.filing_label(F.col("s_name"), code, F.lit("FY25")).alias("label"), ingest.named_by_code(question, F.col("s_name"), code).alias("coded"))


@query("select o_orderkey, o_orderkey % 5 <> 0 and o_custkey % 3 <> 0 and o_custkey % 7 <> 0 as faithful from orders")
def judged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's word, overruled by its own list of computed figures."""
    c = F.col("o_custkey")
    computed = F.array(F.struct((c % 3 != 0).alias("labelled"), F.lit(True).alias("arithmetic_right")), F.struct(F.lit(True).alias("labelled"), (c % 7 != 0).alias("arithmetic_right")))
    return D.load(spark, sf_dir, "orders").select("o_orderkey", models.judged_faithful(F.col("o_orderkey") % 5 != 0, computed).alias("faithful"))


@query("select event_id, user_id % 3 = 0 and event_id % 5 <> 0 and event_id % 2 = 0 as usable from events")
def usable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that may become evidence: cited, and no guard had to warn (B2)."""
    e, u = F.col("event_id"), F.col("user_id")
    some = lambda c, kind: F.when(c, F.array().cast(f"array<{kind}>")).otherwise(F.array(F.lit("1").cast(kind)))
    text = F.when(e % 5 == 0, "No figure is cited here.").otherwise("Assets were 5.25 [page 3].")
    rows = D.load(spark, sf_dir, "events").select("event_id", (e % 2 == 1).alias("refused"), text.alias("text"), some(u % 3 != 1, "int").alias("invalid_citations"), some(u % 3 != 2, "string").alias("ungrounded"), some(F.lit(True), "string").alias("scrubbed"))
    return tools.strict(rows).select("event_id", "usable")


@query("select vec_id, true as is_unit, round(embedding[1]::double, 4) as first from embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of any length as vectors of length one."""
    longer = D.load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * (1 + F.col("vec_id") % 9)).alias("v"))
    own = longer.select("vec_id", search.unit(F.col("v")).alias("u"))
    norm = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)
    return own.select("vec_id", (F.abs(norm - 1) < 1e-9).alias("is_unit"), F.round(F.get("u", F.lit(0)), 4).alias("first"))


@query("""
select event_id, case event_id % 4 when 0 then '10.0.0.' || user_id % 250 when 1 then '192.168.0.1' when 2 then '10.1.1.1' else null end as address from events
""")
def client_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hop of a forwarded-for header, else the socket's address."""
    e = F.col("event_id") % 4
    first = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"))
    header = F.when(e == 0, F.concat(F.lit(" "), first, F.lit(" , 172.16.0.1"))).when(e == 1, F.lit(" ,10.9.9.9")).when(e == 2, F.lit("10.1.1.1"))
    return D.load(spark, sf_dir, "events").select("event_id", T.client_address(header, F.when(e == 1, "192.168.0.1")).alias("address"))


@query("""
select question_id, page, chunk, row_number() over (partition by question_id order by page, chunk) as place, page % 3 = 1 as cited, case when chunk > 0 then 'same page as a hit' else 'similarity 0.750' end as how
from (select l_suppkey as question_id, l_orderkey as page, l_linenumber as chunk from lineitem group by all) c
""")
def context_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context in the order in which a reader looks for pages."""
    rows = D.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("question_id"), F.col("l_orderkey").cast("int").alias("page"), F.col("l_linenumber").alias("chunk")).distinct()
    text = F.when(F.col("page") % 3 == 1, F.concat(F.lit("So it is [page "), F.col("page").cast("string"), F.lit("]."))).otherwise("So it is.")
    shown = search.display(rows.withColumns({"sibling": F.col("chunk") > 0, "score": F.lit(0.75)}), text)
    return shown.select("question_id", F.col("page").cast("long").alias("page"), "chunk", F.col("place").cast("long").alias("place"), "cited", "how")


@query("""
select o_orderkey, case o_orderkey % 4 when 1 then 'Not in the filing.' when 2 then 'Not in the filing' else case when o_orderkey % 4 = 0 then 'Not in the filing.' else 'Assets 5.25 [page 2].' end end as text, o_orderkey % 4 <> 3 as refusal from orders
""")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals, and what a model went on to say after one, cut."""
    e = F.col("o_orderkey") % 4
    raw = F.when(e == 0, "Not in the filing. But revenue was 146.98 [page 98].").when(e == 1, "Not in the filing.").when(e == 2, "Not in the filing").otherwise("Assets 5.25 [page 2].")
    cut = D.load(spark, sf_dir, "orders").select("o_orderkey", T.strip_after_refusal(raw).alias("text"))
    return cut.withColumn("refusal", T.is_refusal(F.col("text")))


@query("""
select 2 as place, 'C' || s_suppkey as company, '| C' || s_suppkey || ' | ' || s_name || ' | FY25 | https://x.y/' || s_suppkey || ' | abc |' as line from supplier
union all select 0, '', '| Company | Name | Year | Source | SHA-256 |' union all select 1, '', '|---|---|---|---|---|'
""")
def sources_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as a Markdown table."""
    key = F.col("s_suppkey").cast("string")
    rows = D.load(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), key).alias("company"), F.col("s_name").alias("name"), F.lit("FY25").alias("fiscal_year"), F.concat(F.lit("https://x.y/"), key).alias("source_url"), F.lit("abc").alias("sha256"))
    return files.sources_table(rows)
