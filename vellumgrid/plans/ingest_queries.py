"""Queries over ingest decisions and tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import text as T
from vellumgrid.operators import ingest, tools
from vellumgrid.plans import derived as D
from vellumgrid.plans.evidence_queries import RANKED_SQL, answers, ranked
from vellumgrid.plans.text_queries import statement_pages

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LINKS_SQL = """
select 'C' || p_size as company, 'https://x.y/' || p_partkey as url, p_partkey as pos,
  case when p_partkey % 3 = 0 then 'Annual report 20' || (10 + p_partkey % 15) || '-' || (11 + p_partkey % 15) else 'Report' end as label,
  case when p_partkey % 7 = 0 then 'FY' || (20 + p_partkey % 9) end as given,
  coalesce(case when p_partkey % 7 = 0 then 'FY' || (20 + p_partkey % 9) end, case when p_partkey % 3 = 0 then 'FY' || (11 + p_partkey % 15) end, case when p_partkey % 5 = 0 then 'FY24' end, case when p_partkey % 11 = 0 then 'FY23' end) as fiscal_year
from part
"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = D.load(spark, sf_dir, "part")
    found = part.selectExpr(
        "concat('C', p_size) as company", "concat('https://x.y/', p_partkey) as url", "p_partkey as pos",
        "case when p_partkey % 3 = 0 then concat('Annual report 20', 10 + p_partkey % 15, '-', 11 + p_partkey % 15) else 'Report' end as label", "case when p_partkey % 7 = 0 then concat('FY', 20 + p_partkey % 9) end as given",
    )
    manifest = part.where("p_partkey % 5 = 0").select(F.concat(F.lit("https://x.y/"), F.col("p_partkey").cast("string")).alias("source_url"), F.lit("FY24").alias("fiscal_year"))
    seen = part.where("p_partkey % 11 = 0").select(F.concat(F.lit("https://x.y/"), F.col("p_partkey").cast("string")).alias("url"), F.lit("FY23").alias("fiscal_year"))
    return ingest.candidates(found, manifest, seen)


@query(f"select company, url, fiscal_year from ({LINKS_SQL})")
def candidate_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fiscal year of each candidate report, from the best source that names it."""
    return links(spark, sf_dir).select("company", "url", "fiscal_year")


@query(f"select company, fiscal_year, url from ({LINKS_SQL}) where fiscal_year is not null qualify row_number() over (partition by company order by right(fiscal_year, 2) desc, pos) = 1")
def latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's latest report, the first on a tie."""
    return ingest.latest(links(spark, sf_dir)).select("company", "fiscal_year", "url")


@query(f"select company, url from ({LINKS_SQL}) where fiscal_year is null qualify row_number() over (partition by company order by pos) <= 6")
def reports_to_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six candidates of a company without a year."""
    return ingest.to_open(links(spark, sf_dir)).select("company", "url")


@query("""
select source as company, doc_id as page, case when doc_id % 10 = 0 then 'reason ' || doc_id when length(text) < 300 then 'short' end as excluded from documents
""")
def manual_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer's reasons over the engine's own (P10)."""
    docs = D.load(spark, sf_dir, "documents")
    pages = docs.select(F.col("source").alias("company"), F.col("doc_id").alias("page"), F.when(F.length("text") < 300, "short").alias("excluded"))
    reason = F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.concat(F.lit("reason "), F.col("doc_id").cast("string")))))
    manifest = docs.where("doc_id % 10 = 0").groupBy(F.col("source").alias("company")).agg(reason.alias("quality_exclusions"))
    return ingest.manual_exclusions(pages, manifest).select("company", "page", "excluded")


@query(f"""
with pages as (select company, fiscal_year, page, string_agg(text, chr(10) order by line) as text, max(case when line = 0 and text like '%Balance Sheet%' then 1 else 0 end) as titled from ({D.STATEMENT_SQL}) group by all)
select company, count(*) as n_pages, count(*) filter (page % 7 = 0) as n_excluded, sum(titled)::bigint as n_titled, count(*) filter (page % 2 = 0) as n_multi_column, 0::bigint as n_glyphs, sum(length(text))::bigint as chars from pages group by company
""")
def ingest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read of each company."""
    pages = statement_pages(spark, sf_dir)
    title = T.statement_title(T.lines(F.col("text"))[0])
    return ingest.ingest_profile(pages.withColumns({"title": title, "columns": F.when(F.col("page") % 2 == 0, 2).otherwise(1), "excluded": F.when(F.col("page") % 7 == 0, "x")}))


@query(f"select distinct company from ({RANKED_SQL}) where rank <= 10 and company is not null")
def top_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The companies that any fund holds among its first ten."""
    return ranked(spark, sf_dir).where("eligible and company is not null").select("company").distinct()


@query(f"select question_id, regexp_replace(raw, '\\[page (\\d+)\\]', '[page \\1](https://x.y/' || company || '.pdf#page=\\1)', 'g') as text from ({D.ANSWERS_SQL})")
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations as links to their page of the filing."""
    url = F.concat(F.lit("https://x.y/"), F.col("company"), F.lit(".pdf"))
    return answers(spark, sf_dir).select("question_id", ingest.link_citations(F.col("raw"), url).alias("text"))


@query("""
select event_id, case user_id % 8 when 0 then null when 1 then 'Company must be a code' when 2 then 'Unknown tool or invalid arguments' when 3 then null when 4 then 'Holdings count must be between one and ten'
  when 5 then 'Only holdings have a count' when 6 then 'Unknown tool or invalid arguments' else 'Tool input must be an object' end as error from events
""")
def tool_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls checked before anything is run."""
    kind = F.col("user_id") % 8
    cases = [
        ("company_question", '{"company": "BEL", "question": "total assets"}'), ("company_question", '{"company": 5, "question": "x"}'), ("company_question", '{"company": "BEL"}'), ("fund_disclosure", '{"field": "top_holdings", "count": 3}'),
        ("fund_disclosure", '{"field": "top_holdings", "count": 11}'), ("fund_disclosure", '{"field": "benchmark", "count": 1}'), ("other", "{}"), ("fund_disclosure", "[1]"),
    ]
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in cases]), (kind + 1).cast("int"))
    return tools.validate(D.load(spark, sf_dir, "events").select("event_id", pick(0).alias("tool"), pick(1).alias("input"))).select("event_id", "error")


@query("""
with calls as (select user_id as request_id, event_id as seq, event_type from events)
select request_id, seq, min(seq) over (partition by request_id, event_type) as first from calls
""")
def memoised_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated calls share their first one's result, however their keys are ordered."""
    events = D.load(spark, sf_dir, "events")
    a, b = F.lit('{"company": "AB", "question": "'), F.lit('{"question": "')
    text = F.when(F.col("event_id") % 2 == 0, F.concat(a, F.col("event_type"), F.lit('"}'))).otherwise(F.concat(b, F.col("event_type"), F.lit('", "company": "AB"}')))
    calls = events.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.lit("company_question").alias("tool"), text.alias("input"))
    return tools.memoised(tools.validate(calls)).select("request_id", "seq", "first")


@query("""
with cases as (select o_custkey as case_id, bool_and(o_orderkey % 19 <> 0) as f, count(*) as n from orders group by 1),
r as (select case_id, f, case_id % 5 = 0 as refusal, case_id % 10 in (0, 1) as refused, case_id % 3 <> 0 as judged from cases)
select case_id, not refused and case_id % 4 <> 0 and judged as correct, not refused and f as faithful,
  case when refusal then refused else not refused and case_id % 4 <> 0 and judged and f end as passed from r
""")
def agent_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases graded by what they must contain and by every piece of evidence."""
    orders = D.load(spark, sf_dir, "orders")
    evidence = orders.select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 19 != 0).alias("faithful"))
    c = F.col("case_id")
    results = evidence.select("case_id").distinct().select(
        "case_id", (c % 5 == 0).alias("refusal"), (c % 10).isin(0, 1).alias("refused"), F.when((c % 10).isin(0, 1), "Not in the filing.").otherwise("Assets 5.25").alias("text"),
        F.when(c % 4 == 0, F.array(F.lit("9.99"))).otherwise(F.array(F.lit("5.25"), F.lit("Assets"))).alias("contains"), (c % 3 != 0).alias("judged"),
    )
    return tools.grade_agents(results, evidence)
