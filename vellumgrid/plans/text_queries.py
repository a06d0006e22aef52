"""Queries over text functions, pages, layout and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import text as T
from vellumgrid.operators import chunking, layout
from vellumgrid.plans import derived as D
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


def _kind() -> Column:
    """What a statement row is to its page, by what the page's own rows declare."""
    text = F.col("text")
    title = F.when(F.col("line") == 0, T.statement_title(text))
    listed = lambda holds: F.array_compact(F.array(F.when(holds, text)))
    return chunking.context_kind(text, title, listed(T.is_period_header(text)), F.filter(T.cells(text), T.is_unit_declaration))


@query(f"""
select company, fiscal_year, page, line, 'title' as kind from ({D.STATEMENT_SQL}) where regexp_matches(lower(text), '^(standalone|consolidated) balance sheet as at march 31, \\d{{4}}$')
union all select company, fiscal_year, page, line, 'unit' from ({D.STATEMENT_SQL}) where text = '(₹ in crore)'
union all select company, fiscal_year, page, line, 'header' from ({D.STATEMENT_SQL}) where regexp_matches(text, '^(As at|year ended) March 31, \\d{{4}} \\| ')
""")
def context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, unit and period rows of the statement pages."""
    # Kept, as a text is looked at many times and would be put together anew for each look.
    rows = keep(D.statement_rows(spark, sf_dir))
    return rows.select("company", "fiscal_year", "page", "line", _kind().alias("kind")).where("kind is not null")


@query(f"""
with rows as (
  select *, case when line = 0 and text like '%Balance Sheet%' then 'title' when text = '(₹ in crore)' then 'unit' when line in (2, 20) then 'header' end as kind from ({D.STATEMENT_SQL}))
select company, fiscal_year, page, line, {', '.join(f"last_value(case when kind = '{k}' then text end ignore nulls) over (partition by company, fiscal_year, page order by line rows between unbounded preceding and 1 preceding) as {k}_above" for k in ('title', 'unit', 'header'))}
from rows
""")
def context_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title, unit and period above each row."""
    rows = chunking.context_in_force(D.statement_rows(spark, sf_dir).withColumn("kind", _kind()))
    return rows.select("company", "fiscal_year", "page", "line", "title_above", "unit_above", "header_above")


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.statement_rows(spark, sf_dir)
    return rows.groupBy("company", "fiscal_year", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), "\n").alias("text"))


@query(f"""
select company, fiscal_year, page, case when max(case when line = 0 and text like 'Standalone%' then 1 else 0 end) = 1 then 'standalone' when max(case when line = 0 and text like 'Consolidated%' then 1 else 0 end) = 1 then 'consolidated' else 'unstated' end as scope
from ({D.STATEMENT_SQL}) group by all
""")
def page_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement scope of each page by its headings."""
    return statement_pages(spark, sf_dir).select("company", "fiscal_year", "page", T.heading_scope(F.col("text")).alias("scope"))


#: The packer as recursion over a page's rows: where the chunk starts, the tokens before that, whether it holds figures.
#: Running token sums, the last row of each kind and the rows that may be carried over come from windows and a self join.
CHUNKS_SQL = rf"""
with recursive raw as ({D.STATEMENT_SQL}),
kinds as (
  select company, fiscal_year, page, text, row_number() over (partition by company, fiscal_year, page order by line) as n,
    case when line = 0 and text like '%Balance Sheet%' then 't' when text = '(₹ in crore)' then 'u' when line in (2, 20) then 'h' end as kind,
    len(regexp_extract_all(text, '\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]')) as tok, line between 3 and 14 or line = 21 as fig from raw),
rows as (
  select *, sum(tok) over w as upto, {', '.join(f"max(case when kind = '{k}' then n end) over w as {k}, last_value(case when kind = '{k}' then tok end ignore nulls) over w as {k}tok, last_value(case when kind = '{k}' then text end ignore nulls) over w as {k}text" for k in 'tuh')},
    coalesce(max(case when fig then n end) over (partition by company, fiscal_year, page order by n rows between unbounded preceding and 1 preceding), 0) as figs
  from kinds window w as (partition by company, fiscal_year, page order by n)),
tails as (
  select r.company, r.fiscal_year, r.page, r.n, coalesce(min(b.n), r.n) as tail, r.upto - r.tok - coalesce(sum(b.tok), 0) as tail_before
  from rows r left join rows b on b.company = r.company and b.fiscal_year = r.fiscal_year and b.page = r.page and b.n < r.n and b.n > r.figs and r.upto - r.tok - b.upto + b.tok <= 40 group by r.company, r.fiscal_year, r.page, r.n, r.upto, r.tok),
ready as (select rows.*, tail, tail_before from rows join tails using (company, fiscal_year, page, n)),
fold as (
  select company, fiscal_year, page, n, 0 as chunk, cast(1 as bigint) as start, cast(0 as hugeint) as before, fig from ready where n = 1
  union all
  select company, fiscal_year, page, n, chunk + (hard or soft)::int, case when hard then n when soft then case when again then n else s end else start end,
    case when hard then upto - tok when soft then case when again then upto - tok else sb end else before end, case when hard or soft then rfig else fig or rfig end
  from (
    select *, kind is not null and fig as hard, upto - before + {' + '.join(f"case when {k} < start then {k}tok else 0 end" for k in 'tuh')} > 120 as soft,
      upto - sb + {' + '.join(f"case when {k} < s then {k}tok else 0 end" for k in 'tuh')} > 120 as again
    from (
      select f.company, f.fiscal_year, f.page, f.chunk, f.start, f.before, f.fig, r.fig as rfig, r.n, r.kind, r.tok, r.upto, r.t, r.u, r.h, r.ttok, r.utok, r.htok,
        greatest(f.start, r.tail) as s, case when r.tail > f.start then r.tail_before else f.before end as sb
      from fold f join ready r on r.company = f.company and r.fiscal_year = f.fiscal_year and r.page = f.page and r.n = f.n + 1) step) closing),
ends as (select company, fiscal_year, page, chunk, max(n) as last, min(start) as start from fold group by company, fiscal_year, page, chunk)
select e.company, e.fiscal_year, e.page, e.chunk, sum(b.tok) + min({' + '.join(f"case when l.{k} < e.start then l.{k}tok else 0 end" for k in 'tuh')}) as tokens,
  concat({', '.join(f"min(case when l.{k} < e.start then l.{k}text || chr(10) else '' end)" for k in 'tuh')}, string_agg(b.text, chr(10) order by b.n)) as text
from ends e join rows l on l.company = e.company and l.fiscal_year = e.fiscal_year and l.page = e.page and l.n = e.last
join rows b on b.company = e.company and b.fiscal_year = e.fiscal_year and b.page = e.page and b.n between e.start and e.last
group by e.company, e.fiscal_year, e.page, e.chunk
"""


@query(CHUNKS_SQL)
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the statement pages with the context in force."""
    pages = chunking.page_context(statement_pages(spark, sf_dir)).withColumn("scope", T.heading_scope(F.col("text")))
    chunks = chunking.chunk_pages(pages, target=120, overlap=40)
    return chunks.select("company", "fiscal_year", F.col("page").cast("int").alias("page"), "chunk", F.col("tokens").cast("long").alias("tokens"), "text")


@query(r"""
with pages as (
  select source as company, doc_id as page, text, len(regexp_extract_all(text, '[^\x09-\x0D\x1C-\x20\x85\xA0]+')) as words from documents),
rows as (
  select page, unnest(string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10))) as row from pages),
suspects as (
  select page, count(*) as n from rows
  where len(string_split(row, ' | ')) >= 2
    and len(list_filter(string_split(row, ' | '), lambda c: trim(c) <> '' and regexp_full_match(trim(c), '[\d,.()%₹\s−–-]+'))) = 0
    and len(list_filter(string_split(row, ' | '), lambda c: len(regexp_extract_all(c, '\b[a-zA-Z]+\b')) >= 4)) >= 2
  group by page)
select company, page, case when words < 50 then 'fewer than 50 body words' when coalesce(n, 0) >= 8 then 'quality check: possible interleaved prose columns' end as excluded
from pages left join suspects using (page)
""")
def excluded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why pages are left out: few words, interleaved prose."""
    docs = D.load(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("company"), F.col("doc_id").alias("page"), chunking.excluded(F.coalesce("text", F.lit(""))).alias("excluded"))


@query("select source as company, count(*) as n_pages, avg(case when trim(coalesce(text, '')) = '' then 1 else 0 end) as share, avg(case when trim(coalesce(text, '')) = '' then 1 else 0 end) <= 0.2 as born_digital from documents group by source")
def textless_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of pages without text by company."""
    return chunking.textless(D.load(spark, sf_dir, "documents").select(F.col("source").alias("company"), "text"))


@query(r"""
select distinct doc_id as page, signature from (
  select doc_id, regexp_replace(lower(unnest(string_split(text, chr(10)))), '\d+', '#', 'g') as signature, source from documents) rows
semi join (
  select source, signature from (select distinct source, doc_id, regexp_replace(lower(unnest(string_split(text, chr(10)))), '\d+', '#', 'g') as signature from documents) lines
  join (select source, count(*) as pages from documents group by source) using (source)
  group by source, signature, pages having count(*) >= greatest(3, ceil(0.10 * pages))) running using (source, signature)
""")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that run through a tenth of their source's pages."""
    docs = D.load(spark, sf_dir, "documents")
    n = docs.groupBy("source").agg(F.count("*").alias("pages"))
    lines = docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("source", "doc_id", T.signature(F.col("line")).alias("signature")).distinct()
    need = F.greatest(F.lit(X.MIN_FURNITURE_PAGES), F.ceil(F.col("pages") * X.MIN_FURNITURE_SHARE))
    running = lines.groupBy("source", "signature").agg(F.count("*").alias("n")).join(n, "source").where(F.col("n") >= need)
    return lines.join(running.select("source", "signature"), ["source", "signature"], "left_semi").select(F.col("doc_id").alias("page"), "signature").distinct()


FURNITURE_SQL = f"""
with lines as ({D.LINES_SQL}),
sizes as (select company, size, sum(length(text)) as chars from lines group by all),
body as (select company, size as body_size from sizes qualify row_number() over (partition by company order by chars desc, size) = 1),
pages as (select company, count(distinct page) as n_pages from lines group by all),
marked as (
  select lines.*, n_pages, regexp_replace(lower(text), '\\d+', '#', 'g') as signature from lines join body using (company) join pages using (company)
  where (y1 <= height * 0.15 or y0 >= height * (1 - 0.15)) and abs(size - body_size) > 0.3 and not (text like '(%' or text like 'March 31, %')),
gaps as (select *, case when y0 - lag(y0) over w > 3.0 then 1 else 0 end as new from marked window w as (partition by company, signature order by y0, page, line)),
clustered as (select *, sum(new) over (partition by company, signature order by y0, page, line rows unbounded preceding) as cluster from gaps),
running as (select company, signature, cluster from clustered group by company, signature, cluster, n_pages having count(distinct page) >= greatest(3, ceil(n_pages * 0.10)))
select company, page, line from clustered semi join running using (company, signature, cluster)
"""


@query(FURNITURE_SQL)
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running heads and footers by size, margin, signature and height."""
    return layout.furniture(layout.repaired(D.line_rows(spark, sf_dir)))


@query(f"select company, size as body_size from (select company, size, sum(length(text)) as chars from ({D.LINES_SQL}) group by all) qualify row_number() over (partition by company order by chars desc, size) = 1")
def modal_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body size of each company's pages (A1)."""
    return layout.modal_size(D.line_rows(spark, sf_dir))


@query(f"select company, page, block, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n_lines from ({D.LINES_SQL}) group by company, page, block")
def block_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes of blocks (A4)."""
    return layout.blocks(D.line_rows(spark, sf_dir))


@query(f"""
with lines as ({D.LINES_SQL}),
gaps as (select company, page, line, case when x0 - lag(x0) over (partition by company, page order by x0, line) > 0.15 * width then 1 else 0 end as new from lines)
select company, page, line, cast(sum(new) over (partition by company, page order by x0, line rows unbounded preceding) as int) as cluster from gaps join lines using (company, page, line)
""")
def column_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column starts by the gap between left edges."""
    lines = D.line_rows(spark, sf_dir)
    return layout.gap_clusters(lines, ("company", "page"), "x0", F.col("width") * X.COLUMN_GAP, ("line",)).select("company", "page", "line", "cluster")


@query(f"""
select company, page, max(width) > 1.2 * max(height) and count(*) filter (x0 < width / 2 - 5 and x1 > width / 2 + 5) <= 0.02 * count(*) and count(*) filter ((x0 + x1) / 2 < width / 2) between 1 and count(*) - 1 as spread
from ({D.LINES_SQL}) group by company, page
""")
def page_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-page spreads."""
    return layout.spreads(D.line_rows(spark, sf_dir))


#: Where the lines of every shape end up: group of reading, row and cell; what is joined or split is written out.
CLEAN_SQL = f"""
with lines as ({D.LINES_SQL}), furniture as ({FURNITURE_SQL}),
body as (select * from lines anti join furniture using (company, page, line) where line not in (95, 96, 98)),
placed as (
  select company, page, shape, line, x0,
    case when line = 90 then case shape when 1 then 90 when 3 then 20 else 99 end when line = 91 then 0 when line = 92 then 50 when line in (93, 94) then 1 when line in (97, 99, 100) then 2 when line > 92 then 3
      when shape = 1 then case when line < 4 then 1 + line // 2 + (line % 2) * 20 else 60 + line // 2 + (line % 2) * 35 end
      when shape = 3 then 1 + line // 2 + (line % 2) * 30 else 10 + line // 2 end as row,
    case line when 91 then '(₹ in crore)' when 93 then 'As at March 31, 2025' when 94 then 'As at March 31, 2024' when 97 then 'Dues of creditors other than small enterprises' when 102 then replace(text, ' ', ' | ') else text end as text
  from body),
rows as (select company, page, shape, row, string_agg(text, ' | ' order by x0) as text from placed group by all)
select company, page, string_agg(text, chr(10) order by row) as text, case when shape = 1 then 2 else 1 end as columns, shape = 3 as spread, cast(null as varchar) as title,
  coalesce((select string_agg(l.text, chr(10) order by l.line) from lines l semi join furniture using (company, page, line) where l.company = rows.company and l.page = rows.page), '') as furniture
from rows group by company, page, shape
"""


@query(CLEAN_SQL)
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages rebuilt from their lines: columns, bands, spreads, rows, cells."""
    pages = layout.clean_pages(layout.repaired(D.line_rows(spark, sf_dir)))
    return pages.select("company", "page", "text", "columns", "spread", "title", F.array_join("furniture", "\n").alias("furniture"))


@query(f"""
select company, fiscal_year, page, string_agg(figure, ',' order by figure) as figures from (
  select distinct company, fiscal_year, page, figure from (
    select company, fiscal_year, page, unnest(string_split(text, ' | ')) as figure from ({D.STATEMENT_SQL}) where line between 3 and 14 or line = 21) cells
  where regexp_full_match(figure, '\\d+\\.\\d+') or (regexp_full_match(figure, '\\d{{3,}}') and not regexp_full_match(figure, '(19|20)\\d\\d'))) found
group by company, fiscal_year, page
""")
def figures_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct checkable figures each page prints."""
    return statement_pages(spark, sf_dir).select("company", "fiscal_year", "page", F.array_join(T.figures(F.col("text")), ",").alias("figures"))


@query(r"""
with q as (select item_id as question_id, 'Total assets of C' || item_id || ' in FY' || (20 + item_id % 10) || ' and FY 20' || (10 + item_id % 9) || '-' || (11 + item_id % 9) || ' standalone' as question, 'C' || item_id as company from benchmark),
y as (select *, 2000 + 20 + question_id % 10 as a, 2000 + 11 + question_id % 9 as b from q)
select question_id, question || ' as at March 31, ' || a || case when a <> b then ' as at March 31, ' || b else '' end as expanded,
  'total assets' as keywords, 'standalone' as scope from y
""")
def question_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal years spelt out, keyword form and requested scope."""
    q = D.load(spark, sf_dir, "benchmark").selectExpr(
        "item_id as question_id",
        "concat('Total assets of C', item_id, ' in FY', 20 + item_id % 10, ' and FY 20', 10 + item_id % 9, '-', 11 + item_id % 9, ' standalone') as question",
        "concat('C', item_id) as company",
    )
    text, company = F.col("question"), F.col("company")
    return q.select("question_id", T.expand_fiscal_years(text).alias("expanded"), T.keyword_query(text, company).alias("keywords"), T.requested_scope(text).alias("scope"))


@query(f"""
with spans as (
  select company, 'FY' || right(cast(y + 1 as varchar), 2) as fiscal_year from (
    select company, fiscal_year, page, 2000 + (page * 7 + length(company)) % 20 as y from (select distinct company, fiscal_year, page from ({D.STATEMENT_SQL})) p where page <= 6) s),
counts as (select company, fiscal_year, count(*) as n from spans group by all)
select company, fiscal_year, n from counts qualify row_number() over (partition by company order by n desc, fiscal_year desc) = 1
""")
def fiscal_year_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fiscal year a report's first pages name most."""
    pages = D.statement_rows(spark, sf_dir).select("company", "fiscal_year", "page").distinct()
    y = F.lit(2000) + (F.col("page") * 7 + F.length("company")) % 20
    text = F.concat(F.lit("Report for "), y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"), F.lit(" not 2019-25"))
    return chunking.fiscal_year_vote(pages.select("company", "page", text.alias("text")))


@query(r"""
with links as (
  select page_id, url as base, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href=["'']([^"'']+?)(?:[?#][^"'']*)?["''][^>]*>(.*?)</a>', 1)) as href,
    unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href=["'']([^"'']+?)(?:[?#][^"'']*)?["''][^>]*>(.*?)</a>', 2)) as label,
    unnest(range(len(regexp_extract_all(html, '(?is)<a\b[^>]*?href=["'']([^"'']+?)(?:[?#][^"'']*)?["''][^>]*>(.*?)</a>', 1)))) as pos
  from pages),
clean as (
  select page_id, pos, base, href, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(label, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as label from links),
placed as (
  select page_id, pos, label, replace(case when regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then href when href like '/%' then regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href else href end, '&amp;', '&') as url from clean)
select page_id, url, arg_min(label, pos) as label, cast(min(pos) as int) as pos from placed group by page_id, url
""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of raw pages, absolute, with the first label of each."""
    return files.html_links(D.load(spark, sf_dir, "pages"))
