"""Queries over search, fusion, packing, the index and evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import text as T
from vellumgrid.operators import chunking, evals, search
from vellumgrid.plans import derived as D
from vellumgrid.sources import index
from vellumgrid.sources.tables import keep

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Every row whose id is divisible by 50 asks all rows.
VECTOR_SQL = """
with dots as (
  select q.vec_id as question_id, v.vec_id as key, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1]::double * p[2]::double)) as score
  from embeddings q, embeddings v where q.vec_id % 50 = 0)
select question_id, key, score, row_number() over (partition by question_id order by score desc, key) as rank from dots qualify rank <= 50
"""
BM25_SQL = r"""
with terms as (select doc_id as key, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from documents),
lengths as (select doc_id as key, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) as length from documents),
totals as (select count(*) as n_docs, avg(length) as mean_length from lengths),
tf as (select key, term, count(*) as tf from terms group by all),
df as (select term, count(*) as df from tf group by term),
asked as (select distinct item_id as question_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from benchmark),
scored as (
  select question_id, key, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))) as score
  from asked join tf using (term) join df using (term) join lengths using (key), totals group by question_id, key)
select question_id, key, score, row_number() over (partition by question_id order by round(score, 9) desc, key) as rank from scored qualify rank <= 50
"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")


def vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return search.vector_topk(rows, rows.where("key % 50 = 0").select(F.col("key").alias("question_id"), "vector"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", "source", "lang")


@query(f"select question_id, key, rank, round(score, 5) as score from ({VECTOR_SQL})")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 nearest vectors of each asking vector."""
    return vector_hits(spark, sf_dir).select("question_id", "key", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query(f"select question_id, key, rank, round(score, 5) as score from ({BM25_SQL})")
def keyword_topk_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each question by BM25."""
    return search.keyword_topk(documents(spark, sf_dir), questions(spark, sf_dir)).select("question_id", "key", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query(f"""
with v as (select question_id // 50 as question_id, key, rank from ({VECTOR_SQL})), w as (select question_id, key, rank from ({BM25_SQL})),
fused as (
  select question_id, key, coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + w.rank), 0) as rrf, v.rank as a, w.rank as b from v full join w using (question_id, key))
select question_id, key, round(rrf, 9) as rrf, row_number() over (partition by question_id order by rrf desc, a nulls last, b nulls last) as rank from fused qualify rank <= 8
""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and keyword rankings fused to the best eight (J5, W5, T2); question n is vector 50n and item n."""
    vector = vector_hits(spark, sf_dir).withColumn("question_id", F.expr("question_id div 50"))
    fused = search.fuse(vector, search.keyword_topk(documents(spark, sf_dir), questions(spark, sf_dir)))
    return fused.select("question_id", "key", F.round("rrf", 9).alias("rrf"), F.col("rank").cast("long").alias("rank"))


@query("""
with rows as (select vec_id as key, embedding, 'C' || label as company, case vec_id % 4 when 0 then 'standalone' when 1 then 'consolidated' when 2 then 'mixed' else 'unstated' end as scope from embeddings),
dots as (
  select q.vec_id as question_id, key, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1]::double * p[2]::double)) as score
  from embeddings q, rows v where q.vec_id % 50 = 0 and company = 'C3' and scope in ('standalone', 'unstated', 'mixed'))
select question_id, key, round(score, 5) as score, row_number() over (partition by question_id order by score desc, key) as rank from dots qualify rank <= 50
""")
def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors within one filing and statement scope (P11, K)."""
    rows = embeddings(spark, sf_dir)
    tagged = rows.withColumns({"company": F.concat(F.lit("C"), F.col("label").cast("string")), "scope": F.element_at(F.array(*map(F.lit, ("standalone", "consolidated", "mixed", "unstated"))), (F.col("key") % 4 + 1).cast("int"))})
    hits = search.vector_topk(search.in_scope(tagged, "C3", "standalone"), rows.where("key % 50 = 0").select(F.col("key").alias("question_id"), "vector"))
    return hits.select("question_id", "key", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(r"""
with docs as (select doc_id as key, source, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as words from documents),
totals as (select source, count(*) as n_docs, avg(len(words)) as mean_length from docs group by source),
tf as (select key, source, term, length, count(*) as tf from (select key, source, len(words) as length, unnest(words) as term from docs) group by all),
df as (select source, term, count(*) as df from tf group by all),
asked as (select distinct item_id as question_id, 'src' || item_id % 20 as source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from benchmark),
scored as (
  select question_id, key, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))) as score
  from asked join tf using (source, term) join df using (source, term) join totals using (source) group by question_id, key)
select question_id, key, round(score, 5) as score, row_number() over (partition by question_id order by round(score, 9) desc, key) as rank from scored qualify rank <= 50
""")
def bm25_per_filing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with the statistics of the asked filing alone."""
    asked = questions(spark, sf_dir).withColumn("source", F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string")))
    hits = search.keyword_topk(documents(spark, sf_dir), asked, group="source")
    return hits.select("question_id", "key", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


#: Chunks are the lines of documents, a source is one filing and one question; seeds are its longest lines.
CHUNKS_SQL = r"""
select source as company, 'FY25' as fiscal_year, doc_id as page, unnest(range(len(string_split(text, chr(10))))) as chunk,
  unnest(list_transform(string_split(text, chr(10)), lambda t: len(regexp_extract_all(t, '[\p{L}\p{N}]+')))) as tokens from documents
"""


@query(rf"""
with recursive chunks as ({CHUNKS_SQL}),
seeds as (select *, row_number() over (partition by company order by tokens desc, page, chunk) as rank from chunks qualify rank <= 8),
seen as (select company, page, min(rank) as first_seen from seeds group by all),
candidates as (
  select company, page, chunk, tokens, 0 as sibling, rank as o1, 0 as o2, 0 as o3 from seeds
  union all select c.company, c.page, c.chunk, c.tokens, 1, first_seen, abs(c.chunk - s.chunk), s.rank
  from chunks c join seeds s on c.company = s.company and c.page = s.page and c.chunk <> s.chunk join seen on seen.company = c.company and seen.page = c.page),
once as (select * from candidates qualify row_number() over (partition by company, page, chunk order by sibling, o1, o2, o3) = 1),
listed as (select *, row_number() over (partition by company order by sibling, o1, o2, o3, chunk, page) as i from once),
fold as (
  select company, i, page, chunk, tokens, sibling, case when tokens <= 1500 then tokens else 0 end as spent, tokens <= 1500 as kept from listed where i = 1
  union all
  select l.company, l.i, l.page, l.chunk, l.tokens, l.sibling, f.spent + case when f.spent + l.tokens <= 1500 then l.tokens else 0 end, f.spent + l.tokens <= 1500
  from fold f join listed l on l.company = f.company and l.i = f.i + 1)
select company as question_id, fold.page, chunk, tokens, sibling = 1 as sibling, row_number() over (partition by company order by first_seen, chunk) as position
from fold join seen using (company, page) where kept
""")
def pack_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds and their pages' other chunks within a token budget."""
    docs = D.load(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda t: F.size(T.tokens(t)))
    chunks = docs.select(F.col("source").alias("company"), F.lit("FY25").alias("fiscal_year"), F.col("doc_id").alias("page"), F.posexplode(lines).alias("chunk", "tokens"))
    order = Window.partitionBy("company").orderBy(F.desc("tokens"), "page", "chunk")
    hits = chunks.withColumn("rank", F.row_number().over(order)).where("rank <= 8").withColumn("question_id", F.col("company"))
    packed = search.pack_context(hits, chunks, budget=1500)
    return packed.select("question_id", "page", *(F.col(c).cast("long").alias(c) for c in ("chunk", "tokens", "position")), "sibling")


@query(rf"""
with old as ({CHUNKS_SQL}),
new as (select company, fiscal_year, page, chunk, tokens + 1 as tokens from old where company = 'src3' and page % 3 = 0)
select company, count(*) as n_rows, count(distinct page) as n_pages, sum(tokens)::bigint as tokens from (select * from old where company <> 'src3' union all select * from new) group by company
""")
def replace_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filing replaced: its rows go, the new ones come."""
    docs = D.load(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda t: F.struct(F.size(T.tokens(t)).alias("tokens"), t.alias("text")))
    old = docs.select(F.col("source").alias("company"), F.lit("FY25").alias("fiscal_year"), F.col("doc_id").alias("page"), F.posexplode(lines).alias("chunk", "c")).select("company", "fiscal_year", "page", "chunk", "c.tokens", "c.text")
    new = old.where("company = 'src3' and page % 3 = 0").withColumn("tokens", F.col("tokens") + 1)
    return index.index_manifest(index.replaced(old, new)).select("company", "n_rows", "n_pages", "tokens")


@query(f"""
with hits as (select question_id, key, score, rank from ({VECTOR_SQL})),
best as (select question_id, max(score) as best from hits where rank <= 8 group by 1),
expected as (select vec_id as question_id, case when vec_id % 150 = 0 then null else vec_id + 1 end as key from embeddings where vec_id % 50 = 0),
found as (select question_id, min(rank) as first from hits join expected using (question_id, key) group by 1)
select count(*) filter (key is not null) as n_answerable, count(*) filter (key is not null and coalesce(first, 6) <= 5) as n_hits,
  round(min(best) filter (key is not null), 5) as weakest, round(max(best) filter (key is null), 5) as strongest,
  round(min(best) filter (key is not null) - max(best) filter (key is null), 5) as gap
from expected left join best using (question_id) left join found using (question_id)
""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits within five, and the gap between answerable and other questions."""
    hits = vector_hits(spark, sf_dir)
    asked = embeddings(spark, sf_dir).where("key % 50 = 0").select(F.col("key").alias("question_id"), F.when(F.col("key") % 150 != 0, F.col("key") + 1).alias("key"))
    out = evals.retrieval_metrics(hits, asked)
    return out.select("n_answerable", "n_hits", *(F.round(c, 5).alias(c) for c in ("weakest", "strongest", "gap")))


@query(f"""
with hits as (select question_id, key, rank, score from ({BM25_SQL}) where rank <= 20)
select question_id, key, rank as rank_before, row_number() over (partition by question_id order by key % 7 desc, rank) as rank_after from hits
""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty hits in the order of another score, with both ranks."""
    hits = search.keyword_topk(documents(spark, sf_dir), questions(spark, sf_dir), k=X.RERANK_DEPTH)
    return search.rerank(hits, F.col("key") % 7).select("question_id", "key", F.col("rank_before").cast("long").alias("rank_before"), F.col("rank_after").cast("long").alias("rank_after"))


@query("""
with scores as (select quality = 1 as answerable, n_chars % 1000 as score from labels join documents using (doc_id)),
cuts as (select (score + lead(score) over (order by score)) / 2 as t from (select distinct score from scores)),
counted as (select t, (select count(*) from scores where answerable and score < t) + (select count(*) from scores where not answerable and score >= t) as errors from cuts where t is not null)
select t as threshold, errors from counted order by errors, t desc limit 1
""")
def gate_threshold_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut between scores with the fewest errors."""
    docs = D.load(spark, sf_dir, "documents")
    scores = D.load(spark, sf_dir, "labels").join(docs, "doc_id").select((F.col("quality") == 1).alias("answerable"), (F.col("n_chars") % 1000).alias("score"))
    return evals.fit_threshold(scores)


@query(rf"""
select company, count(*) as n_chunks, count(distinct page) as n_pages, min(tokens) as smallest, median(tokens)::double as median, max(tokens) as largest, count(*) filter (tokens > 200) as over_target
from (select source as company, doc_id as page, len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+')) as tokens from documents) group by company
""")
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest, median and largest chunk of each filing, a document being a chunk (A5)."""
    chunks = documents(spark, sf_dir).select(F.col("source").alias("company"), F.col("key").alias("page"), F.size(T.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("tokens"))
    return chunking.chunk_sizes(chunks, "company")


@query(rf"""
with hits as (select question_id, key, rank from ({BM25_SQL}) where rank <= 8),
context as (select question_id, key as page, rank as position, coalesce(text, '') as text, len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+')) as tokens from hits join documents on doc_id = key),
expected as (select item_id as question_id, substr(text, 1, 40) as answer_text from benchmark),
held as (select question_id, min(position) filter (contains(text, answer_text)) as first, count(*) as n_chunks, sum(tokens)::bigint as tokens from context join expected using (question_id) group by 1)
select question_id, held.first is not null as present, c.page, case when held.first is not null then 0 end as chunk, coalesce(n_chunks, 0) as n_chunks, coalesce(held.tokens, 0) as tokens
from expected left join held using (question_id) left join context c on c.question_id = expected.question_id and c.position = held.first
""")
def answer_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the best eight documents hold an item's first forty characters, and where first."""
    asked = D.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.substring("text", 1, 40).alias("answer_text"))
    docs = documents(spark, sf_dir)
    # Eight rows a question meet the documents, whose texts stay where they are; only texts of hits are cut into tokens.
    hits = keep(search.keyword_topk(docs, questions(spark, sf_dir), k=8))
    text = F.coalesce("text", F.lit(""))
    found = docs.join(F.broadcast(hits) if hits.count() * 64 <= search.BROADCAST_BYTES else hits, "key")
    context = found.select("question_id", F.col("key").alias("page"), F.lit(0).alias("chunk"), F.col("rank").alias("position"), F.size(T.tokens(text)).cast("long").alias("tokens"), text.alias("text"))
    return evals.answer_in_context(context, asked)
