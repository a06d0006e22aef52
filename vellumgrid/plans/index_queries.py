"""Queries through storage: the snapshotted index, the cells of the vector index, admission on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import text as T
from vellumgrid.operators import search, vector_cells
from vellumgrid.plans import derived as D
from vellumgrid.plans.search_queries import BM25_SQL, documents, embeddings, questions, vector_hits
from vellumgrid.sources import index
from vellumgrid.sources.tables import keep, scratch
from vellumgrid.streaming import limits

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Documents after two sources were replaced, one by a third of its documents with a word more, the other by nothing but one text.
REPLACED = """
select doc_id, case when source = 'src3' then text || ' replaced' else text end as text, source from documents where source not in ('src3', 'src5') or (source = 'src3' and doc_id % 3 = 0)
union all select -1, 'the only text that is left of its filing', 'src5'
"""


@query(f"select question_id, key, rank, round(score, 5) as score from ({BM25_SQL.replace('from documents', f'from ({REPLACED})')})")
def replaced_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index in storage, two filings replaced, and keyword search over its maintained text index."""
    path = scratch(spark, "index")
    made = documents(spark, sf_dir).select(
        F.col("source").alias("company"), F.lit("FY25").alias("fiscal_year"), F.col("key").alias("page"), F.lit(0).alias("chunk"), F.lit("unstated").alias("scope"),
        T.token_count(F.coalesce("text", F.lit(""))).alias("tokens"), "text", F.array(F.lit(0.0)).alias("vector"),
    )
    index.write_index(made, path, "none", 1)
    rest = made.where("company = 'src3' and page % 3 = 0").withColumn("text", F.concat("text", F.lit(" replaced")))
    one = made.limit(1).select(F.lit("src5").alias("company"), "fiscal_year", F.lit(-1).cast("long").alias("page"), "chunk", "scope", "tokens", F.lit("the only text that is left of its filing").alias("text"), "vector")
    index.replace_filings(rest.unionByName(one), path)
    stored = index.open_text_index(spark, path)
    page = F.element_at(F.split("key", "[|]"), 3).cast("long")
    hits = search.keyword_topk(None, questions(spark, sf_dir), stored=search.TextIndex(stored.postings.withColumn("key", page), stored.df, stored.totals))
    return hits.select("question_id", "key", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query("""
with docs as (select source as company, doc_id, text, case when source = 'src3' then 2 else 1 end as version from documents),
kept as (select * from docs where company <> 'src3' or doc_id % 3 = 0)
select company, count(*) as n_rows, count(distinct doc_id) as n_pages, 'current' as snapshot from kept group by company
union all select company, count(*), count(distinct doc_id), 'before' from docs group by company
""")
def index_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and pages of each filing in the current snapshot and in the one before it, files verified."""
    path = scratch(spark, "index")
    made = documents(spark, sf_dir).select(
        F.col("source").alias("company"), F.lit("FY25").alias("fiscal_year"), F.col("key").alias("page"), F.lit(0).alias("chunk"), F.lit("unstated").alias("scope"), F.lit(1).alias("tokens"), "text", F.array(F.lit(0.0)).alias("vector")
    )
    index.write_index(made, path, "none", 1)
    index.replace_filings(made.where("company = 'src3' and page % 3 = 0"), path)
    index.compact(spark, path)
    index.prune(spark, path, 3)
    counted = lambda version, name: index.index_manifest(index.open_index(spark, path, "none", version, verify=True)).select("company", "n_rows", "n_pages", F.lit(name).alias("snapshot"))
    return counted(3, "current").unionByName(counted(1, "before"))


@query("select count(*) as n_questions, true as recall_reached, true as fewer_rows_read from embeddings where vec_id % 50 = 0")
def vector_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector index by cells against the exact search: recall of the 50 nearest of at least 0.9, and rows read."""
    rows = embeddings(spark, sf_dir)
    asked = rows.where("key % 50 = 0").select(F.col("key").alias("question_id"), "vector")
    cells = vector_cells.fit(rows)
    path = scratch(spark, "cells")
    vector_cells.write(rows, cells, path)
    stored, cells = vector_cells.open_cells(spark, path)
    found = vector_cells.search(stored, asked, cells).select("question_id", "key", F.lit(1).alias("found"))
    exact = keep(vector_hits(spark, sf_dir).select("question_id", "key"))
    recall = exact.join(found, ["question_id", "key"], "left").agg(F.countDistinct("question_id").alias("n_questions"), (F.sum(F.coalesce("found", F.lit(0))) / F.count("*")).alias("recall"))
    sizes = stored.groupBy("cell").agg(F.count("*").alias("n"))
    read = vector_cells.probed(asked, cells).join(sizes, "cell").agg(F.sum("n").alias("read"))
    all_rows = sizes.agg(F.sum("n").alias("rows"))
    # One row each.
    joined = recall.crossJoin(read).crossJoin(all_rows)
    return joined.select("n_questions", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("read") < F.col("rows") * F.col("n_questions")).alias("fewer_rows_read"))


@query("""
with own as (select *, ts::date as day, row_number() over (partition by ts::date, user_id order by ts, event_id) as n from events),
first as (select *, row_number() over (partition by day order by ts, event_id) as m from own where n <= 5)
select event_id, day, user_id from first where m <= 120 and day + interval 1 day <= (select max(ts) from events) - interval 1 hour
""")
def streamed_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same caps as daily_call_caps, exact on a stream, for all days that the watermark has closed."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    schema = D.load(spark, sf_dir, "events").schema
    out = scratch(spark, "admitted")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        limits.admit_stream(stream, out, scratch(spark, "stream"), per_visitor=5, total=120).awaitTermination()
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.parquet(f"{out}/batch=*").select("event_id", "day", "user_id")
