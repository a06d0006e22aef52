"""Queries over the bounded agent and its table functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.functions import table_tools
from vellumgrid.plans import agent
from vellumgrid.plans import derived as D
from vellumgrid.plans.evidence_queries import RANKED_SQL, ranked

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


class Player:
    """A stand-in planner: a request lists, as JSON, how many calls each response makes; after the last it selects E1."""

    def plan(self, request: str, transcript: list[str]) -> str:
        wanted, turn = json.loads(request), len(transcript) + 1
        if turn > len(wanted):
            return json.dumps({"stop": "end_turn", "calls": [], "text": '{"evidence_ids": ["E1"]}'})
        asks = lambda i: {"tool": "company_question", "input": json.dumps({"company": "AB", "question": f"{turn} {i}"})}
        reads = {"tool": "fund_disclosure", "input": '{"field": "benchmark"}'}
        return json.dumps({"stop": "tool_use", "calls": [asks(i) if (turn + i) % 3 == 0 else reads for i in range(wanted[turn - 1])], "text": ""})


@query("""
with said as (
  select conv_id, row_number() over (partition by conv_id order by turn, text) as t, case when length(text) % 41 = 0 then 9 else 1 + length(text) % 3 end as k from conversations),
wanted as (select *, count(*) over (partition by conv_id) as m, (select count(*) from range(k::bigint) r(i) where (t + i) % 3 = 0) as q from said),
sums as (select *, sum(k) over w as tools, sum(q) over w as asked from wanted window w as (partition by conv_id order by t)),
steps as (
  select conv_id, t, m, k, q, tools, asked, tools - k as tools_before, asked - q as asked_before from sums
  union all select conv_id, m + 1, m, null, 0, tools, asked, tools, asked from sums where t = m),
judged as (
  select *, case when t > 6 then 1 when t - 1 + asked_before >= 12 then 2 when k is null then 3 when tools > 8 then 4 when t + asked > 12 then 5 end as ending from steps),
first as (select * from judged where ending is not null qualify row_number() over (partition by conv_id order by t) = 1)
select conv_id, case when ending = 3 then 'done' else 'stopped' end as status,
  case ending when 1 then 6 when 2 then t - 1 else t end::bigint as turns,
  case ending when 5 then tools else tools_before end::bigint as n_tools,
  case ending when 1 then 6 + asked_before when 2 then 12 when 5 then 12 else t + asked_before end::bigint as n_calls
from first
""")
def bounded_memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a request whose responses call tools, within 6 turns, 8 tools and 12 calls."""
    said = D.load(spark, sf_dir, "conversations")
    n = F.length(F.coalesce("text", F.lit("")))
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    calls = said.select("conv_id", F.row_number().over(order).alias("t"), F.when(n % 41 == 0, 9).otherwise(1 + n % 3).alias("k"))
    requests = calls.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("t", "k"))), lambda x: x["k"])).alias("request"))

    def execute(new: DataFrame) -> DataFrame:
        return new.select("request_id", "canonical", F.expr("int(0)").alias("at"), F.concat(F.lit("found by "), "canonical").alias("text"), F.lit("stand-in").alias("source"))

    out = agent.run(requests.withColumnRenamed("conv_id", "request_id"), Player, execute)
    return out.select(F.col("request_id").alias("conv_id"), "status", *(F.col(c).cast("long").alias(c) for c in ("turns", "n_tools", "n_calls")))


@query(f"""
with r as ({RANKED_SQL}),
own as (select fund, company from r where rank <= 10 and company is not null group by all),
asked as (select fund, min(company) as company from own group by fund union all select fund, 'X' || fund from own group by fund)
select fund, company, not company like 'X%' as asked, case when company like 'X%' then 'not a filing of this request' end as error, 'Benchmark: Index ' || fund || '. As of 2026-08-31 [factsheet page 4](https://example.com/f#page=4).' as line from asked
""")
def tool_table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools by lateral joins: a filing that a fund's holdings open is asked, a foreign one refused."""
    table_tools.register(spark)
    own = ranked(spark, sf_dir).where("eligible and company is not null").groupBy("fund").agg(F.array_sort(F.collect_set("company")).alias("filings"))
    asked = own.select("fund", "filings", F.explode(F.array(F.element_at("filings", 1), F.concat(F.lit("X"), F.col("fund").cast("string")))).alias("company"))
    return spark.sql(
        """
        select a.fund, a.company, q.input is not null as asked, q.error, d.line
        from {asked} a, lateral company_question(a.filings, a.company, 'What were total assets?') q,
          lateral fund_disclosure(map('benchmark', named_struct('value', concat('Index ', string(a.fund)), 'page', 4, 'definition', string(null))), '2026-08-31', 'https://example.com/f', 'benchmark') d
        """,
        asked=asked,
    )
