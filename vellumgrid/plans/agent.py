"""A bounded agent over a table of requests: one plan a turn, budgets looked at before anything is called."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import models
from vellumgrid.operators import evidence, tools
from vellumgrid.plans import ask
from vellumgrid.sources.tables import keep

#: What a planner answers: why it stopped, the calls it wants, and the selection it ends with.
RESPONSE = "stop string, calls array<struct<tool:string,input:string>>, text string"
#: Calls of models that a tool makes itself.
NESTED = {"company_question": 1}
#: request_id, canonical, text, source: what a call found, in order of ``at``.
FOUND = "request_id {0}, canonical string, at int, text string, source string"


class Planner(Protocol):
    def plan(self, request: str, transcript: list[str]) -> str:
        """The next response, as JSON of RESPONSE (inputs as JSON strings), to a request and what was said since."""


Execute = Callable[[DataFrame], DataFrame]


def respond(requests: DataFrame, make: Callable[[], Planner]) -> DataFrame:
    """request_id and response of open requests (request_id, request, transcript); one planner a task."""
    asked = requests.select("request_id", "request", "transcript")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planner = make()
        for batch in batches:
            said = [planner.plan(r, t) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["request_id", "response"])

    return asked.mapInArrow(run, f"request_id {dict(asked.dtypes)['request_id']}, response string")


def _cost(tool: Column) -> Column:
    out = F.lit(0)
    for name, n in NESTED.items():
        out = F.when(tool == name, n).otherwise(out)
    return out


def run(requests: DataFrame, make: Callable[[], Planner], execute: Execute, turns: int = X.MAX_TURNS, most_tools: int = X.MAX_TOOLS, most_calls: int = X.MAX_CALLS) -> DataFrame:
    """request_id, status (done, refused or stopped), reason, ids, text, turns, n_tools and n_calls of every request.

    ``requests``: request_id, request. Each turn asks the planner for the open requests alone. Before a planner is asked, and before
    each call that asks a model itself, the calls made so far are held against ``most_calls``; a batch of tools that would pass ``most_tools``
    stops its request before any of it runs. Calls are validated, those with an input that the request had before share its
    result, and ``execute`` gets the rest: (request_id, request, canonical, tool, input) in, FOUND out. A request
    ends with a selection of its evidence; one that cannot be used may be repaired once. What is stopped or done leaves the table.
    """
    kind = dict(requests.dtypes)["request_id"]
    none = lambda schema: requests.sparkSession.createDataFrame([], schema)
    zero, text = F.lit(0), F.lit("")
    state = keep(requests.select("request_id", "request", F.array().cast("array<string>").alias("transcript"), zero.alias("turns"), zero.alias("n_tools"), zero.alias("n_calls"), F.lit(False).alias("repaired"), F.lit("open").alias("status"), text.alias("reason"), F.lit(None).cast("string").alias("ids"), F.lit(None).cast("string").alias("text")))
    columns = state.columns
    finished, memo = none(state.schema), none(f"request_id {kind}, canonical string")
    found = none(FOUND.format(kind) + ", seq long")

    def end(rows: DataFrame, status: str, reason: Column | str) -> DataFrame:
        return rows.withColumns({"status": F.lit(status), "reason": F.lit(reason) if isinstance(reason, str) else reason, "text": F.coalesce("text", F.lit(X.REFUSAL))}).select(*columns)

    for turn in range(1, turns + 1):
        spent = end(state.where(F.col("n_calls") >= most_calls), "stopped", "the calls are spent")
        asked = state.where(F.col("n_calls") < most_calls)
        said = keep(asked.join(respond(asked, make), "request_id").withColumn("r", F.from_json("response", RESPONSE)).withColumns({"turns": F.col("turns") + 1, "n_calls": F.col("n_calls") + 1}))
        n = F.coalesce(F.size("r.calls"), zero)
        wants = F.col("r.stop") == "tool_use"
        too_many = (n < 1) | (F.col("n_tools") + n > most_tools)
        halted = end(said.where(wants & too_many), "stopped", "the tool calls are spent")
        broken = end(said.where(F.coalesce(~wants & (F.col("r.stop") != "end_turn"), F.lit(True))), "refused", "the planner ended before a memo was complete")
        # Ends: a selection of the evidence so far.
        ending = said.where(F.col("r.stop") == "end_turn").withColumn("raw", F.trim(F.coalesce("r.text", text)))
        registry = evidence.register(found)
        chosen = evidence.memos(ending.select("request_id", "raw"), registry)
        has = registry.select("request_id").distinct().withColumn("has_evidence", F.lit(True))
        judged = ending.drop("reason", "ids", "text").join(chosen, "request_id").join(has, "request_id", "left")
        again = F.col("refused") & F.coalesce("has_evidence", F.lit(False)) & ~F.col("repaired") & (F.regexp_replace("raw", " ", "") != '{"evidence_ids":[]}')
        ended = end(judged.where(~again), "done", F.col("reason")).withColumn("status", F.when(F.col("reason") == "", "done").otherwise("refused"))
        message = F.concat(F.lit("The selection cannot be used: "), F.col("reason"))
        repaired = judged.where(again).withColumns({"transcript": F.array_append("transcript", message), "repaired": F.lit(True), "status": F.lit("open"), "reason": text, "ids": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}).select(*columns)
        # Calls: validated, numbered, told apart from those made before, and counted before they are made.
        calling = said.where(wants & ~too_many)
        each = calling.select("request_id", "request", "n_calls", F.posexplode("r.calls").alias("place", "call")).select("request_id", "request", "n_calls", "place", "call.tool", "call.input")
        valid = tools.validate(each).join(memo.withColumn("known", F.lit(True)), ["request_id", "canonical"], "left")
        twin = F.row_number().over(Window.partitionBy("request_id", "canonical").orderBy("place"))
        new = F.col("error").isNull() & F.col("known").isNull() & (F.col("twin") == 1)
        order = Window.partitionBy("request_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        counted = valid.withColumn("twin", twin).withColumn("new", new).withColumn("cost", F.when(F.col("new"), _cost(F.col("tool"))).otherwise(zero))
        counted = counted.withColumn("made", F.col("n_calls") + F.sum("cost").over(order)).withColumn("over", F.max(F.col("made") > most_calls).over(order))
        counted = keep(counted)
        # Executed once, and kept before the next turn is planned.
        results = execute(counted.where("new and not over").select("request_id", "request", "canonical", "tool", "input"))
        placed = results.join(counted.where("new and not over").select("request_id", "canonical", "place"), ["request_id", "canonical"])
        fresh = keep(placed.withColumn("seq", F.lit(turn).cast("long") * 1_000_000 + F.col("place") * 1000 + F.col("at")).select(*found.columns))
        found = keep(found.unionByName(fresh)) if turn > 1 else fresh
        memo = keep(memo.unionByName(counted.where("new and not over").select("request_id", "canonical")))
        lines = found.groupBy("request_id", "canonical").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("lines"))
        shown = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).otherwise(F.array_join(F.transform(F.coalesce("lines", F.array().cast("array<struct<at:int,text:string>>")), lambda x: x["text"]), "\n"))
        answered = counted.join(lines, ["request_id", "canonical"], "left").groupBy("request_id").agg(
            F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", shown.alias("shown")))), lambda x: x["shown"])).alias("answer"), F.count("*").cast("int").alias("asked"), F.max(F.when(~F.col("over"), F.col("made"))).cast("int").alias("made"), F.max("over").alias("over")
        )
        went = calling.join(answered, "request_id").withColumns({"n_tools": F.col("n_tools") + F.col("asked"), "n_calls": F.coalesce("made", "n_calls"), "transcript": F.array_append("transcript", F.col("answer"))})
        overrun = end(went.where("over"), "stopped", "the calls are spent")
        finished = keep(finished.unionByName(spent).unionByName(halted).unionByName(broken).unionByName(ended).unionByName(overrun))
        state = keep(went.where(~F.col("over")).select(*columns).unionByName(repaired))
        if state.isEmpty():
            break
    finished = finished.unionByName(end(state, "stopped", "the turns are spent"))
    return finished.select("request_id", "status", "reason", "ids", "text", "turns", "n_tools", "n_calls")


def company_questions(index: DataFrame, access: DataFrame, make_embedder: Callable[[], models.Embedder], dim: int, make_generator: Callable[[], models.Generator], floor: float = X.MIN_SIMILARITY) -> Execute:
    """Execution of company_question: only filings in ``access`` (request_id, company) are asked, and only answers without a warning become evidence.

    A call for a foreign filing is refused before any search: it finds nothing.
    """

    def execute(calls: DataFrame) -> DataFrame:
        name, question = F.get_json_object("input", "$.company"), F.get_json_object("input", "$.question")
        own = calls.where("tool = 'company_question'").select("request_id", "canonical", name.alias("company"), question.alias("question"))
        allowed = keep(own.join(access.select("request_id", "company").distinct(), ["request_id", "company"], "left_semi").withColumn("question_id", F.concat_ws("|", F.col("request_id").cast("string"), "canonical")))
        verdicts = ask.ask(index, allowed.select("question_id", "question", "company"), make_embedder, dim, make_generator, floor)
        usable = tools.strict(verdicts).where("usable").select("question_id", "text")
        return allowed.join(usable, "question_id").select("request_id", "canonical", F.lit(0).alias("at"), "text", F.col("company").alias("source"))

    return execute


def fund_disclosures(funds: DataFrame, snapshots: DataFrame, ranked: DataFrame) -> Execute:
    """Execution of fund_disclosure over the fund of each request (``funds``: request_id, fund), as ``tools.disclose`` gives it."""

    def execute(calls: DataFrame) -> DataFrame:
        own = calls.where("tool = 'fund_disclosure'").join(funds, "request_id")
        return tools.disclose(own, snapshots, ranked)

    return execute


def either(*executions: Execute) -> Execute:
    """Each tool's execution over its own calls."""

    def execute(calls: DataFrame) -> DataFrame:
        calls = keep(calls)
        out = executions[0](calls)
        for other in executions[1:]:
            out = out.unionByName(other(calls))
        return out

    return execute
