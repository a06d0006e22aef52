"""Tool calls of a bounded agent: validation, memoised results, disclosures, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import text as T

FIELDS = ("benchmark", "expense_ratio", "exit_load", "top_holdings")


def validate(calls: DataFrame) -> DataFrame:
    """Adds error (null: a valid call) to calls (tool, input as JSON) and canonical, the same for the same call."""
    keys = F.array_sort(F.json_object_keys("input"))
    raw = lambda name: F.get_json_object("input", f"$.{name}")
    # get_json_object drops quotes, so a string is told from a number by the text of the input.
    quoted = lambda name: T.matches(F.col("input"), rf'"{name}"\s*:\s*"')
    company = F.coalesce((F.size(keys) == 2) & (F.array_join(keys, ",") == "company,question"), F.lit(False))
    fund = F.coalesce(F.array_join(keys, ",").isin("field", "count,field"), F.lit(False))
    count = raw("count")
    error = (
        F.when(keys.isNull(), X.NOT_AN_OBJECT)
        .when(F.col("tool") == "company_question", F.when(~company, X.BAD_CALL).when(~quoted("company"), "Company must be a code").when(~raw("company").rlike(X.COMPANY_CODE), "Company must be a code").when(~F.length(raw("question")).between(1, 1000), "Question is 1 to 1000 characters"))
        .when(
            F.col("tool") == "fund_disclosure",
            F.when(~fund | ~quoted("field"), X.BAD_CALL)
            .when(count.isNotNull() & (quoted("count") | ~T.matches(count, r"^(?:[1-9]|10)$")), X.BAD_COUNT)
            .when(count.isNotNull() & (raw("field") != "top_holdings"), "Only holdings have a count")
            .when(~raw("field").isin(*FIELDS), X.BAD_FIELD),
        )
        .otherwise(X.BAD_CALL)
    )
    pairs = F.transform(keys, lambda k: F.concat(k, F.lit("="), F.coalesce(F.from_json("input", "map<string,string>")[k], F.lit(""))))
    return calls.withColumns({"error": error, "canonical": F.concat("tool", F.lit("?"), F.array_join(pairs, "&"))})


def memoised(calls: DataFrame, order: str = "seq") -> DataFrame:
    """Valid calls with ``first``: the number of the request's first call with the same input, whose result they share."""
    same = Window.partitionBy("request_id", "canonical").orderBy(order)
    return calls.where("error is null").withColumn("first", F.first(order).over(same))


def strict(verdicts: DataFrame) -> DataFrame:
    """Adds usable: an answer may become evidence only if no guard had to warn."""
    quiet = (F.size("invalid_citations") == 0) & (F.size("ungrounded") == 0) & (F.size("scrubbed") == 0)
    return verdicts.withColumn("usable", ~F.col("refused") & quiet & (F.size(T.report_sentences(F.col("text"))) > 0))


def disclosure_allowed(request: Column, field: Column, portfolio_date: Column, factsheet_date: Column, expense_kind: Column) -> Column:
    """May this field of a fund be read for a request, by its date, plan, topic and kind of ratio."""
    text = F.lower(request)
    dated = F.when(field == "top_holdings", T.matches_snapshot(text, portfolio_date)).otherwise(T.matches_snapshot(text, factsheet_date))
    other_plan = T.matches(text, r"(?U)\b(?:regular|idcw)\b")
    other_ratio = (field == "expense_ratio") & (expense_kind == "BER") & T.matches(text, r"(?U)\b(?:total|ter)\b")
    return dated & ~T.matches(text, X.FUND_ADVICE) & ~other_plan & ~F.coalesce(other_ratio, F.lit(False))


def disclose(calls: DataFrame, snapshots: DataFrame, ranked: DataFrame) -> DataFrame:
    """request_id, canonical, at, text and source of what fund_disclosure calls (request_id, request, canonical, input, fund) may read.

    A field is a cited sentence; top_holdings a cited row for each of the first ``count`` (ten, unless said) eligible holdings. A request
    that is about another date, plan or kind of ratio, or asks for advice, reads nothing.
    """
    asked = calls.withColumns({"field": F.get_json_object("input", "$.field"), "count": F.coalesce(F.get_json_object("input", "$.count").cast("int"), F.lit(10))}).join(snapshots, "fund")
    allowed = asked.where(disclosure_allowed(F.col("request"), F.col("field"), F.col("portfolio_date"), F.col("factsheet_date"), F.col("expense_ratio.kind")))

    def fact(name: str, label: str) -> Column:
        page = F.col(f"{name}.page").cast("string")
        detail = F.concat(F.lit(" "), F.col("expense_ratio.definition")) if name == "expense_ratio" else F.lit("")
        return F.concat(F.lit(f"{label}: "), f"{name}.value", F.lit("."), detail, F.lit(" As of "), "factsheet_date", F.lit(" [factsheet page "), page, F.lit("]("), "factsheet_url", F.lit("#page="), page, F.lit(")."))

    sentence = F.when(F.col("field") == "benchmark", fact("benchmark", "Benchmark")).when(F.col("field") == "expense_ratio", fact("expense_ratio", "Direct-plan expense ratio")).when(F.col("field") == "exit_load", fact("exit_load", "Exit load"))
    row = F.concat("name", F.lit(": "), "weight_display", F.lit(" of net assets as of "), "portfolio_date", F.lit(" ["), "sheet", F.lit(" row "), F.col("row").cast("string"), F.lit("]("), "portfolio_url", F.lit(")."))
    # The eligible holdings of a fund are ten at most.
    cited = ranked.where("eligible").join(snapshots.select("fund", "portfolio_date", "portfolio_url"), "fund").select("fund", F.struct(F.col("rank").cast("int").alias("at"), row.alias("text"), F.lit("portfolio").alias("source")).alias("line"))
    top = cited.groupBy("fund").agg(F.array_sort(F.collect_list("line")).alias("top"))
    fields = F.array(F.struct(F.lit(0).alias("at"), sentence.alias("text"), F.lit("factsheet").alias("source")))
    lines = F.when(F.col("field") == "top_holdings", F.slice("top", F.lit(1), F.col("count"))).otherwise(fields)
    return allowed.join(top, "fund", "left").select("request_id", "canonical", F.explode(lines).alias("line")).select("request_id", "canonical", "line.*").where("text is not null")


def grade_agents(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """case_id, correct, faithful and passed of results (case_id, refusal, refused, text, contains, judged) and their evidence (case_id, faithful)."""
    by_case = evidence.groupBy("case_id").agg(F.bool_and("faithful").alias("all_faithful"))
    joined = results.join(by_case, "case_id", "left")
    correct = ~F.col("refused") & F.forall("contains", lambda s: F.contains("text", s)) & F.coalesce("judged", F.lit(True))
    faithful = ~F.col("refused") & F.coalesce("all_faithful", F.lit(True))
    bare = F.col("refused") & (F.col("text") == X.REFUSAL)
    return joined.select("case_id", correct.alias("correct"), faithful.alias("faithful"), F.when(F.col("refusal"), bare).otherwise(correct & faithful).alias("passed"))


def samples(questions: DataFrame, n: int) -> DataFrame:
    """Every question n times, numbered from 1."""
    return questions.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n))))
