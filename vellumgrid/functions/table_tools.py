"""An agent's tools as Python table functions, for SQL with lateral joins, and their JSON schemas for planners.

Both say what they return before anything runs: ``analyze`` refuses arguments of the wrong kind, and constant ones that could
never be allowed. What depends on a row is looked at in ``eval``, before the row's call is handed on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as t
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

FACTS = {"benchmark": "Benchmark", "expense_ratio": "Direct-plan expense ratio", "exit_load": "Exit load"}
CALL = t.StructType().add("tool", "string").add("input", "string").add("error", "string")
LINE = t.StructType().add("field", "string").add("line", "string").add("error", "string")


def definitions(filings: list[str], fund: bool) -> list[dict]:
    """The tools open to a request, as a planner is told of them: name and JSON schema of the input."""
    out = []
    if filings:
        properties = {"company": {"type": "string", "enum": sorted(filings)}, "question": {"type": "string", "minLength": 1, "maxLength": 1000}}
        out.append({"name": "company_question", "input_schema": {"type": "object", "properties": properties, "required": ["company", "question"], "additionalProperties": False}})
    if fund:
        properties = {"field": {"type": "string", "enum": [*FACTS, "top_holdings"]}, "count": {"type": "integer", "minimum": 1, "maximum": 10}}
        out.append({"name": "fund_disclosure", "input_schema": {"type": "object", "properties": properties, "required": ["field"], "additionalProperties": False}})
    return out


def _must(arg: AnalyzeArgument, kind: type[t.DataType], what: str) -> None:
    if arg.isTable or not isinstance(arg.dataType, (kind, t.NullType)):
        raise ValueError(f"{what} must be a {kind.typeName()}")


@udtf
class CompanyQuestion:
    """(filings, company, question): the call to ask, or why it is not asked. ``filings`` are those that the request may open."""

    @staticmethod
    def analyze(filings: AnalyzeArgument, company: AnalyzeArgument, question: AnalyzeArgument) -> AnalyzeResult:
        _must(filings, t.ArrayType, "filings")
        _must(company, t.StringType, "company")
        _must(question, t.StringType, "question")
        if filings.isConstantExpression and company.isConstantExpression and company.value not in (filings.value or []):
            raise ValueError(f"{company.value} is not a filing of this request")
        return AnalyzeResult(CALL)

    def eval(self, filings: list[str] | None, company: str | None, question: str | None) -> Iterator[tuple]:
        error = None
        if company is None or company not in (filings or []):
            error = "not a filing of this request"
        elif not 1 <= len(question or "") <= 1000:
            error = "a question has 1 to 1000 characters"
        yield "company_question", None if error else json.dumps({"company": company, "question": question}, ensure_ascii=False), error


@udtf
class FundDisclosure:
    """(facts, factsheet_date, factsheet_url, field): a cited sentence. ``facts``: map of field to a struct of value, page and definition."""

    @staticmethod
    def analyze(facts: AnalyzeArgument, factsheet_date: AnalyzeArgument, factsheet_url: AnalyzeArgument, field: AnalyzeArgument) -> AnalyzeResult:
        _must(facts, t.MapType, "facts")
        for arg, what in ((factsheet_date, "factsheet_date"), (factsheet_url, "factsheet_url"), (field, "field")):
            _must(arg, t.StringType, what)
        if field.isConstantExpression and field.value not in FACTS:
            raise ValueError(f"{field.value} is not one of {', '.join(FACTS)}")
        return AnalyzeResult(LINE)

    def eval(self, facts: dict | None, factsheet_date: str | None, factsheet_url: str | None, field: str | None) -> Iterator[tuple]:
        fact = (facts or {}).get(field)
        if field not in FACTS or fact is None:
            yield field, None, "not disclosed"
            return
        detail = f" {fact['definition']}" if fact["definition"] else ""
        yield field, f"{FACTS[field]}: {fact['value']}.{detail} As of {factsheet_date} [factsheet page {fact['page']}]({factsheet_url}#page={fact['page']}).", None


def register(spark: SparkSession) -> None:
    """company_question(...) and fund_disclosure(...) in this session's SQL."""
    spark.udtf.register("company_question", CompanyQuestion)
    spark.udtf.register("fund_disclosure", FundDisclosure)
