"""Evidence registries and memos: only known, short, cited evidence becomes a memo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import text as T


def register(evidence: DataFrame, order: str = "seq") -> DataFrame:
    """request_id, id (E1, E2, ...), text, source of evidence of at most 200 words, numbered by ``order``."""
    short = evidence.where(T.word_count(F.col("text")) <= X.MAX_EVIDENCE_WORDS)
    n = F.row_number().over(Window.partitionBy("request_id").orderBy(order))
    return short.withColumn("id", F.concat(F.lit("E"), n.cast("string")))


def accessible(filings: DataFrame, ranked: DataFrame) -> DataFrame:
    """fund and filing columns of the reports a fund's eligible holdings open: an access list."""
    held = ranked.where("eligible and company is not null").select("fund", "company").distinct()
    return held.join(filings, "company")


def memos(selections: DataFrame, registry: DataFrame) -> DataFrame:
    """request_id, refused, reason, ids, words and text for each selection (request_id, raw JSON)."""
    keys = F.json_object_keys("raw")
    element = F.get_json_object("raw", "$.evidence_ids")
    ids = F.from_json("raw", "evidence_ids array<string>")["evidence_ids"]
    # Parsed as text, numbers would pass for strings: what is read back must be what was written.
    typed = F.transform(F.from_json(element, "array<string>"), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    same = F.regexp_replace(element, r"\s", "") == F.concat(F.lit("["), F.regexp_replace(F.array_join(typed, ","), r"\s", ""), F.lit("]"))
    # None: no JSON at all. Invalid: not one object with this one key holding an array.
    parsed = selections.select(
        "request_id",
        F.try_parse_json("raw").isNotNull().alias("is_json"),
        F.coalesce((F.size(keys) == 1) & (keys[0] == "evidence_ids") & F.startswith(element, F.lit("[")), F.lit(False)).alias("shaped"),
        F.coalesce(same, F.lit(False)).alias("strings"),
        ids.alias("ids"),
    )
    each = parsed.where("shaped").select("request_id", F.posexplode("ids").alias("at", "id"))
    known = each.join(registry.select("request_id", "id", "text", "source"), ["request_id", "id"])
    words = T.word_count(F.col("text")) + T.word_count(F.col("source"))
    found = known.groupBy("request_id").agg(F.countDistinct("at").alias("n_known"), F.sum(words).alias("words"), F.array_sort(F.collect_list(F.struct("at", "source", "text"))).alias("entries"))
    joined = parsed.join(found, "request_id", "left")
    n = F.size("ids")
    usable = F.col("strings") & n.between(1, X.MAX_SELECTED) & (F.size(F.array_distinct("ids")) == n) & (F.col("n_known") == n)
    why = (
        F.when(~F.col("is_json"), X.NO_SELECTION)
        .when(~F.col("shaped"), X.BAD_SELECTION)
        .when(~F.coalesce(usable, F.lit(False)), X.BAD_EVIDENCE)
        .when(F.col("words") > X.MAX_MEMO_WORDS, X.LONG_MEMO)
        .otherwise("")
    )

    def entry(e: Column, i: Column) -> Column:
        new = (i == 0) | (F.get("entries", i - 1)["source"] != e["source"])
        return F.concat(F.when(new, F.concat(F.lit("**"), e["source"], F.lit("**\n\n"))).otherwise(""), e["text"])

    text = F.array_join(F.transform("entries", entry), "\n\n")
    out = joined.withColumn("reason", why)
    refused = F.col("reason") != ""
    return out.select("request_id", refused.alias("refused"), "reason", F.when(~refused, F.array_join("ids", ",")).alias("ids"), F.when(~refused, F.col("words")).alias("words"), F.when(refused, X.REFUSAL).otherwise(text).alias("text"))


def call_budget(calls: DataFrame) -> DataFrame:
    """For each call of a request's log (request_id, seq, kind turn|tool): admitted within 6 turns, 8 tools, 12 calls.

    What comes after the first call that is over a budget is stopped as well.
    """
    order = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda kind: F.sum((F.col("kind") == kind).cast("int")).over(order)
    over = (count("turn") > X.MAX_TURNS) | (count("tool") > X.MAX_TOOLS) | (F.count("*").over(order) > X.MAX_CALLS)
    return calls.withColumn("admitted", ~over)
