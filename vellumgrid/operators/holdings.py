"""Holdings: ranking, reconciliation, coverage, constraints and lookups with row-level provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import text as T
from vellumgrid.sources.tables import keep

#: Characters by which holdings are looked up in questions.
PREFIX = 8

EQUITY = "domestic equity"


def rank_holdings(rows: DataFrame) -> DataFrame:
    """Adds rank and eligible: domestic equity by weight, source row breaking ties; the first ten are eligible."""
    equity = F.col("asset_type") == EQUITY
    order = Window.partitionBy("fund", equity).orderBy(F.desc("weight_pct"), "row")
    ranked = rows.withColumn("rank", F.when(equity, F.row_number().over(order)))
    return ranked.withColumn("eligible", F.coalesce(F.col("rank") <= X.ELIGIBLE_RANK, F.lit(False)))


def reconcile(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """fund, n_rows, n_locations, total, gap and reconciled: within half a unit of the last place a row."""
    sums = rows.groupBy("fund").agg(F.count("*").alias("n_rows"), F.countDistinct("sheet", "row").alias("n_locations"), F.sum("weight_pct").alias("total"))
    gap = F.abs(F.col("total") - F.col("disclosed_total_pct"))
    return sums.join(totals, "fund").withColumn("gap", gap).withColumn("reconciled", F.round("gap", 9) <= F.round(F.col("n_rows") * 0.005 + 0.005, 9))


def top_holdings(ranked: DataFrame, n: int = X.ELIGIBLE_RANK) -> DataFrame:
    """The first n eligible holdings of every fund."""
    if not 1 <= n <= X.ELIGIBLE_RANK:
        raise ValueError(f"1 to {X.ELIGIBLE_RANK} holdings")
    return ranked.where(F.col("eligible") & (F.col("rank") <= n))


def coverage(ranked: DataFrame, filings: DataFrame) -> DataFrame:
    """Every holding with ``indexed``: eligible, mapped to a company, and that company's filing is there."""
    known = filings.select(F.col("company").alias("filing")).distinct()
    joined = ranked.join(known, F.col("eligible") & (F.col("company") == F.col("filing")), "left")
    return joined.withColumn("indexed", F.col("filing").isNotNull()).drop("filing")


def map_companies(rows: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Adds the reviewed company code of each ISIN, null where there is none."""
    return rows.drop("company").join(reviewed.select("isin", "company"), "isin", "left")


def snapshot_violations(ranked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """fund, rule and n for every constraint that a snapshot breaks; nothing if all hold.

    ``snapshots``: fund, holding_count, disclosed_total_pct, portfolio_date, factsheet_date, source_url,
    source_sha256, expense_kind.
    """
    again = rank_holdings(ranked.select("fund", "sheet", "row", "asset_type", "weight_pct", "company", F.col("rank").alias("given_rank"), F.col("eligible").alias("given_eligible")))
    equity = F.col("asset_type") == EQUITY
    row_rules = {
        "rank": equity & (~F.col("rank").eqNullSafe(F.col("given_rank")) | ~F.col("eligible").eqNullSafe(F.col("given_eligible"))),
        "mapping": F.col("given_eligible") & ~F.coalesce(T.matches(F.col("company"), X.COMPANY_CODE), F.lit(False)),
        "weight": F.isnan("weight_pct") | F.col("weight_pct").isNull() | (F.abs("weight_pct") == float("inf")) | (F.col("row") < 1),
        "non-equity": ~equity & (F.col("given_eligible") | F.col("given_rank").isNotNull()),
    }
    # One pass over the rows for all of their rules.
    counts = again.groupBy("fund").agg(*[F.sum(F.when(rule, 1).otherwise(0)).alias(name) for name, rule in row_rules.items()], F.count("*").alias("n_rows"), F.countDistinct("sheet", "row").alias("n_locations"), F.sum("weight_pct").alias("total"))
    whole = snapshots.join(counts, "fund", "left")
    n = F.coalesce("n_rows", F.lit(0))
    fund_rules = {
        "count": n != F.col("holding_count"),
        "location": F.coalesce("n_locations", F.lit(0)) != n,
        "total": F.coalesce(F.round(F.abs(F.col("total") - F.col("disclosed_total_pct")), 9) > F.round(n * 0.005 + 0.005, 9), F.lit(True)),
        "date": F.try_to_date("portfolio_date").isNull() | F.try_to_date("factsheet_date").isNull(),
        "source": ~F.coalesce(F.startswith("source_url", F.lit("https://")) & T.matches(F.col("source_sha256"), X.SHA256), F.lit(False)),
        "expense": ~F.coalesce(F.col("expense_kind").isin("BER", "TER"), F.lit(False)),
    }
    found = [F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(f"`{name}`"), F.lit(0)).cast("long").alias("n")) for name in row_rules]
    found += [F.struct(F.lit(name).alias("rule"), rule.cast("int").cast("long").alias("n")) for name, rule in fund_rules.items()]
    return whole.select("fund", F.explode(F.array(*found)).alias("v")).where("v.n > 0").select("fund", "v.rule", "v.n")


def layout_violations(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, value) that are not as a reviewed layout has them."""
    found = cells.select("sheet", "row", "col", F.col("value").alias("found"))
    return expected.join(found, ["sheet", "row", "col"], "left").where(~F.col("found").eqNullSafe(F.col("value")))


def holdings_from_cells(cells: DataFrame, sections: DataFrame, name_col: str, isin_col: str, weight_col: str) -> DataFrame:
    """Holding rows from a long cell grid; ``sections``: fund, sheet, start, end, asset_type."""
    wide = cells.where(F.col("col").isin(name_col, isin_col, weight_col)).groupBy("sheet", "row").pivot("col", [name_col, isin_col, weight_col]).agg(F.first("value"))
    inside = F.col("row").between(F.col("start"), F.col("end"))
    raw = F.col(weight_col)
    return (
        wide.join(sections, "sheet").where(inside)
        .select("fund", "sheet", "row", "asset_type", F.col(name_col).alias("name"), F.coalesce(F.col(isin_col), F.lit("")).alias("isin"), F.when(raw == "$0.00", 0.0).otherwise(raw.cast("double")).alias("weight_pct"), T.weight_display(raw).alias("weight_display"))
    )


def _cite_fact(fact: Column, url: Column) -> Column:
    page = fact["page"].cast("string")
    return F.concat(F.lit("[factsheet page "), page, F.lit("]("), url, F.lit("#page="), page, F.lit(")"))


def named(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Questions (fund, q in lower case) with the holdings of their fund that they name: by name, less Limited or Ltd, or by code as a word.

    A dictionary join: holdings are found by the first ``PREFIX`` characters of their names and codes, which are looked up at every
    place of a question, and only what was found that way is compared in full. So a question meets a few holdings of its fund and
    not all of them. A name may stand inside a longer one, or inside a word; an empty one is in every question.
    """
    name = F.trim(F.regexp_replace(F.lower("name"), r"(?U)\b(?:limited|ltd)\.?", ""))
    terms = F.array(F.struct(name.alias("term"), F.lit(False).alias("word")), F.struct(F.lower("company").alias("term"), F.lit(True).alias("word")))
    entries = rows.withColumn("t", F.explode(terms)).where("t.term is not null").withColumn("key", F.substring("t.term", 1, PREFIX))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length("q"), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(0), F.lit(PREFIX)), lambda n: F.substring(F.col("q"), i, n)))
    looked_up = asked.withColumn("key", F.explode(F.array_distinct(F.flatten(pieces))))
    code = F.regexp_like("q", F.concat(F.lit(r"(?U)\b\Q"), F.col("t.term"), F.lit(r"\E\b")))
    found = looked_up.join(entries, ["fund", "key"]).where(F.when(F.col("t.word"), code).otherwise(F.contains("q", F.col("t.term"))))
    return found.drop("key", "t").dropDuplicates(["question_id", "fund", "row", "sheet", "name", "company"])


def fund_lookup(questions: DataFrame, snapshots: DataFrame, ranked: DataFrame) -> DataFrame:
    """question_id and answer: cited disclosed facts, or the refusal.

    ``questions``: question_id, fund, question. ``snapshots``: fund, portfolio_date, factsheet_date,
    portfolio_url, factsheet_url, and structs benchmark, expense_ratio, exit_load of value and page
    (expense_ratio also kind, definition, base_value). Advice is refused first, then topics no
    disclosure covers, then factsheet fields are answered, then holdings.
    """
    text = F.lower(F.trim("question"))
    asked = questions.withColumn("q", text).join(snapshots, "fund", "left")
    has = lambda pattern: T.matches(F.col("q"), "(?U)" + pattern)
    expense = F.col("expense_ratio")
    wants = {"benchmark": has(r"\bbenchmark\b"), "expense_ratio": has(r"expense|\b(?:ter|ber)\b|cost"), "exit_load": has(r"exit load|redemption")}
    wants_base = (expense["kind"] == "TER") & has(r"\b(?:base|ber)\b")
    wrong_kind = wants["expense_ratio"] & (expense["kind"] == "BER") & has(r"\b(?:total|ter)\b")
    swapped = wants_base & ~expense["base_value"].eqNullSafe(expense["value"])

    def sentence(label: Column, value: Column, detail: Column, fact: Column) -> Column:
        return F.concat(label, F.lit(": "), value, F.lit("."), detail, F.lit(" As of "), F.col("factsheet_date"), F.lit(" "), _cite_fact(fact, F.col("factsheet_url")), F.lit("."))

    facts = F.array_compact(
        F.array(
            F.when(wants["benchmark"], sentence(F.lit("Benchmark"), F.col("benchmark")["value"], F.lit(""), F.col("benchmark"))),
            F.when(
                wants["expense_ratio"],
                sentence(
                    F.when(wants_base, "Direct-plan base expense ratio").otherwise("Direct-plan expense ratio"),
                    F.when(wants_base, expense["base_value"]).otherwise(expense["value"]),
                    F.when(swapped, "").otherwise(F.concat(F.lit(" "), expense["definition"])),
                    expense,
                ),
            ),
            F.when(wants["exit_load"], sentence(F.lit("Exit load"), F.col("exit_load")["value"], F.lit(""), F.col("exit_load"))),
        )
    )
    any_fact = reduce(lambda a, b: a | b, wants.values())
    top, some = has(r"top\s*(?:10|ten)|largest holding"), has(r"weight|holding|portfolio|allocation")
    way = (
        F.when(T.matches(F.col("q"), X.FUND_ADVICE) | T.matches(F.col("q"), X.FUND_UNSUPPORTED), "refuse")
        .when(any_fact, F.when(~wrong_kind & T.matches_snapshot(F.col("q"), F.col("factsheet_date")), "facts").otherwise("refuse"))
        .when(~T.matches_snapshot(F.col("q"), F.col("portfolio_date")), "refuse")
        .when(top, F.when(F.contains("q", F.lit("largest")), "largest").otherwise("top"))
        .when(some, "named")
        .otherwise("refuse")
    )
    asked = asked.select("question_id", "fund", "q", "portfolio_date", "portfolio_url", facts.alias("facts"), F.coalesce(way, F.lit("refuse")).alias("way"))
    cited = F.concat("name", F.lit(": "), "weight_display", F.lit(" of net assets as of "), "portfolio_date", F.lit(" ["), "sheet", F.lit(" row "), F.col("row").cast("string"), F.lit("]("), "portfolio_url", F.lit(")."))
    rows = keep(ranked.select("fund", "name", "company", "weight_display", "sheet", "row", "rank", "eligible"))
    ordered = asked.where(F.col("way").isin("top", "largest")).join(rows.where("eligible"), "fund").where("way = 'top' or rank = 1")
    hits = ordered.withColumn("at", F.col("rank")).unionByName(named(asked.where("way = 'named'"), rows).withColumn("at", F.col("row")))
    lines = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("at", "row", cited.alias("line")))).alias("lines"))
    joined = asked.join(lines, "question_id", "left")
    listed = F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")
    answer = F.when(F.col("way") == "facts", F.array_join("facts", "\n\n")).when(F.col("lines").isNotNull(), listed).otherwise(X.REFUSAL)
    return joined.select("question_id", answer.alias("answer"), (answer == X.REFUSAL).alias("refused"))
