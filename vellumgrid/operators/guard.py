"""The guard between a model's words and a reader: every citation and every figure is checked.

Answers come as rows (question_id, raw) and the pages a model was shown as rows (question_id, page,
text). Everything is a column expression; a question's context is collected once, and is as large as
the token budget allows, not as the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import text as T

PAGES = "array<struct<page:int,figures:array<string>>>"


def printed(context: DataFrame) -> DataFrame:
    """question_id and pages: for each page of the context its distinct checkable figures."""
    each = context.select("question_id", F.col("page").cast("int").alias("page"), F.explode_outer(T.figures(F.col("text"))).alias("figure"))
    by_page = each.groupBy("question_id", "page").agg(F.array_sort(F.collect_set("figure")).alias("figures"))
    return by_page.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("page", "figures"))).alias("pages"))


def best_similarity(hits: DataFrame) -> DataFrame:
    return hits.groupBy("question_id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best"))


def on_pages(pages: Column, cited: Column) -> Column:
    """Figures printed on any of the cited pages."""
    return F.array_distinct(F.flatten(F.transform(F.filter(pages, lambda p: F.array_contains(cited, p["page"])), lambda p: p["figures"])))


def claims(text: Column) -> Column:
    """The answer as structs of claim, run (of citations) and pages; a label after a run belongs to its claim."""
    runs = F.regexp_extract_all(text, F.lit(X.CITATION_RUN), F.lit(0))
    parts = F.split(text, X.CITATION_RUN)

    def claim(run: Column, i: Column) -> Column:
        labelled = T.matches(F.get(parts, i + 1), X.TRAILING_LABEL)
        return F.struct(F.concat(F.get(parts, i), F.when(labelled, " (computed)").otherwise("")).alias("claim"), run.alias("run"), T.cited_pages(run).alias("pages"))

    return F.transform(runs, claim)


def tail(text: Column) -> Column:
    return F.element_at(F.split(text, X.CITATION_RUN), -1)


def correction(c: Column, pages: Column) -> Column:
    """The one page that prints all figures of a claim whose cited pages do not, else null."""
    found = T.claim_figures(c["claim"])
    astray = (F.size(found) > 0) & ~T.matches(c["claim"], X.COMPUTED) & (F.size(F.array_except(found, on_pages(pages, c["pages"]))) > 0)
    holders = F.filter(pages, lambda p: F.size(F.array_except(found, p["figures"])) == 0)
    return F.when(astray & (F.size(holders) == 1), holders[0]["page"])


def recite(frame: DataFrame, text: str = "text", pages: str = "pages") -> DataFrame:
    """Moves citations to the only page that prints a claim's figures; adds ``recited`` (cited, page)."""
    cut = frame.withColumn("_claims", F.transform(claims(F.col(text)), lambda c: F.struct(c["claim"].alias("claim"), c["run"].alias("run"), c["pages"].alias("pages"), correction(c, F.col(pages)).alias("to"))))
    leading = lambda c: F.regexp_extract(c["run"], r"(?U)^\s*", 0)
    moved = lambda c: F.concat(c["claim"], F.when(c["to"].isNotNull(), F.concat(leading(c), F.lit("[page "), c["to"].cast("string"), F.lit("]"))).otherwise(c["run"]))
    out = cut.withColumn("_text", F.concat(F.array_join(F.transform("_claims", moved), ""), tail(F.col(text))))
    out = out.withColumn("recited", F.transform(F.filter("_claims", lambda c: c["to"].isNotNull()), lambda c: F.struct(c["pages"].alias("cited"), c["to"].alias("page"))))
    return out.withColumn(text, F.col("_text")).drop("_claims", "_text")


def invalid_pages(text: Column, shown: Column) -> Column:
    return F.filter(T.cited_pages(text), lambda p: ~F.array_contains(shown, p))


def flag_citations(text: Column, shown: Column) -> Column:
    """Citations to pages that were not shown, flagged in place."""
    runs = F.regexp_extract_all(text, F.lit(X.CITATION), F.lit(0))
    parts = F.split(text, X.CITATION)

    def one(run: Column, i: Column) -> Column:
        page = F.regexp_extract(run, r"(\d+)", 1)
        flagged = F.concat(F.lit("[unverified citation to page "), page.cast("int").cast("string"), F.lit(" — not in the retrieved context]"))
        return F.concat(F.get(parts, i), F.when(F.array_contains(shown, page.cast("int")), run).otherwise(flagged))

    return F.concat(F.array_join(F.transform(runs, one), ""), F.element_at(parts, -1))


def ungrounded(text: Column, pages: Column) -> Column:
    """Distinct (figure, pages) that the answer states and the pages cited for them do not print."""
    own = claims(text)
    every = F.flatten(F.transform(own, lambda c: c["pages"]))
    last = F.struct(tail(text).alias("claim"), F.lit("").alias("run"), every.alias("pages"))
    checked = F.when((F.trim(tail(text)) != "") & (F.size(every) > 0), F.concat(own, F.array(last))).otherwise(own)

    def missing(c: Column) -> Column:
        stated = T.all_figures(F.regexp_replace(c["claim"], X.REFERENCE, " "))
        absent = F.filter(stated, lambda f: T.checkable(f).isNotNull() & ~F.array_contains(on_pages(pages, c["pages"]), T.checkable(f)))
        return F.transform(absent, lambda f: F.struct(f.alias("figure"), c["pages"].alias("pages")))

    return F.array_distinct(F.flatten(F.transform(F.filter(checked, lambda c: ~T.matches(c["claim"], X.COMPUTED)), missing)))


def citation_status(answers: DataFrame, context: DataFrame, text: str = "raw") -> DataFrame:
    """question_id, page, valid for every distinct citation: valid if the page was shown."""
    cited = answers.select("question_id", F.explode(F.array_distinct(T.cited_pages(F.col(text)))).alias("page"))
    shown = context.select("question_id", F.col("page").cast("int").alias("page")).distinct().withColumn("shown", F.lit(True))
    return cited.join(shown, ["question_id", "page"], "left").select("question_id", "page", F.coalesce("shown", F.lit(False)).alias("valid"))


def guarded_answers(answers: DataFrame, hits: DataFrame, context: DataFrame, floor: float = X.MIN_SIMILARITY) -> DataFrame:
    """One verdict for each answer (question_id, raw): refused, reason, text, and what the guards did.

    The order matters: gate, refusal, recite, flag, scrub, ground, and withhold what is left uncited.
    ``raw`` is what a generator said of the rows that pass ``needs_generation``; rows below the floor are
    refused whatever it holds.
    """
    frame = answers.join(best_similarity(hits), "question_id", "left").join(printed(context), "question_id", "left")
    frame = frame.withColumns({"best": F.coalesce("best", F.lit(0.0)), "pages": F.coalesce("pages", F.array().cast(PAGES)), "raw": F.coalesce("raw", F.lit(""))})
    shown = F.transform("pages", lambda p: p["page"])
    stripped = T.strip_after_refusal(F.col("raw"))
    frame = recite(frame.withColumn("text", stripped))
    frame = frame.withColumn("invalid_citations", invalid_pages(F.col("text"), shown)).withColumn("text", flag_citations(F.col("text"), shown))
    frame = frame.withColumn("scrubbed", T.advice_removed(F.col("text"))).withColumn("text", T.scrub_advice(F.col("text")))
    frame = frame.withColumn("ungrounded", ungrounded(F.col("text"), F.col("pages")))
    below = F.col("best") < floor
    declined = T.is_refusal(stripped)
    uncited = F.size(T.cited_pages(F.col("text"))) == 0
    why = (
        F.when(below, F.format_string(X.BELOW_FLOOR, F.format_string("%.3f", "best"), F.lit(str(floor))))
        .when(declined, F.concat(F.lit(X.NO_ANSWER), F.when(F.trim("raw") != stripped, X.CUT_OFF).otherwise("")))
        .when(uncited & (F.size("invalid_citations") > 0), F.format_string(X.FOREIGN_PAGES, F.array_join(F.transform("invalid_citations", lambda p: p.cast("string")), ", ")))
        .when(uncited, X.UNCITED)
        .otherwise("")
    )
    frame = frame.withColumn("reason", why)
    early, refused = below | declined, F.col("reason") != ""
    none = lambda name: F.when(early, F.array().cast(dict(frame.dtypes)[name])).otherwise(F.col(name)).alias(name)
    late = lambda name: F.when(refused, F.array().cast(dict(frame.dtypes)[name])).otherwise(F.col(name)).alias(name)
    return frame.select("question_id", "raw", refused.alias("refused"), "reason", F.when(refused, X.REFUSAL).otherwise(F.col("text")).alias("text"), none("invalid_citations"), none("scrubbed"), late("ungrounded"), late("recited"))


def needs_generation(questions: DataFrame, hits: DataFrame, floor: float = X.MIN_SIMILARITY) -> DataFrame:
    """The questions worth a model call. A filter, so that no model function sees the others."""
    return questions.join(best_similarity(hits).where(F.col("best") >= floor), "question_id", "left_semi")


def prompts(context: DataFrame) -> DataFrame:
    """question_id and prompt: the extracts in order of position, numbered and labelled with page and scope."""
    line = F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(", "), F.col("scope"), F.lit("\n"), F.col("text"))
    ordered = context.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("extracts"))
    numbered = F.transform("extracts", lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e["line"]))
    return ordered.select("question_id", F.array_join(numbered, "\n\n").alias("prompt"))
