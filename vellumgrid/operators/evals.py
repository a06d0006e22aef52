"""Grading, roll-ups, retrieval metrics and threshold fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.sources.tables import keep


def grade(samples: DataFrame) -> DataFrame:
    """Adds leaked and passed to graded samples (answerable, refused, text, raw, correct, faithful, n_invalid, n_ungrounded).

    A leak is judged on the model's own words, whatever a guard repaired since.
    """
    raw = F.trim(F.coalesce("raw", "text"))
    leaked = F.startswith(raw, F.lit(X.REFUSAL)) & (raw != X.REFUSAL)
    bare = F.col("refused") & (F.trim("text") == X.REFUSAL)
    right = ~F.col("refused") & ~leaked & F.col("correct") & F.col("faithful") & (F.col("n_invalid") == 0) & (F.col("n_ungrounded") == 0)
    return samples.withColumns({"leaked": leaked, "passed": F.when(F.col("answerable"), F.coalesce(right, F.lit(False))).otherwise(bare & ~leaked)})


def rollup(graded: DataFrame) -> DataFrame:
    """passed, total, leaks, ungrounded by type, by split, by answerable and over all: one pass over the samples."""
    return graded.sparkSession.sql(
        """
        select case grouping_id(type, split, answerable) when 3 then 'type' when 5 then 'split' when 6 then 'answerable' else 'all' end as dimension,
          coalesce(type, split, cast(answerable as string), 'all') as value,
          count_if(passed) as passed, count(*) as total, count_if(leaked) as leaks, count_if(n_ungrounded > 0) as ungrounded
        from {graded} group by grouping sets ((type), (split), (answerable), ())
        """,
        graded=graded,
    )


def retrieval_metrics(hits: DataFrame, expected: DataFrame, shown: int = 5, gate_depth: int = 8) -> DataFrame:
    """n_answerable, n_hits (an expected key within ``shown``), weakest, strongest and gap of best scores."""
    best = hits.where(F.col("rank") <= gate_depth).groupBy("question_id").agg(F.max("score").alias("best"))
    wanted = expected.where("key is not null").select("question_id", "key").distinct()
    found = hits.join(wanted, ["question_id", "key"]).groupBy("question_id").agg(F.min("rank").alias("first"))
    each = expected.groupBy("question_id").agg(F.max(F.col("key").isNotNull()).alias("answerable")).join(best, "question_id", "left").join(found, "question_id", "left")
    yes = F.col("answerable")
    out = each.agg(
        F.count_if(yes).alias("n_answerable"),
        F.count_if(yes & (F.coalesce("first", F.lit(shown + 1)) <= shown)).alias("n_hits"),
        F.min(F.when(yes, F.coalesce("best", F.lit(0.0)))).alias("weakest"),
        F.max(F.when(~yes, F.coalesce("best", F.lit(0.0)))).alias("strongest"),
    )
    return out.withColumn("gap", F.col("weakest") - F.col("strongest"))


#: Distinct scores of a range, about, and ranges at most.
RANGE_SCORES, MAX_RANGES = 100_000, 4096


def fit_threshold(scores: DataFrame) -> DataFrame:
    """threshold and errors of the cut between scores (score, answerable) with the fewest errors, the larger on a tie.

    Where the classes are apart it is the midpoint of the gap. Errors come from running counts over the distinct scores: these are
    dealt into ranges by approximate quantiles, counted within each, and each range starts from the sums of those before it.
    So nothing is compared pairwise and no task orders all scores. Null scores take no part.
    """
    by_score = keep(scores.where("score is not null").groupBy("score").agg(F.count_if("answerable").alias("yes"), F.count_if(~F.col("answerable")).alias("no")))
    n = min(MAX_RANGES, -(-by_score.count() // RANGE_SCORES))
    splits = by_score.withColumn("score", F.col("score").cast("double")).approxQuantile("score", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    ranged = by_score.withColumn("range", F.size(F.filter(F.array(*map(F.lit, sorted(set(splits)))).cast("array<double>"), lambda s: s <= F.col("score"))) if splits else F.lit(0))
    # As many rows as ranges.
    over = Window.orderBy("range")
    before, after = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    sums = ranged.groupBy("range").agg(F.sum("yes").alias("y"), F.sum("no").alias("n"), F.min("score").alias("first"))
    sums = sums.select("range", F.coalesce(F.sum("y").over(before), F.lit(0)).alias("yes_before"), F.coalesce(F.sum("n").over(after), F.lit(0)).alias("no_after"), F.lead("first").over(over).alias("next"))
    within = Window.partitionBy("range").orderBy("score")
    later = within.rowsBetween(1, Window.unboundedFollowing)
    cuts = ranged.join(F.broadcast(sums), "range").select(
        ((F.col("score") + F.coalesce(F.lead("score").over(within), F.col("next"))) / 2).alias("threshold"),
        (F.col("yes_before") + F.sum("yes").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("no").over(later), F.lit(0)) + F.col("no_after")).alias("errors"),
    ).where("threshold is not null")
    return cuts.agg(F.min_by("threshold", F.struct("errors", (-F.col("threshold")).alias("t"))).alias("threshold"), F.min("errors").alias("errors"))


def question_rollup(graded: DataFrame) -> DataFrame:
    """passed, total, correct, faithful (null where there is no answer to be right), leaks, ungrounded and recited of each question's samples."""
    yes = lambda c: F.when(F.first("answerable"), F.count_if(F.coalesce(c, F.lit(False)))).alias(c)
    return graded.groupBy("question_id", "type", "split").agg(
        F.count_if("passed").alias("passed"), F.count("*").alias("total"), yes("correct"), yes("faithful"), F.count_if("leaked").alias("leaks"), F.count_if(F.col("n_ungrounded") > 0).alias("ungrounded"), F.count_if(F.col("n_recited") > 0).alias("recited")
    )


def answer_in_context(context: DataFrame, expected: DataFrame) -> DataFrame:
    """question_id, present, page and chunk (the first place that holds the answer text), n_chunks and tokens of each question's packed context.

    ``context``: question_id, page, chunk, position, tokens, text; ``expected``: question_id, answer_text. A question without context misses its answer.
    """
    held = context.join(expected, "question_id").withColumn("here", F.contains("text", F.col("answer_text")))
    at = F.min(F.when(F.col("here"), F.struct("position", "page", "chunk"))).alias("at")
    found = held.groupBy("question_id").agg(at, F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens"))
    out = expected.select("question_id").join(found, "question_id", "left")
    return out.select("question_id", F.col("at").isNotNull().alias("present"), "at.page", "at.chunk", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def disclosure_checks(cases: DataFrame) -> DataFrame:
    """Adds passed: the answer holds every string of ``contains``, or is the refusal where one is due."""
    holds = F.forall("contains", lambda s: F.contains("answer", s))
    return cases.withColumn("passed", F.when(F.col("refusal"), F.col("answer") == X.REFUSAL).otherwise(F.size("contains").cast("boolean") & holds))
