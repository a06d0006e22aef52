"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Null and blank texts have no words: every count is 0 and the document fails. Rows are independent of
one another; repeated rows give repeated results and an empty table gives an empty one. The work on a
text grows as n log n with its words, however often they repeat. A value on a bound is within it, so there are no ties. Other
columns, whatever their names, are dropped. The stop words are of four languages: texts in any other fail their rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm._arrow import columns

#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that for on with as was by at an be this are from or which not have "
    "le la les de des du et en un une que dans pour sur est pas au ce qui avec "
    "der die das und zu den von mit dem ein eine nicht ist auf im des sich für als auch "
    "el los las y del por con para se una no su lo como más o pero sus al"
).split()

#: measure, lowest and highest value that a kept document may have (None: no bound).
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("mean_word_chars", 1.5, 15.0),
    ("symbols_per_word", None, 0.1),
    ("stop_word_share", 0.01, None),
    ("duplicate_line_share", None, 0.5),
    ("repeated_word_share", None, 0.3),
)

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and every document's counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words."""
    base = columns(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    split = base.select(
        "id",
        words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit("[^\\x20\\x09-\\x0D]"))).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    hashed = split.select(
        "id",
        "words",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    # Only where hashes repeat are windows compared, and then as words: sorted, equal windows are neighbours.
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = hashed.withColumn("placed", F.when(some, placed)).drop("hashes")

    def same(p: Column, k: Column) -> Column:
        other = F.get("placed", k)
        return (other["h"] == p["h"]) & (F.slice("words", other["i"] + 1, WINDOW) == F.slice("words", p["i"] + 1, WINDOW))

    repeated = F.array_sort(F.transform(F.filter("placed", lambda p, k: F.coalesce(same(p, k - 1), F.lit(False)) | F.coalesce(same(p, k + 1), F.lit(False))), lambda p: p["i"]))
    found = sorted_.withColumn("repeated", F.when(F.col("placed").isNotNull(), repeated)).drop("placed", "words")
    covered = F.aggregate(F.transform("repeated", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("repeated", k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return found.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_stop_words")


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def apply_rules(measured: DataFrame, rules: tuple[tuple[str, float | None, float | None], ...] = RULES) -> DataFrame:
    """Adds base_failed and kept: the threshold table as one projection."""
    values = {
        "n_words": F.col("n_words"),
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_share": ratio("n_stop_words", "n_words"),
        "duplicate_line_share": ratio("n_dup_lines", "n_lines"),
        "repeated_word_share": ratio("n_repeat_words", "n_words"),
    }
    within = [values[name] >= low for name, low, _ in rules if low is not None] + [values[name] <= high for name, _, high in rules if high is not None]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumns({"base_failed": failed, "kept": ~failed & reduce(lambda a, b: a & b, within, F.lit(True))})
