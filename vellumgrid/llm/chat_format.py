"""Chat formatting in Spark expressions only.

The rows of a conversation are collected as structs and sorted by turn; adjacent turns of one role are
merged by an array aggregation and the blocks are concatenated. The template is

    <|im_start|>role newline text [<|im_next|> text ...] <|im_end|> newline

where <|im_next|> parts turns that were merged, so that they can be told apart again. Inside roles
and texts a backslash is doubled and "<|" becomes "<\\|" (and a line end inside a role becomes "\\n"),
so no control string can come from a text and the output can be read back exactly. Merging goes by the places where the
role changes, and spans by sums over lengths in two levels, so that long conversations do not cost their square.

Under the loss mask stand the texts of assistant turns, as spans of code points of the output. A null
text or role is empty; rows whose turns tie are ordered by role, then text; repeated rows are repeated
turns; a null conversation id is a conversation of its own; an empty table gives an empty table. Texts may be of any
length; a conversation is one output row, so it has to fit into one. Other columns, whatever their names, are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm._arrow import columns

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\([\\|])", "$1")).otherwise(text)


def unescape_role(role: Column) -> Column:
    # Doubled backslashes part the pieces in which what is left of the escapes is unambiguous.
    pieces = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.when(F.contains(role, F.lit("\\")), F.array_join(pieces, "\\")).otherwise(role)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_col``, formatted (string) and loss_spans (array of start, length in code points) for each conversation."""
    rows = columns(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select("conv", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # Where runs of one role begin, counted from 0, and one place more for the end.
    changes = F.filter(F.transform("turns", lambda t, i: F.when((i == 0) | (t["role"] != F.get("turns", i - 1)["role"]), i)), lambda i: i.isNotNull())
    runs = sorted_turns.select("conv", "turns", F.concat(changes, F.array(F.size("turns"))).alias("bounds"))
    blocks = F.transform(F.slice("bounds", F.lit(1), F.size("bounds") - 1), lambda i, k: F.slice("turns", i + 1, F.get("bounds", k + 1) - i))
    merged = runs.select("conv", blocks.alias("blocks"))

    # Every piece of the output: markers and roles outside the mask, texts perhaps inside.
    def pieces(b: Column) -> Column:
        role = F.get(b, F.lit(0))["role"]

        def piece(s: Column, on: Column) -> Column:
            return F.struct(s.alias("s"), on.alias("on"))

        texts = F.transform(b, lambda t, i: F.array(piece(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), F.lit(False)), piece(escape(t["text"]), role == LEARNT)))
        return F.concat(F.array(piece(F.concat(F.lit(START), escape_role(role), F.lit("\n")), F.lit(False))), F.flatten(texts), F.array(piece(F.lit(END + "\n"), F.lit(False))))

    laid = merged.select("conv", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    measured = laid.select("conv", "pieces", F.transform("pieces", lambda p: F.length(p["s"]).cast("long")).alias("lengths"))
    placed = measured.select("conv", "pieces", "lengths", sums_before(F.col("lengths")).alias("starts"))
    spans = F.transform("pieces", lambda p, i: F.when(p["on"] & (F.get("lengths", i) > 0), F.struct(F.get("starts", i).alias("start"), F.get("lengths", i).alias("length"))))
    return placed.select(F.col("conv").alias(conv_col), F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), F.array_compact(spans).alias("loss_spans"))


def sums_before(numbers: Column, block: int = 64) -> Column:
    """The sum of all numbers before each one: within blocks, then over the blocks' sums, then both together."""
    longs = "array<bigint>"

    def running(a: Column) -> Column:
        # An array grows by copying, so it is only done over short ones.
        return F.aggregate(a, F.array(F.lit(0).cast("long")).cast(longs), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    n = F.ceil(F.size(numbers) / block).cast("int")
    parts = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: running(F.slice(numbers, k * block + 1, block)))
    both = F.transform(F.array(parts), lambda p: F.struct(p.alias("parts"), running(F.transform(p, lambda r: F.element_at(r, -1))).alias("before")))

    def joined(x: Column) -> Column:
        return F.flatten(F.transform(x["parts"], lambda r, k: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda v: v + F.get(x["before"], k))))

    return F.get(F.transform(both, joined), F.lit(0))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_col``, formatted, turns (array of role and text) and loss_text, from the output alone.

    The text under the mask is cut from the block that holds it, so that no cut counts through the whole output.
    """
    marker = len(START)
    bodies = F.split("formatted", r"<\|im_start\|>")
    parts = formatted.select(conv_col, "formatted", "loss_spans", F.slice(bodies, F.lit(2), F.size(bodies)).alias("blocks"))
    placed = parts.withColumn("starts", sums_before(F.transform("blocks", lambda b: (F.length(b) + marker).cast("long"))))

    def turns(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        body = F.substr(b, F.length(role) + 2, F.length(b) - F.length(role) - 1 - len(END + "\n"))
        return F.transform(F.split(body, r"<\|im_next\|>"), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    def masked(b: Column, k: Column) -> Column:
        begin = F.get("starts", k) + marker
        own = F.filter("loss_spans", lambda s: (s["start"] >= begin) & (s["start"] < begin + F.length(b)))
        return F.array_join(F.transform(own, lambda s: unescape(F.substr(b, (s["start"] - begin + 1).cast("int"), s["length"].cast("int")))), "")

    return placed.select(conv_col, "formatted", F.flatten(F.transform("blocks", turns)).alias("turns"), F.array_join(F.transform("blocks", masked), "").alias("loss_text"))
