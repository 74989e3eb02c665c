"""Chat formatting with Spark expressions only.

A conversation's turns are put in order, collected as structs and sorted; adjacent turns of one role become one block;
blocks are concatenated by array functions. The layout of a block is ``<s>role[INST]text[/INST]</s>``; further turns of the same role add
``[INST]text[/INST]`` to the block, so that the turns can be read back. Control strings inside roles and texts get a
backslash after their first character (and one more if they have some already), which ``unescape`` takes away again.

Defined results: a null role or text is empty; ties of a turn number are ordered by role, then text; repeated rows stay;
a null conversation id is a conversation of its own; an empty table gives an empty result; other columns are ignored;
texts of any length are kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

_CONTROL = r"([\[<])(\\*)(/?INST\]|/?s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)(/?INST\]|/?s>)", r"$1$2$3")


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, formatted string, loss_spans array<struct<start,end>>): spans of code points of the escaped texts to learn.

    Where a turn's text stands is a running sum of lengths, so that a conversation of many turns costs a sort and no more."""
    body = lambda c: escape(F.coalesce(F.col(c), F.lit("")))
    turns = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), body(role).alias("role"), body(text).alias("body"), F.coalesce(F.col(role).isin(*learn), F.lit(False)).alias("loss"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "body", "loss")
    before = F.lag("role").over(order)
    lead = F.when(before == F.col("role"), "[INST]").otherwise(F.concat(F.when(before.isNull(), "<s>").otherwise("</s><s>"), F.col("role"), F.lit("[INST]")))
    led = turns.select("*", lead.alias("lead"), F.row_number().over(order).alias("i"))
    size = F.length("lead") + F.length("body") + 7
    placed = led.select("conv", "i", "lead", "body", "loss", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("to"))
    start = F.col("to") - 7 - F.length("body")
    piece = F.struct("i", F.concat("lead", "body", F.lit("[/INST]")).alias("piece"), F.when(F.col("loss"), F.struct(start.cast("int").alias("start"), (F.col("to") - 7).cast("int").alias("end"))).alias("span"))
    grouped = placed.groupBy("conv").agg(F.sort_array(F.collect_list(piece)).alias("ps"))
    formatted = F.concat(F.array_join(F.transform("ps", lambda p: p["piece"]), ""), F.lit("</s>"))
    spans = F.transform(F.filter("ps", lambda p: p["span"].isNotNull()), lambda p: p["span"])
    return grouped.select(F.col("conv").alias(conv), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>>: the turns, from the formatted string alone."""
    blocks = F.split(formatted, r"\Q</s>\E", -1)

    def turns(block: Column) -> Column:
        return let(
            F.split(block, r"\Q[INST]\E", -1),
            lambda parts: F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(unescape(F.substr(F.get(parts, F.lit(0)), F.lit(4))).alias("role"), unescape(F.substr(p, F.lit(1), F.length(p) - 7)).alias("text"))),
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
