"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and the loss mask
over that reply only.  Turns after the last reply become one example without a target, so the
output holds every turn.  Rows of a conversation meet in one group, as an example's context needs
them; examples are rows of their own after that.  Only DataFrame expressions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: head, role, colon, text, end.  `###` and `</turn>` are its control strings.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
TARGET = "assistant"


def escape(text: Column) -> Column:
    """After this no control string stands in the text; unescape() undoes it exactly."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.regexp_replace(text, "(?<=#)#", "\\\\#")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = TARGET
) -> DataFrame:
    """One row per example: id, example (from 0), n_examples, text, loss_start, loss_end.

    loss_start and loss_end are code-point offsets of the trainable reply; both null in the example that
    holds the turns after the last reply (and in that of a conversation without a reply).  Turns go by
    turn number (null first), then role, then text.  Null roles and texts count as empty.  A null id is
    a conversation of its own; repeated rows are turns of their own.  Other columns are ignored,
    whatever their names.  An empty table gives an empty result.  Very long texts are formatted as a whole; a
    conversation's turns meet in one row, and every reply repeats the turns before it.
    """
    body = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.select(F.col(conv_col).alias("id"), body.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit(HEAD), _escape_role(t["role"]), F.lit(COLON), escape(t["text"]), F.lit(END)))
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == target, i + 1)), lambda i: i.isNotNull())
    chats = chats.select("id", shown.alias("shown"), F.transform("turns", lambda t: F.char_length(escape(t["text"]))).alias("sizes"), F.size("turns").alias("n"), replies.alias("replies"))
    rest = F.coalesce(F.array_max("replies"), F.lit(0)) < F.col("n")
    ends = F.concat(F.transform("replies", lambda i: F.struct(i.alias("upto"), F.lit(True).alias("loss"))), F.when(rest, F.array(F.struct(F.col("n").alias("upto"), F.lit(False).alias("loss")))).otherwise(F.array().cast("array<struct<upto:int,loss:boolean>>")))
    rows = chats.select("id", "shown", "sizes", F.size(ends).alias("n_examples"), F.posexplode(ends).alias("example", "e"))
    text = F.array_join(F.slice("shown", F.lit(1), F.col("e.upto")), "")
    rows = rows.select("id", "example", "n_examples", text.alias("text"), F.when(F.col("e.loss"), F.element_at("sizes", F.col("e.upto"))).alias("size"))
    stop = F.when(F.col("size").isNotNull(), F.char_length("text") - len(END))
    return rows.select(F.col("id").alias(conv_col), F.col("example").cast("long").alias("example"), F.col("n_examples").cast("long").alias("n_examples"), "text", (stop - F.col("size")).cast("long").alias("loss_start"), stop.cast("long").alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    marked = F.filter(F.split(text, "</turn>\n"), lambda s: s != "")
    role = "(?s)^### ((?:[^\\\\:]|\\\\.)*): (.*)$"
    return F.transform(marked, lambda s: F.struct(unescape(F.regexp_extract(s, role, 1)).alias("role"), unescape(F.regexp_extract(s, role, 2)).alias("text")))


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.coalesce(unescape(F.substring(text, start.cast("int") + 1, (end - start).cast("int"))), F.lit(""))
