"""Chat formatting: every assistant turn becomes an example of its own.

Prefix-target expansion: an example holds all turns before a reply as context and the reply, and only
the reply is trainable. A conversation that does not end with a reply (or has none) also gives one
example without a trainable part, so no turn is lost. Built-in expressions only.

A turn reads OPEN role newline text CLOSE newline. A control string inside a text gets a backslash
after its first character, and one more if backslashes stand there already, so it can neither be taken
for markup nor be confused with another text, and taking one backslash away restores the text. In a
role, a backslash is written as backslash b and a newline as backslash n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"
# Starts of control strings of this template and of other common ones.
CONTROL = r"(\||/?s>|/?INST\]|/?SYS>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", "$1$2$3")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def format_examples(turns: DataFrame, reply_role: str = "assistant") -> DataFrame:
    """conv_id, example (0, 1, ...), n_turns, text, loss_start and loss_chars (code points of the text; null without
    a reply).

    Turns go by turn, then role, then text; a null text or role is empty, a null turn comes first, and rows without a
    conv_id form one conversation. Repeated rows are turns like others. Extra columns are not read; an empty table
    gives no examples. A conversation is the unit of the output, whose examples all begin with its first turn, so its
    turns meet in one row; conversations are spread by conv_id.
    """
    chosen = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    head = F.concat(F.lit(OPEN), _role_out(F.col("role")), F.lit("\n"))
    written = chosen.select("conv_id", F.struct(
        "turn", "role", "body", head.alias("head"), escape(F.col("body")).alias("safe")).alias("t"))
    grouped = written.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    targets = grouped.withColumn("at", F.filter(
        F.sequence(F.lit(0), F.size("t") - 1),
        lambda i: (F.get("t", i)["role"] == reply_role) | (i == F.size("t") - 1)))
    exploded = targets.select("conv_id", "t", F.posexplode("at").alias("example", "i"))
    whole = F.expr("array_join(transform(slice(t, 1, i + 1), "
                   f"x -> concat(x.head, x.safe, '{CLOSE}\n')), '')")
    last = F.get("t", "i")
    reply = last["role"] == reply_role
    size = F.length(last["safe"])
    made = exploded.select("conv_id", "example", (F.col("i") + 1).alias("n_turns"), whole.alias("text"),
                           F.when(reply, size).alias("loss_chars"))
    start = F.length("text") - F.col("loss_chars") - len(CLOSE) - 1
    return made.withColumn("loss_start", start).select(
        "conv_id", "example", "n_turns", "text", "loss_start", "loss_chars")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    parts = F.slice(F.split(text, r"<\|turn\|>"), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(
        _role_in(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - (len(CLOSE) + 1))).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted texts alone: conv_id, turns, replies, formatted_chars.

    turns are those of the longest example; replies are the texts under the loss mask, one for each example with one.
    """
    masked = unescape(F.expr("substr(text, loss_start + 1, loss_chars)"))
    rows = examples.select("conv_id", "example", F.length("text").cast("long").alias("chars"), "text",
                           F.when(F.col("loss_start").isNotNull(), masked).alias("reply"))
    grouped = rows.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("r"))
    return grouped.select("conv_id", read_turns(F.col("text")).alias("turns"),
                          F.col("r.reply").alias("replies"), "formatted_chars")
