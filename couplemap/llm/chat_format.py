"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all preceding turns as context, the
reply as the only trainable text.  A conversation that does not end with an
assistant turn gets one more example without trainable text, so that the
output holds every turn.

Template: ``<|turn|>role\\ntext<|end|>\\n`` per turn.  Inside roles and texts
the control strings of this and other common templates are escaped
reversibly: ``&`` becomes ``&amp;``, the first character of a control string
``&lt;`` or ``&#91;``; a line break inside a role becomes ``&#10;``.

Definitions.  Turns are ordered by turn, then role, then text, nulls first;
repeated rows are turns of their own.  Null roles and texts are empty.  A null
conversation id is a conversation.  The examples' texts grow with the square
of a conversation's length by definition; they are made one at a time beside
the conversation and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|turn|>", "<|end|>\n"
#: Control strings of common templates (fixed values): what, and its escape.
CONTROLS = [("<|", "&lt;|"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"), ("<<SYS>>", "&lt;<SYS>>")]
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for plain, safe in CONTROLS:
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescape(text: Column) -> Column:
    out = text
    for safe, plain in (("&lt;", "<"), ("&#91;", "["), ("&#10;", "\n"), ("&amp;", "&")):
        out = F.replace(out, F.lit(safe), F.lit(plain))
    return out


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, example, text, loss_start, loss_end): one row per example;
    the loss mask is a code point interval of the text, end exclusive."""
    turns = rows.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column) -> Column:
        head = F.concat(F.lit(BEGIN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
        body = escape(t["text"])
        return F.struct(
            (t["role"] == TARGET_ROLE).alias("target"), F.concat(head, body, F.lit(END)).alias("whole"),
            F.length(head).cast("long").alias("head"), F.length(body).cast("long").alias("body"))

    pieces = whole.select("conv", F.transform("turns", piece).alias("pieces"))
    each = pieces.select("conv", F.col("pieces.whole").alias("wholes"), F.size("pieces").alias("n"), F.posexplode("pieces").alias("at", "p"))
    text = F.array_join(F.slice("wholes", F.lit(1), F.col("at") + 1), "")
    example = each.where(F.col("p.target") | (F.col("at") == F.col("n") - 1)).select("conv", F.col("at").cast("long").alias("example"), "p", text.alias("text"))
    end = F.length("text") - F.lit(len(END))
    return example.select(
        "conv", "example", "text",
        F.when(F.col("p.target"), end - F.col("p.body")).otherwise(F.length("text")).cast("long").alias("loss_start"),
        F.when(F.col("p.target"), end).otherwise(F.length("text")).cast("long").alias("loss_end"))


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def read_turns(text: Column) -> Column:
    """The (role, text) turns that an example's text holds."""
    cut = F.filter(F.split(text, r"<\|end\|>\n", -1), lambda p: F.startswith(p, F.lit(BEGIN)))
    body = lambda p: F.substring(p, F.lit(len(BEGIN) + 1), F.length(p))

    def turn(p: Column) -> Column:
        role = F.substring_index(body(p), "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(body(p), F.length(role) + 2, F.length(p))).alias("text"))

    return F.transform(cut, turn)


def conversation_digests(examples: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars),
    read back from the examples."""
    read = examples.groupBy("conv").agg(
        F.max_by("text", "example").alias("full"),
        F.sort_array(F.collect_list(F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss")))).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    ).select("conv", read_turns(F.col("full")).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("loss"), "formatted_chars")
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
