"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns up to it as text, only its reply trainable. A conversation
that does not end with an assistant turn gets one more example without a trainable span, so that no turn is lost.

The template writes a turn as `[TURN]role` newline `text</s>`. Inside roles and texts the characters with which control
strings begin are written as entities (`&` first), so no text can forge a mark, and reading back restores it exactly.

Turns are ordered by turn, role and text; repeated rows are turns of their own. Null roles and texts count as empty. Rows
without conv_id form one conversation, which like any other is one row: a table with very many of them should be given
ids first. A conversation's examples repeat its earlier turns, so very long conversations grow with the square of their turns. Columns beyond conv_id, turn, role and text are not carried. An empty table gives
no example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
TURN, END = "[TURN]", "</s>"


def escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("[", "&#91;"), ("<", "&lt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in (("<", "&lt;"), ("[", "&#91;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example from 0, text, loss_start, loss_chars): the span counts code points of text from 0.

    A conversation is gathered in one row, as its text is one string; nothing else is.
    """
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(TURN), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    blocks = talks.select(
        "conv_id",
        F.transform("ts", lambda t: F.struct(
            (t["role"] == "assistant").alias("own"), F.length(head(t)).alias("head"), escaped(t["text"]).alias("body"), head(t).alias("start")
        )).alias("bs"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("bs")), lambda i: F.element_at("bs", i)["own"] | (i == F.size("bs")))
    cut = blocks.select("conv_id", "bs", F.posexplode(ends).alias("example", "upto"))
    last = F.element_at("bs", F.col("upto"))
    text = F.array_join(F.transform(F.slice("bs", F.lit(1), F.col("upto")), lambda b: F.concat(b["start"], b["body"], F.lit(END))), "")
    made = cut.select("conv_id", "example", text.alias("text"), F.when(last["own"], F.length(last["body"])).alias("n"))
    return made.select(
        "conv_id",
        "example",
        "text",
        (F.length("text") - F.lit(len(END)) - F.coalesce("n", F.lit(0))).alias("loss_start"),
        F.coalesce("n", F.lit(0)).alias("loss_chars"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of structs of role and text."""
    parts = F.slice(F.split(text, r"\[TURN\]"), F.lit(2), F.greatest(F.lit(0), F.size(F.split(text, r"\[TURN\]")) - 1))
    body = lambda p: F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END))
    role = lambda p: F.replace(F.substring_index(p, "\n", 1), F.lit("&#10;"), F.lit("\n"))
    return F.transform(parts, lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(body(p)).alias("text")))


def read_loss(text: Column, start: Column, chars: Column) -> Column:
    """The trainable span of an example, unescaped."""
    return unescaped(F.substring(text, start + 1, chars))
