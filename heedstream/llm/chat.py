"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are
context and only its text lies under the loss mask. A conversation that
doesn't end with an assistant turn gets a last example with an empty mask,
so that no turn is lost. A turn reads ``<turn>role<text>text<end>``; inside
roles and texts a backslash becomes ``\\b``, ``<`` becomes ``\\a`` and ``[``
becomes ``\\l``, so that no control string of this or of the usual
bracketed templates can stand in a text, and the way back is exact.

Nulls: a null text or role is empty, a null conversation id is a
conversation of its own, null turn numbers come first. Rows with equal turn
numbers follow each other by role and text; repeated rows stay. Output text
grows with the square of one conversation's turns, as the method has it;
conversations are handled apart from each other. A conversation is gathered
as one row with all its turns, and reading back gathers its examples: a task
must hold the longest conversation's text, and its examples together, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<turn>", "<text>", "<end>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\a")), F.lit("["), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("[")), F.lit("\\a"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def expand(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """Rows (conv_id, example, formatted, loss_start, loss_chars): code points, from 0."""
    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    marked = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: F.when(t["role"] == trainable, F.length(escape(t["text"]))).otherwise(F.lit(-1))).alias("reply"),
    )
    ends = F.filter(F.transform("reply", lambda n, i: F.when((n >= 0) | (i == F.size("reply") - 1), F.struct((i + 1).alias("turns"), n.alias("chars")))), lambda x: x.isNotNull())
    each = marked.select("conv_id", "parts", F.posexplode(ends).alias("example", "target"))
    text = F.array_join(F.slice("parts", F.lit(1), F.col("target.turns")), "")
    out = each.select("conv_id", "example", text.alias("formatted"), F.greatest("target.chars", F.lit(0)).alias("loss_chars"))
    return out.select("conv_id", "example", "formatted", (F.length("formatted") - len(END) - F.col("loss_chars")).alias("loss_start"), "loss_chars")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples hold: turns (role, text), loss texts, sizes."""
    piece = unescape(F.expr("substring(formatted, loss_start + 1, loss_chars)"))
    each = examples.select("conv_id", "example", F.when(F.col("loss_chars") > 0, piece).otherwise("").alias("loss"), F.length("formatted").cast("long").alias("chars"), "formatted")
    whole = each.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss_text"),
        F.sum("chars").alias("formatted_chars"),
        F.max_by("formatted", "example").alias("last"),
    )
    turns = F.split("last", TURN)
    parts = F.transform(F.slice(turns, F.lit(2), F.size(turns)), lambda p: F.split(p, f"{TEXT}|{END}"))
    return whole.select("conv_id", F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text"))).alias("turns"), "loss_text", "formatted_chars")
