"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A turn is written as `<|im_start|>role` newline, text, `<|im_end|>` newline.  In roles and texts a backslash is doubled
and `<|` becomes `<\\|`, so control strings of the template occur nowhere else and can be told apart again; a role's
newline is written as `\\n` after a backslash of its own.

Every assistant turn becomes one example: all turns before it as context, and only its own text under the loss mask, given
as character positions [loss_start, loss_end).  Turns after the last assistant turn, or of a conversation without one,
come in one more example with an empty mask, so that the output holds every turn.

Rows of a conversation are ordered by turn (null first), then role and text; repeated rows are turns of their own.  Null
texts and roles count as empty.  A null conv_id is a conversation as any other.  Further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undo `escape`: a single backslash stands only inside `<\\|`, all others are pairs."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def turns_of(df: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, turns array<struct<turn, role, text>>) in order."""
    clean = df.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_turn"))
    return clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("turns"))


def expand(df: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end): the training examples of all conversations."""
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    parts = turns_of(df).select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(f"{END}\n"))).alias("written"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("sizes"),
        F.transform("turns", lambda t: t["role"] == TRAINED).alias("trained"),
    )
    last = F.size("written") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("trained", i) | (i == last))
    tail = len(END) + 1
    each = parts.select("conv_id", "written", "sizes", "trained", F.posexplode(ends).alias("example", "at"))
    formatted = each.select("conv_id", "example", F.array_join(F.slice("written", 1, F.col("at") + 1), "").alias("formatted"), F.get("sizes", F.col("at")).alias("_size"), F.get("trained", F.col("at")).alias("_trained"))
    stop = F.length("formatted") - tail
    return formatted.select("conv_id", "example", "formatted", F.when(F.col("_trained"), stop - F.col("_size")).otherwise(stop).alias("loss_start"), stop.alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Each example with `turns` array<struct<role, text>> and `loss_text`, taken from the formatted text alone."""
    bodies = F.filter(F.split(F.col("formatted"), r"<\|im_start\|>"), lambda x: x != "")
    turn = lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(x.substr(F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - 2 - len(END))).alias("text"),
    )
    loss = F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return examples.withColumns({"turns": F.transform(bodies, turn), "loss_text": unescape(loss)})


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples: the longest holds every turn, each mask one reply."""
    per = read_back(examples)
    told = per.groupBy("conv_id").agg(
        F.max_by("turns", "example").alias("turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss_text"))), lambda x: x["loss_text"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
