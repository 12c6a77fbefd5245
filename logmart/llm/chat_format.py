"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: all preceding turns as
context and that reply as the only trainable text. A conversation whose last
turn isn't an assistant's gets one more example without trainable text, so
nothing of it is lost.

Template of a turn: ``<role>text</s>``. Inside roles and texts the control
characters are escaped: ``\\`` as ``\\s``, ``<`` as ``\\l``, ``>`` as
``\\g``, ``[`` as ``\\b`` and ``/`` in roles as ``\\f``. After a backslash
comes one of these letters only, so plain replacements undo it exactly, and
no text can hold a turn mark or ``[INST]``.

Turns are ordered by turn (nulls first), then role and text, so repeated rows
have a fixed order. Null texts and roles are empty. Rows with a null
conversation id form one conversation of their own. An example holds its
whole prefix, so a conversation's turns are one row: its size must fit in a
task, which is what the expansion asks for anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"), ("[", "\\b"))
END = "</s>"


def _replace(x: Column, pairs) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def escape(x: Column) -> Column:
    return _replace(x, PAIRS)


def unescape(x: Column) -> Column:
    return _replace(x, [(new, old) for old, new in reversed(PAIRS)])


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("/"), F.lit("\\f"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("\\f"), F.lit("/")))


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", target: str = "assistant") -> DataFrame:
    """``conv_id``, ``example`` (from 0), ``target_turn`` (place of the
    reply, null without one), ``formatted``, ``loss_start``, ``loss_chars``
    (code points)."""
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                   F.coalesce(text_col, F.lit("")).alias("text"))
    conv = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("t"))
    conv = conv.select("conv_id", F.transform("t", lambda x: F.struct(
        F.concat(F.lit("<"), escape_role(x["role"]), F.lit(">")).alias("head"),
        escape(x["text"]).alias("body"), (x["role"] == target).alias("reply"))).alias("t"))
    places = F.filter(F.sequence(F.lit(0), F.size("t") - 1),
                      lambda i: F.get("t", i)["reply"] | (i == F.size("t") - 1))
    one = conv.select("conv_id", "t", F.posexplode(places).alias("example", "at"))
    context = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("at")),
                                       lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    last = F.get("t", F.col("at"))
    one = one.select("conv_id", "example", F.when(last["reply"], F.col("at")).alias("target_turn"),
                     F.concat(context, last["head"]).alias("before"), last["body"].alias("body"))
    return one.select("conv_id", "example", "target_turn",
                      F.concat("before", "body", F.lit(END)).alias("formatted"),
                      F.length("before").alias("loss_start"),
                      F.when(F.col("target_turn").isNotNull(), F.length("body")).otherwise(0).alias("loss_chars"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: array of (role, text)."""
    return F.transform(F.slice(F.split(formatted, END), F.lit(1), F.size(F.split(formatted, END)) - 1), lambda x: F.struct(
        unescape_role(F.substring(x, F.lit(2), F.instr(x, ">") - 2)).alias("role"),
        unescape(F.substring(x, F.instr(x, ">") + 1, F.length(x))).alias("text")))


def trained_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.substring(formatted, start + 1, chars))


def conversation_digests(ex: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: number and digest of
    the turns, length and digest of the trained text, formatted length."""
    last = F.max_by("formatted", "example")
    per = ex.groupBy("conv_id").agg(
        last.alias("whole"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", trained_text(
            F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("text")))).alias("loss"))
    per = per.withColumn("turns", parse(F.col("whole"))).withColumn(
        "trained", F.array_join(F.transform("loss", lambda x: x["text"]), ""))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars")
