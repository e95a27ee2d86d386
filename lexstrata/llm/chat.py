"""Chat formatting by prefix-target expansion, in Spark SQL expressions only.

A conversation's turns are put in order and rendered once.  Every assistant
turn then becomes an example: all turns before it are its context and only its
own text is trainable.  Turns after the last assistant turn are kept as an
example without a target, so nothing of a conversation is lost.

Template, for each turn: ``### role: text</turn>`` and a line feed.  Inside
roles and texts the four strings that carry structure are written as a
backslash and a letter (see ``ESCAPES``); the backslash itself is among them,
so the writing can be undone.

Cases: a null text, role or both is empty text; turns with equal numbers are
ordered by role, then text; repeated rows are repeated turns; a null conv_id is
a conversation of its own; a conversation without assistant turns has one
example without a target; extra columns are ignored.  A conversation's text has
to fit in one row, since each example holds it up to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (string, how it is written inside a turn); the backslash comes first.
ESCAPES = (("\\", "\\b"), ("### ", "\\h"), ("</turn>", "\\t"), (":", "\\c"))
TURN_END = "</turn>\n"
TARGET_ROLE = "assistant"


def escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), escaped(role), F.lit(": "), escaped(text), F.lit(TURN_END))


def chat_examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn, and one for turns after the last of them.

    Returns conv_id, example (from 0), n_context (turns before the target),
    context, target (escaped text, the only trainable part; null without
    one), loss_start and loss_chars (code points in ``text``) and text, which
    is the context, the target turn and its end mark.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    marked = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(escaped(t["text"]).alias("written"), rendered_turn(t["role"], t["text"]).alias("shown"), (t["role"] == TARGET_ROLE).alias("trainable"))).alias("turns"),
    )
    last = F.size("turns")
    at = F.filter(F.transform("turns", lambda t, i: F.when(t["trainable"], i)), lambda i: i.isNotNull())
    spots = marked.withColumn("at", at)
    tail = F.coalesce(F.try_element_at("at", F.lit(-1)), F.lit(-1)) < last - 1
    spots = spots.withColumn("at", F.when(tail, F.concat("at", F.array(F.lit(-1)))).otherwise(F.col("at")))
    one = spots.select("conv_id", "turns", F.posexplode("at").alias("example", "at"))
    n_context = F.when(F.col("at") < 0, F.size("turns")).otherwise(F.col("at"))
    shown = lambda turns: F.array_join(F.transform(turns, lambda t: t["shown"]), "")
    target = F.when(F.col("at") >= 0, F.col("turns")[F.col("at")])
    rows = one.select(
        "conv_id",
        "example",
        n_context.cast("long").alias("n_context"),
        shown(F.slice("turns", F.lit(1), n_context)).alias("context"),
        target["written"].alias("target"),
        F.coalesce(target["shown"], F.lit("")).alias("target_turn"),
    )
    return rows.select(
        "conv_id",
        "example",
        "n_context",
        "context",
        "target",
        F.when(F.col("target").isNotNull(), F.char_length("context") + F.char_length("target_turn") - F.char_length("target") - len(TURN_END)).cast("long").alias("loss_start"),
        F.coalesce(F.char_length("target"), F.lit(0)).cast("long").alias("loss_chars"),
        F.concat("context", "target_turn").alias("text"),
    )


def turns_of(text: Column) -> Column:
    """The (role, text) pairs of rendered turns, unescaped."""
    pieces = F.split(text, TURN_END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(5)), ": ", 1)).alias("role"),
            unescaped(F.substr(p, F.char_length(F.substring_index(p, ": ", 1)) + 3)).alias("text"),
        ),
    )


def chat_digest(examples: DataFrame) -> DataFrame:
    """Read the examples back, one row per conversation.

    The turns come out of the longest example's text and the trained text out
    of each example's loss span.  Rows of a conversation already lie in one
    partition, so this adds no exchange.
    """
    under = F.substr("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    spans = examples.select("conv_id", "example", "text", F.when(F.col("loss_start").isNotNull(), F.struct("example", unescaped(under).alias("said"))).alias("span"))
    whole = spans.groupBy("conv_id").agg(F.max_by("text", "example").alias("text"), F.sort_array(F.collect_list("span")).alias("spans"))
    trained = F.array_join(F.transform("spans", lambda s: s["said"]), "")
    read = whole.select("conv_id", "text", turns_of(F.col("text")).alias("turns"), trained.alias("trained"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.encode("trained", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("text").cast("long").alias("formatted_chars"),
    )
