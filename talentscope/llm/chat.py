"""Operator 13: chat formatting with Spark expressions alone.

A conversation's rows are collected as structs and sorted by turn, then role,
then text.  Neighbours of one role are merged into one block:

    <s>user[INST]first text[/INST][INST]second text[/INST]</s>\\n

``segments`` holds the same text cut where the loss mask changes: (content,
loss), and ``formatted`` is their concatenation.  Loss is taken on assistant
texts alone, not on marks.  Wherever a text or role holds one of the four
control strings, a backslash goes behind its first character, and one more if
there are some already; ``unescaped`` takes one away.  So no control string
ever stands in an escaped text, and every text comes back as it was.

Defined results: a NULL text or role is empty; a NULL turn comes first; repeated
rows are turns of their own; a row without an id is a conversation of its own,
so that such rows never meet in one group.  Very long texts are whole.  An
empty table gives no rows; other columns are ignored.  A conversation is one
value of the result, so its turns meet in one task, and like every Spark
string it must stay under 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template: fixed values.
OPEN, TEXT, TEXT_END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>\n"
TRAINED = "assistant"

_TAIL = r"(/?s>|/?INST\])"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def escaped(text: Column) -> Column:
    """No ``<s>``, ``</s>``, ``[INST]`` or ``[/INST]`` is left in it."""
    return F.regexp_replace(text, r"([<\[])(\\*+)" + _TAIL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*+)" + _TAIL, "$1$2$3")


def _blocks(turns: Column) -> Column:
    """array<struct<role, texts>> of sorted turns: neighbours of one role are one block."""
    n = F.size(turns)

    def cut(starts: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(starts, k + 1), n)
        return F.transform(starts, lambda s, k: F.struct(F.get(turns, s)["role"].alias("role"), F.transform(F.slice(turns, s + 1, stop(k) - s), lambda t: t["text"]).alias("texts")))

    opens = lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])
    return _let(F.filter(F.sequence(F.lit(0), n - 1), opens), cut)


def _segments(blocks: Column) -> Column:
    """array<struct<content, loss>>: marks and texts in order; texts without loss are joined to their marks."""
    segment = lambda content, loss: F.struct(content.alias("content"), F.lit(loss).alias("loss"))

    def of(b: Column) -> Column:
        role = F.concat(F.lit(OPEN), escaped(b["role"]))
        texts = F.transform(b["texts"], lambda t: escaped(t))
        whole = F.concat(role, F.lit(TEXT), F.array_join(texts, TEXT_END + TEXT), F.lit(TEXT_END + CLOSE))
        cut = F.flatten(F.transform(texts, lambda t, i: F.array(segment(F.when(i == 0, F.concat(role, F.lit(TEXT))).otherwise(F.lit(TEXT_END + TEXT)), False), segment(t, True))))
        return F.when(b["role"] == TRAINED, F.concat(cut, F.array(segment(F.lit(TEXT_END + CLOSE), False)))).otherwise(F.array(segment(whole, False)))
    return F.flatten(F.transform(blocks, of))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments: array<struct<content, loss>>) a conversation.  ``rows``: (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    # one expression from the turns to both columns, so nothing is computed twice
    both = _let(_segments(_let(F.col("turns"), _blocks)), lambda s: F.struct(F.array_join(F.transform(s, lambda x: x["content"]), "").alias("formatted"), s.alias("segments")))
    return whole.unionByName(alone).select("conv_id", both.alias("both")).select("conv_id", "both.formatted", "both.segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns read back from a formatted conversation."""
    def of(block: Column) -> Column:
        def turns(p: Column) -> Column:
            role = unescaped(F.substring(p[0], len(OPEN) + 1, 2**31 - 1))
            return F.transform(F.slice(p, 2, F.size(p)), lambda t: F.struct(role.alias("role"), unescaped(F.left(t, F.length(t) - len(TEXT_END))).alias("text")))
        return _let(F.split(block, r"\[INST\]"), turns)
    return F.flatten(F.transform(F.filter(F.split(formatted, CLOSE), lambda b: b != ""), of))


def read_loss(segments: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["content"])), "")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the output."""
    turns = lambda t: F.struct(F.size(t).cast("long").alias("n"), F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("sha"))
    loss = lambda t: F.struct(F.length(t).cast("long").alias("n"), F.sha2(t.cast("binary"), 256).alias("sha"))
    back = formatted.select("conv_id", _let(read_turns(F.col("formatted")), turns).alias("t"), _let(read_loss(F.col("segments")), loss).alias("l"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", F.col("t.n").alias("n_turns"), F.col("t.sha").alias("turns_sha256"), F.col("l.n").alias("loss_chars"), F.col("l.sha").alias("loss_sha256"), "formatted_chars")


def sample(spark: SparkSession, conv_id: int = -1) -> DataFrame:
    """A conversation whose texts are control strings of the template: a user and an assistant row."""
    return spark.range(2).select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
