"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, neighbours of
the same role are merged into one message by array expressions, and the
messages are concatenated.  Control strings inside roles and texts are escaped,
so the output can be read back exactly (``read_back``, ``segments``).

Template of a message; merged turns stay separable by the join mark:
    <|im_start|>ROLE<|im_sep|>TEXT<|im_join|>TEXT<|im_end|>
Escape: between "<" and "|" (with any backslashes there) one more backslash is
put.  No escaped text holds "<|", and removing one backslash restores it.

A long conversation is formatted in chunks of turns first, and the formatted
chunks are put together, so its raw turns never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, JOIN, END = "<|im_start|>", "<|im_sep|>", "<|im_join|>", "<|im_end|>"
LOSS_ROLE = "assistant"
TURNS_PER_CHUNK = 256


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), escape(role), F.lit(SEP))


def _marked(parts: Column, last: str, first: str, body: str) -> Column:
    """Bodies in order, each after the mark that separates it from the one before."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat(
        F.when(i == 0, F.lit(""))
        .when(F.get(parts, i - 1)[last] == p[first], F.lit(JOIN))
        .otherwise(F.concat(F.lit(END), _head(p[first]))), p[body])), "")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted): one formatted string per conversation.

    Rows are ordered by turn (null first), ties by role and text; repeated rows
    are kept.  A null role or text counts as empty; a null conversation id is a
    conversation of its own; columns beyond the four are ignored.  An empty
    table gives no rows.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.floor(F.col(turn) / F.lit(TURNS_PER_CHUNK)).alias("chunk"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    chunks = (rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("t")).alias("turns"))
              .withColumn("turns", F.transform("turns", lambda t: F.struct(
                  t["role"].alias("role"), escape(t["text"]).alias("body"))))
              .select("conv_id", F.struct(
                  "chunk", F.element_at("turns", 1)["role"].alias("first"),
                  F.element_at("turns", -1)["role"].alias("last"),
                  _marked(F.col("turns"), "role", "role", "body").alias("body")).alias("p")))
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    return whole.select("conv_id", F.concat(
        _head(F.element_at("parts", 1)["first"]), _marked(F.col("parts"), "last", "first", "body"),
        F.lit(END)).alias("formatted"))


def _messages(formatted: Column) -> Column:
    """array<struct<head, bodies>>, still escaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda m: m != "")
    halves = F.transform(pieces, lambda m: F.split(m, r"<\|im_sep\|>", 2))
    return F.transform(halves, lambda h: F.struct(
        h[0].alias("head"), F.split(h[1], r"<\|im_join\|>").alias("bodies")))


def _role(head: Column) -> Column:
    return unescape(F.regexp_replace(head, r"^<\|im_start\|>", ""))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns, from the formatted string alone."""
    roles = F.transform(_messages(formatted), lambda m: F.struct(
        _role(m["head"]).alias("role"), m["bodies"].alias("bodies")))
    return F.flatten(F.transform(roles, lambda m: F.transform(
        m["bodies"], lambda b: F.struct(m["role"].alias("role"), unescape(b).alias("text")))))


def segments(formatted: Column) -> Column:
    """The loss mask as runs: array<struct<chars, loss, text>> that covers the formatted
    string in order; ``loss`` marks assistant texts, ``text`` is the run itself."""
    def run(text: Column, loss: Column) -> Column:
        return F.struct(F.length(text).alias("chars"), loss.alias("loss"), text.alias("text"))

    known = F.transform(_messages(formatted), lambda m: F.struct(
        (_role(m["head"]) == LOSS_ROLE).alias("loss"), m["head"].alias("head"),
        m["bodies"].alias("bodies")))
    return F.flatten(F.transform(known, lambda m: F.concat(
        F.array(run(F.concat(m["head"], F.lit(SEP)), F.lit(False))),
        F.flatten(F.transform(m["bodies"], lambda b, i: F.concat(
            F.when(i > 0, F.array(run(F.lit(JOIN), F.lit(False))))
            .otherwise(F.slice(F.array(run(F.lit(""), F.lit(False))), 1, 0)),
            F.array(run(b, m["loss"]))))),
        F.array(run(F.lit(END), F.lit(False))))))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from (conv_id, formatted), as counts and digests."""
    loss = F.transform(F.filter("mask", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return (formatted.select("conv_id", F.length("formatted").alias("formatted_chars"),
                             read_back(F.col("formatted")).alias("turns"),
                             segments(F.col("formatted")).alias("mask"))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
                        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
                    .alias("turns_sha256"),
                    F.array_join(loss, "").alias("loss_text"),
                    F.col("formatted_chars").cast("long").alias("formatted_chars"))
            .select("conv_id", "n_turns", "turns_sha256",
                    F.length("loss_text").cast("long").alias("loss_chars"),
                    F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars"))
