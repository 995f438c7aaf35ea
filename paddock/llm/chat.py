"""Operator 5: chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: the turns before it are context and its reply alone is trainable. A
conversation that does not end in an assistant turn also gives a closing example without a target, so that no turn is lost.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every ``<``, backslashes, ``|`` gets one
backslash more, so control strings cannot occur there and one backslash less restores them; a role's line feeds and
backslashes are written ``\\n`` and ``\\\\``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    parts = F.split(unescape(c), r"\\\\", -1)  # between written backslashes
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, example, n_turns, formatted, loss_start, loss_length, last``: the examples of each conversation.

    ``loss_start`` (from 0) and ``loss_length`` count code points of ``formatted``; a closing example has length 0.
    ``last`` marks the one example that holds all turns. One shuffle, by conversation; the examples are made where the
    turns have met. An example holds its conversation up to its target, as the format asks, so rows are as long as
    conversations are, whatever their number.

    Null roles and texts count as empty; a null conversation id is a conversation of its own; turns are ordered by turn,
    then role, then text, so ties and repeated rows have one order; a null turn comes first; an empty table gives an
    empty result; other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).alias("__conv"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("__turn"))
    talks = rows.groupBy("__conv").agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))
    written = F.transform("__turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END)))
    lengths = F.transform("__turns", lambda t: F.length(escape(t["text"])))
    ends = F.filter(F.sequence(F.lit(1), F.size("__turns")), lambda k: (F.element_at("__turns", k)["role"] == "assistant") | (k == F.size("__turns")))
    spread = talks.select("__conv", "__turns", written.alias("__written"), lengths.alias("__lengths"), F.posexplode(ends).alias("example", "__end"))
    target = F.element_at("__turns", F.col("__end"))["role"] == "assistant"
    formatted = F.array_join(F.slice("__written", F.lit(1), F.col("__end")), "")
    loss = F.when(target, F.element_at("__lengths", F.col("__end"))).otherwise(0)
    return spread.select(
        F.col("__conv").alias(conv_col),
        "example",
        F.col("__end").cast("long").alias("n_turns"),
        formatted.alias("formatted"),
        (F.length(formatted) - F.length(F.lit(END)) - loss).cast("long").alias("loss_start"),
        loss.cast("long").alias("loss_length"),
        (F.col("__end") == F.size("__turns")).alias("last"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example: array of struct (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")

    def read(p: Column) -> Column:
        body = F.substr(p, F.lit(len(START) + 1))
        at = F.instr(body, F.lit("\n"))
        return F.struct(unescape_role(F.substr(body, F.lit(1), at - 1)).alias("role"), unescape(F.substr(body, at + 1)).alias("text"))

    return F.transform(parts, read)


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), length.cast("int")))


def digest(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What a conversation's examples say when read back: turns, loss text and lengths, with SHA-256 digests.

    The examples of ``expand`` lie by conversation already, so nothing is shuffled again.
    """
    told = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        conv_col,
        "example",
        F.col("n_turns"),
        F.length("formatted").cast("long").alias("__chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("__loss"),
        F.when(F.col("last"), F.sha2(F.encode(told, "UTF-8"), 256)).alias("__told"),
    )
    losses = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "__loss"))), lambda x: x["__loss"]), "")
    grouped = read.groupBy(conv_col).agg(
        F.max("n_turns").alias("n_turns"), F.max("__told").alias("turns_sha256"), losses.alias("__losses"), F.sum("__chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples")
    )
    return grouped.select(
        conv_col, "n_turns", "turns_sha256", F.length("__losses").cast("long").alias("loss_chars"), F.sha2(F.encode("__losses", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", "n_examples"
    )
