"""Chat formatting in Spark expressions only.

The rows of a conversation become an array of (turn, role, text) structs, sorted. Adjacent turns of one role share
one header: each turn compares its role with its neighbours' and so knows whether to open a header, to write a
separator, and to close. A formatted conversation is the concatenation of segments:

    <|im_start|>role\\n text [<|im_sep|> text ...] <|im_end|>\\n

Texts and roles are escaped, reversibly: a backslash is doubled and ``<|`` gets one between; in roles a line feed
is written as backslash and n. So no text can hold a control string, and the loss mask can be read off the output:
it covers what stands between the header of an assistant and the end of the turn, but for separators. ``segments``
carries the same mask with the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED = "assistant"
BACKSLASH = "\\"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(BACKSLASH), F.lit(BACKSLASH * 2)), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Back from ``escape`` and ``escape_role``: pairs of backslashes are taken out first, so the others are marks."""
    pieces = F.split(text, r"\\\\", -1)
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.when(F.contains(text, F.lit(BACKSLASH)), F.array_join(plain, BACKSLASH)).otherwise(text)


def format_chat(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: formatted (string), segments (array of (piece, loss)).

    Rows go by turn, null first; rows of the same turn go by role, then text, and repeated rows stay. Null roles
    and texts count as empty; rows with a null conv_id make one conversation. Other columns are not used. An empty
    table gives no rows.
    """
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column, i: Column) -> Column:
        before, after = F.get(F.col("turns"), i - 1)["role"], F.get(F.col("turns"), i + 1)["role"]
        head = F.when(before.eqNullSafe(t["role"]), F.lit(SEPARATOR)).otherwise(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")))
        tail = F.when(after.eqNullSafe(t["role"]), F.lit("")).otherwise(F.lit(END))
        parts = ((head, F.lit(False)), (escape(t["text"]), t["role"] == LEARNED), (tail, F.lit(False)))
        return F.array(*(F.struct(piece.alias("piece"), loss.alias("loss")) for piece, loss in parts))

    out = turns.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select("conv_id", F.array_join(F.col("segments.piece"), "").alias("formatted"), "segments")


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(block, "\n", 2)
        role = unescape(F.substr(F.get(parts, F.lit(0)), F.lit(len(START) + 1)))
        return F.transform(F.split(F.get(parts, F.lit(1)), r"<\|im_sep\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(formatted: Column) -> Column:
    """The texts under the loss mask of a formatted conversation, in order, unescaped."""
    turns = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|im_start\|>" + LEARNED + r"\n(.*?)<\|im_end\|>\n"), F.lit(1))
    return F.transform(F.flatten(F.transform(turns, lambda t: F.split(t, r"<\|im_sep\|>", -1))), unescape)


def chat_report(conversations: DataFrame) -> DataFrame:
    """Read back from the formatted output alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Nulls, repeated rows, ties and other columns as in ``format_chat``.
    """
    written = format_chat(conversations).select("conv_id", "formatted")
    read = written.withColumns({"read": read_chat(F.col("formatted")), "loss_text": F.array_join(loss_texts(F.col("formatted")), "")})
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
