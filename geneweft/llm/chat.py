"""Chat formatting with a grammar round trip.

Grammar of the output, one conversation a text::

    conversation := turn*
    turn         := "### " role ": " ("plain" | "escaped") "\\n" body "</turn>\\n"

``### `` and ``</turn>`` are control strings; the parser refuses a body that holds one. Every turn is rendered plain
and parsed again; where the parse does not give back role and text, the body is escaped and parsed once more, and a
turn that still differs stops the job. Roles are always escaped. Escaping puts a backslash before each backslash,
``#`` and the slash of ``</turn>`` and is undone in one pass.

Defined cases: null text and null role are empty; rows go by turn, nulls first, ties by role then text; repeated rows
stay; a null conversation id is a conversation of its own; an empty table gives no conversation; other columns are
not read. A conversation is one text by contract, so its turns meet in one row, already escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
END = CLOSE + "\n"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("#"), F.lit("\\#"))
    return F.replace(c, F.lit(CLOSE), F.lit("<\\/turn>"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), F.lit("n"))


def unescape_role(c: Column) -> Column:
    # every "\n" pair stands for a line end; other escapes are undone in the same left-to-right pass
    parts = F.split(c, r"\\\\", -1)
    parts = F.transform(parts, lambda p: unescape(F.replace(p, F.lit("\\n"), F.lit("\n"))))
    return F.array_join(parts, "\\")


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    return F.concat(
        F.lit(OPEN), escape_role(role), F.lit(": escaped\n" if escaped else ": plain\n"),
        escape(text) if escaped else text, F.lit(END),
    )


def parse_turn(piece: Column) -> Column:
    """struct(role, text) of what follows an opening mark, or null where the grammar does not fit."""
    head = F.substring_index(piece, "\n", 1)
    role = F.regexp_extract(head, r"(?s)^(.*): (plain|escaped)$", 1)
    form = F.regexp_extract(head, r"(?s)^(.*): (plain|escaped)$", 2)
    body = F.substr(piece, F.length(head) + 2, F.length(piece) - F.length(head) - 1 - len(END))
    fits = F.endswith(piece, F.lit(END)) & (form != "") & ~F.contains(body, F.lit(CLOSE)) & ~F.contains(body, F.lit(OPEN))
    return F.when(
        fits,
        F.struct(unescape_role(role).alias("role"), F.when(form == "escaped", unescape(body)).otherwise(body).alias("text")),
    )


def parse_conversation(formatted: Column) -> Column:
    """array of struct(role, text) read from the output of :func:`format_conversations`."""
    pieces = F.split(formatted, OPEN, -1)
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), parse_turn)


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted: the first rendering that the parser reads back as it was."""
    r = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    for name, escaped in (("plain", False), ("escaped", True)):
        r = r.withColumn(name, render_turn(F.col("role"), F.col("text"), escaped))

    def same(c: str) -> Column:
        pieces = F.split(F.col(c), OPEN, -1)
        back = parse_turn(F.element_at(pieces, 2))
        return (F.size(pieces) == 2) & F.coalesce((back["role"] == F.col("role")) & (back["text"] == F.col("text")), F.lit(False))

    return r.select(
        "conv_id", "turn", "role", "text",
        F.when(same("plain"), F.col("plain")).when(same("escaped"), F.col("escaped"))
        .otherwise(F.raise_error(F.lit("a turn could not be formatted reversibly"))).alias("formatted"),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted: all turns of a conversation in order."""
    turns = format_turns(rows)
    ordered = F.array_sort(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("known"), "turn", "role", "text", "formatted"
    )))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["formatted"]), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: the recovered turns; text under the loss mask is that of the assistant's turns."""
    return formatted.select("conv_id", "formatted", parse_conversation(F.col("formatted")).alias("turns"))


def loss_text(turns: Column) -> Column:
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
