"""Chat formatting: turns of a conversation become one training string with a loss mask.

Template: each run of adjacent turns with one role is `<turn ROLE>` text (`<part>` text)* `</turn>` and a line feed. Texts and
roles are escaped (`\\` to `\\e`, `<` to `\\l`; in roles also `>` to `\\g`), so that a `<` in the output is always markup and the output can be
read back exactly, merged turns included. Only Spark expressions are used.

Cases: a null text is an empty text, a null role an empty role; turns are ordered by (turn, role, text), nulls first, so ties
and repeated rows have one defined order and each row stays a turn; a conversation is one row, and work grows little faster than its turns; rows with a null conv_id form one conversation; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_spans, running
from .shared import let

OPEN, PART, CLOSE = "<turn ", "<part>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    """A role ends at the first `>`, so its own ones are escaped, too (to `\\g`)."""
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def _merge(turns: Column) -> Column:
    """Sorted turns to array<struct<role, parts>>: the runs of equal roles, each with its texts in order."""

    def runs(t: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(t)),
            lambda i: (i == 1) | (F.element_at(t, i)["role"] != F.element_at(t, F.greatest(i - 1, F.lit(1)))["role"]),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, k: F.struct(
                    F.element_at(t, at)["role"].alias("role"),
                    F.transform(
                        F.slice(t, at, F.coalesce(F.get(s, k + 1), F.size(t) + 1) - at), lambda x: x["text"]
                    ).alias("parts"),
                ),
            ),
        )

    return let(turns, runs)


def format_chats(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv_id, formatted (the training string), mask (array of [start, length) in code points that bear loss).

    The mask covers the texts of the assistant's turns as they stand in `formatted`, without any markup.
    """
    turns = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    merged = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turns)).alias("turns"))
    merged = merged.select("conv_id", _merge(F.col("turns")).alias("runs"))
    segment = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss") if isinstance(loss, bool) else loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "runs",
            lambda r: F.concat(
                F.array(segment(F.concat(F.lit(OPEN), escape_role(r["role"]), F.lit(">")), False)),
                F.flatten(
                    F.transform(
                        r["parts"],
                        lambda p, k: F.array(
                            segment(F.when(k > 0, F.lit(PART)).otherwise(F.lit("")), False),
                            segment(escape(p), r["role"] == F.lit(assistant)),
                        ),
                    )
                ),
                F.array(segment(F.lit(CLOSE), False)),
            ),
        )
    )
    out = merged.select("conv_id", segments.alias("segments"))
    size = lambda s: F.length(s["text"])
    placed = lambda ends: F.transform(
        "segments",
        lambda s, i: F.when(
            s["loss"] & (size(s) > 0), F.struct((F.get(ends, i) - size(s)).cast("long").alias("start"), size(s).cast("long").alias("length"))
        ),
    )
    spans = F.filter(let(running(F.transform("segments", size), lambda a, b: a + b), placed), lambda m: m.isNotNull())
    return out.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), spans.alias("mask")
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The turns read back from `formatted` alone: conv_id, mask, formatted, turns array<struct<role, text>>."""
    runs = F.filter(F.split("formatted", CLOSE), lambda x: x != F.lit(""))
    turns = F.flatten(
        F.transform(
            runs,
            lambda run: let(
                F.instr(run, ">"),
                lambda cut: F.transform(
                    F.split(F.substring(run, cut + 1, F.length(run)), PART),
                    lambda text: F.struct(
                        unescape_role(F.substring(run, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"),
                        unescape(text).alias("text"),
                    ),
                ),
            ),
        )
    )
    return formatted.select("conv_id", "formatted", "mask", turns.alias("turns"))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order, with nothing between."""
    spans = F.transform(mask, lambda m: F.struct(m["start"].cast("int").alias("start"), (m["start"] + m["length"]).cast("int").alias("end")))
    return F.array_join(F.transform(cut_spans(formatted, spans), unescape), "")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the formatted text: the columns of query op3."""
    back = parse_chats(format_chats(conversations)).withColumn("loss", loss_text(F.col("formatted"), F.col("mask")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
