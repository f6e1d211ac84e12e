"""Chat formatting from a declarative template, with a finite-state machine over roles.

A template is data: marks around a turn, which roles are learnt from, and which role may
follow which. A conversation becomes a list of segments (text, loss flag); their texts joined
are the formatted conversation. Control strings inside roles and texts are escaped, so the
output reads back exactly. Everything is column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, learnt roles and the machine: state (last role; "" at the start) to the roles
    that may come next. The conversation may end in a state of ``final``."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    learnt: tuple[str, ...] = ("assistant",)
    follow: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    })
    final: tuple[str, ...] = ("user", "assistant")


def escaped(text: Column) -> Column:
    """One backslash more in every "<", backslashes, "|": no mark can occur in the result."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _role_escaped(role: Column) -> Column:
    """A role on one line: backslashes doubled, line ends spelt out, marks escaped."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_unescaped(role: Column) -> Column:
    """Reads the pairs left to right: a mark that no text can hold stands for a backslash."""
    halves = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(halves, lambda h: F.replace(h, F.lit("\\n"), F.lit("\n"))), "\\")


def formatted(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, segments, formatted, n_turns, valid, wrong_turn), one row a conversation.

    rows(conv_id, turn, role, text); turns go by number, nulls first, ties by role and text.
    Null roles and texts count as empty; a null conv_id is one conversation. ``wrong_turn``
    is the place of the first role the machine does not allow (null if none), ``valid``
    also asks for a final state. A conversation is one row of the result, digests of the
    whole are asked for, so it is gathered whole: its texts must fit one string (2 GB).
    """
    t = template or Template()
    row = F.struct(
        "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    allowed = F.create_map(*[x for a, bs in t.follow.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in bs]).cast("array<string>"))])
    roles = F.transform("turns", lambda x: x["role"])

    def wrong(role: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(roles, i - 1)).otherwise(F.lit(""))
        return F.when(F.coalesce(F.array_contains(F.element_at(allowed, before), role), F.lit(False)), F.lit(None)).otherwise(i)

    def parts(x: Column) -> Column:
        text = escaped(x["text"])
        return F.array(
            F.struct(F.concat(F.lit(t.start), _role_escaped(x["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(text.alias("text"), x["role"].isin(*t.learnt).alias("loss")),
            F.struct(F.lit(t.end + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    wrong_turn = F.array_min(F.transform(roles, wrong))
    return (
        gathered.select(
            "conv_id", F.flatten(F.transform("turns", parts)).alias("segments"), F.size("turns").cast("long").alias("n_turns"),
            wrong_turn.cast("long").alias("wrong_turn"), F.element_at(roles, -1).isin(*t.final).alias("_ends"),
        )
        .select(
            "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "n_turns",
            (F.col("wrong_turn").isNull() & F.col("_ends")).alias("valid"), "wrong_turn",
        )
    )


def read_back(formatted_text: Column, template: Template | None = None) -> Column:
    """Array of (role, text) of a formatted conversation."""
    t = template or Template()
    pieces = F.split(formatted_text, "\\Q" + t.end + "\n\\E", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(piece: Column) -> Column:
        line = F.substring_index(piece, "\n", 1)
        role = F.substring(line, F.lit(len(t.start) + 1), F.char_length(line))
        return F.struct(
            _role_unescaped(role).alias("role"),
            unescaped(F.substring(piece, F.char_length(line) + 2, F.char_length(piece))).alias("text"),
        )

    return F.transform(turns, one)


def learnt_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped segment by segment."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
