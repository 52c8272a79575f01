"""Chat formatting: a role automaton and a declarative template, in DataFrame functions only.

Rows of one conversation are put in order of turn (nulls first), then role, then
text. Every turn becomes three segments, head, body and tail; only a body can
carry loss. Control strings inside texts (and role names) are escaped:

    backslash -> backslash e,   control string number k -> backslash and letter k

An escaped text holds no control string and can be turned back exactly.

Cases: null text is empty text; a null role counts as an empty role name; roles
outside the template are written with a generic head that holds the name, and
make the order invalid; rows with a null conv_id form one conversation of their
own; an empty table gives no rows; repeated rows are kept as repeated turns;
other columns of the table are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import column_or_null


@dataclass(frozen=True)
class Template:
    """Markup by role: text before and after the body, and whether the body carries loss.

    Every tail ends with `end`, which occurs nowhere else.
    """

    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>></s>", False),
            "user": ("[INST] ", " [/INST]</s>", False),
            "assistant": ("<s> ", " </s>", True),
        }
    )
    other: tuple[str, str, str] = ("<role>", "</role>", "</s>")
    end: str = "</s>"
    controls: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<role>", "</role>")
    #: state -> role -> next state; a missing entry is an error. State 0 begins.
    turns: dict[int, dict[str, int]] = field(
        default_factory=lambda: {0: {"system": 1, "user": 2}, 1: {"user": 2}, 2: {"assistant": 3}, 3: {"user": 2}}
    )
    final: tuple[int, ...] = (3,)

    def letter(self, k: int) -> str:
        return "\\" + "abcdfghijklmnopqrstuvwxyz"[k]


LLAMA_LIKE = Template()


def escape(text: Column, template: Template = LLAMA_LIKE) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for k, mark in enumerate(template.controls):
        out = F.replace(out, F.lit(mark), F.lit(template.letter(k)))
    return out


def unescape(text: Column, template: Template = LLAMA_LIKE) -> Column:
    out = text
    for k, mark in enumerate(template.controls):
        out = F.replace(out, F.lit(template.letter(k)), F.lit(mark))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def _segments(turn: Column, template: Template) -> Column:
    def three(head: Column, tail: str, loss: bool) -> Column:
        piece = lambda text, flag: F.struct(text.alias("text"), F.lit(flag).alias("loss"))
        return F.array(piece(head, False), piece(escape(turn["text"], template), loss), piece(F.lit(tail), False))

    before, after, tail = template.other
    out = three(F.concat(F.lit(before), escape(turn["role"], template), F.lit(after)), tail, False)
    for role, (head, end, loss) in template.roles.items():
        out = F.when(turn["role"] == role, three(F.lit(head), end, loss)).otherwise(out)
    return out


def _next_state(state: Column, turn: Column, template: Template) -> Column:
    """state: struct(at, seen, bad); bad is the first turn that breaks the order, or -1."""
    at = F.lit(-1)
    for start, moves in template.turns.items():
        for role, to in moves.items():
            at = F.when((state["at"] == start) & (turn["role"] == role), F.lit(to)).otherwise(at)
    bad = F.when((state["bad"] < 0) & (at < 0), state["seen"]).otherwise(state["bad"])
    return F.struct(at.alias("at"), (state["seen"] + 1).alias("seen"), bad.alias("bad"))


def format_conversations(rows: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """One row per conversation: conv_id, segments [(text, loss)], formatted, valid, first_bad_turn.

    A conversation is one output row by nature, so its turns meet in one task;
    its own length bounds that row, as in any chat corpus.
    """
    turn = F.struct(
        column_or_null(rows, "turn", "long").alias("turn"),
        F.coalesce(column_or_null(rows, "role", "string"), F.lit("")).alias("role"),
        F.coalesce(column_or_null(rows, "text", "string"), F.lit("")).alias("text"),
    )
    turns = rows.select(column_or_null(rows, "conv_id", "long").alias("conv_id"), turn.alias("one"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("seen"), F.lit(-1).alias("bad"))
    state = F.aggregate("turns", begin, lambda s, t: _next_state(s, t, template))
    return (
        whole.withColumn("state", state)
        .withColumn("segments", F.flatten(F.transform("turns", lambda t: _segments(t, template))))
        .select(
            "conv_id",
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            ((F.col("state.bad") < 0) & F.col("state.at").isin(*template.final)).alias("valid"),
            F.when(F.col("state.bad") >= 0, F.col("state.bad").cast("long")).alias("first_bad_turn"),
        )
    )


def parse_formatted(formatted: Column, template: Template = LLAMA_LIKE) -> Column:
    """Array of (role, text) read back from formatted text."""
    pieces = F.split(formatted, f"\\Q{template.end}\\E")

    def inner(piece: Column, head: Column | int, tail: str) -> Column:
        return F.substring(piece, head + 1, F.length(piece) - head - len(tail))

    def one(piece: Column) -> Column:
        before, after, tail = template.other
        name = F.substring_index(F.substring(piece, len(before) + 1, 1 << 30), after, 1)
        rest = F.length(name) + len(before) + len(after)
        out = F.struct(unescape(name, template).alias("role"), unescape(inner(piece, rest, ""), template).alias("text"))
        for role, (head, end, _) in template.roles.items():
            body = unescape(inner(piece, F.lit(len(head)), end.removesuffix(template.end)), template)
            out = F.when(piece.startswith(head), F.struct(F.lit(role).alias("role"), body.alias("text"))).otherwise(out)
        return out

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), one)


def formatted_digest(rows: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """Digest columns read back from the formatted text and its loss segments."""
    made = format_conversations(rows, template)
    turns = parse_formatted(F.col("formatted"), template)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    read = made.select("conv_id", "formatted", "valid", "first_bad_turn", turns.alias("turns"), loss.alias("loss_text"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_bad_turn",
    )
