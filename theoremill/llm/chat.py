"""Chat formatting with DataFrame functions only.

A declarative template says how a turn is wrapped, which roles may follow which, and whose text carries loss. A
finite-state machine over the roles (a fold over the ordered turns) validates the order; each turn yields segments of
text with a loss flag; control strings inside texts are escaped reversibly, so the formatted text can be parsed back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class ChatTemplate:
    """Every control string begins with `<|`; escaping makes sure that no text contains that pair."""

    turn_open: str = "<|im_start|>"
    role_end: str = "<|sep|>\n"
    turn_close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; the state after a turn is its role.
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    """Double every backslash, then part `<|` by a single one: reversible, and `<|` no longer occurs."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _moves(template: ChatTemplate) -> Column:
    return F.array(*(F.lit(f"{a}>{b}") for a, after in template.transitions.items() for b in after))


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments, formatted, valid, bad_turn.

    turns: conv_id, turn, role, text; other columns are ignored. Null text or role: empty. Order: by turn (nulls
    first), ties by role, then text; repeated rows are repeated turns. segments: array of (text, loss) whose texts
    joined are `formatted`; loss marks the escaped text of turns whose role carries loss. valid: the machine accepts
    the roles; bad_turn: 0-based position of the first turn it refuses (null if none). Invalid conversations are
    formatted as well; it is the caller's choice to drop them. The rows of one conversation meet in one row because
    the output is one string per conversation; map-side collection does the escaping before the exchange.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    carries = lambda t: t["role"].isin(*template.loss_roles)
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.turn_open), escape(t["role"]), F.lit(template.role_end)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), carries(t).alias("loss")),
                F.struct(F.lit(template.turn_close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    moves, begin = _moves(template), F.struct(F.lit(START).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    step = lambda acc, t: F.struct(
        t["role"].alias("state"),
        (acc["at"] + 1).alias("at"),
        F.when(acc["bad"].isNull() & ~F.array_contains(moves, F.concat(acc["state"], F.lit(">"), t["role"])), acc["at"]).otherwise(acc["bad"]).alias("bad"),
    )
    run = F.aggregate("turns", begin, step)
    return (
        grouped.withColumns({"segments": pieces, "machine": run})
        .withColumns({"formatted": F.array_join(F.transform("segments", lambda s: s["text"]), ""), "n_turns": F.size("turns").cast("long")})
        .select(
            "conv_id",
            "n_turns",
            "segments",
            "formatted",
            (F.col("machine.bad").isNull() & F.col("machine.state").isin(*template.final)).alias("valid"),
            F.col("machine.bad").alias("bad_turn"),
        )
    )


def parse_formatted(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns in a formatted text as array<struct<role, text>>, unescaped.

    Null: null; a text without a turn: an empty array. Roles and texts may be empty, of any length, and hold any control
    string, as these are escaped; turns come in order, repeated ones repeated.
    """
    quoted = lambda s: "\\Q" + s + "\\E"
    blocks = F.slice(F.split(formatted, quoted(template.turn_open), -1), F.lit(2), F.greatest(F.lit(0), F.size(F.split(formatted, quoted(template.turn_open), -1)) - 1))
    body = lambda b: F.substring(b, F.lit(1), F.length(b) - len(template.turn_close))
    split_at = lambda b: F.instr(b, template.role_end)
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.substring(body(b), F.lit(1), split_at(b) - 1)).alias("role"),
            unescape(F.substring(body(b), split_at(b) + len(template.role_end), F.length(b))).alias("text"),
        ),
    )
