"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template says how the turn of each role is marked and whether its text is trained on; a machine says which role may
follow which. The result is one text per conversation, as segments with a loss flag. Control strings inside texts are
escaped by a backslash after their first character (one more where backslashes stand there already), so that the
formatted text can be read back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """Marks around a turn, and the loss flag of the text between them."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``other`` holds a turn of any role that ``roles`` lacks; its name stands between ``name_opening`` and
    ``other.opening``."""

    begin: str
    end: str
    roles: Mapping[str, Turn]
    other: Turn
    name_opening: str

    def controls(self) -> list[str]:
        turns = [*self.roles.values(), self.other]
        marks = [self.begin, self.end, self.name_opening, *[t.opening for t in turns], *[t.closing for t in turns]]
        return sorted({m for m in marks if m}, key=lambda m: (-len(m), m))


@dataclass(frozen=True)
class Machine:
    """``moves[state][role]`` is the next state; a role without a move is an error, after which all turns are."""

    start: str
    moves: Mapping[str, Mapping[str, str]]
    accepting: frozenset[str] = field(default_factory=frozenset)


TEMPLATE = Template(
    begin="<s>", end="</s>",
    roles={"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"),
           "assistant": Turn("[OUT]", "[/OUT]", loss=True)},
    other=Turn("[/ROLE]", "[/TURN]"), name_opening="[ROLE]")

MACHINE = Machine(
    start="start",
    moves={"start": {"system": "asked", "user": "user"}, "asked": {"user": "user"},
           "user": {"assistant": "answered"}, "answered": {"user": "user"}},
    accepting=frozenset({"answered"}))


def _sites(template: Template, behind: str) -> str:
    """Pattern of the place after a control string's first character, where ``behind`` may stand before the rest."""
    by_first: dict[str, list[str]] = {}
    for mark in template.controls():
        by_first.setdefault(mark[0], []).append(re.escape(mark[1:]))
    slash = re.escape(ESCAPE)
    return "|".join(f"(?<={re.escape(c)}){behind}(?={slash}*(?:{'|'.join(rest)}))" for c, rest in sorted(by_first.items()))


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, _sites(template, ""), ESCAPE * 2)


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, _sites(template, re.escape(ESCAPE)), "")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _turn_segments(turn: Column, template: Template) -> Column:
    role, text = turn["role"], escape(turn["text"], template)
    no = F.lit(False)
    out = F.array(_segment(F.lit(template.name_opening), no), _segment(escape(role, template), no),
                  _segment(F.lit(template.other.opening), no), _segment(text, F.lit(template.other.loss)),
                  _segment(F.lit(template.other.closing), no))
    for name, t in template.roles.items():
        own = F.array(_segment(F.lit(t.opening), no), _segment(text, F.lit(t.loss)), _segment(F.lit(t.closing), no))
        out = F.when(role == name, own).otherwise(out)
    return out


def _first_error(roles: Column, machine: Machine) -> Column:
    """Position of the first turn without a move, the number of turns if they end in no accepting state, or null."""
    states = sorted({machine.start, *machine.moves, *[s for m in machine.moves.values() for s in m.values()]})
    number = {s: i for i, s in enumerate(states)}

    def step(acc: Column, role: Column) -> Column:
        after = F.lit(-1)
        for state, moves in machine.moves.items():
            for r, target in moves.items():
                after = F.when((acc["state"] == number[state]) & (role == r), number[target]).otherwise(after)
        return F.struct(after.alias("state"), (acc["at"] + (after >= 0).cast("int")).alias("at"))

    start = F.struct(F.lit(number[machine.start]).alias("state"), F.lit(0).alias("at"))
    accepted = [number[s] for s in sorted(machine.accepting)]
    return F.aggregate(roles, start, step, lambda acc: F.when(~acc["state"].isin(accepted), acc["at"]))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", template: Template = TEMPLATE, machine: Machine = MACHINE) -> DataFrame:
    """One row per conversation: the key, ``n_turns``, ``segments`` (array of text and loss), ``formatted`` (their
    concatenation), ``valid`` and ``error_at``.

    Turns stand in the order of (turn, role, text), nulls first; a repeated row is a turn of its own. Null text and
    null role count as empty, and an unknown or empty role gets the marks of ``template.other``. Every conversation is
    formatted; ``valid`` is false if the machine has no move for a turn (``error_at`` is its position from 0) or the
    turns end before an accepting state (``error_at`` is their number). A null key is one conversation. Other columns
    are not read. An empty table gives none.

    One shuffle on the key; a conversation is one row in any case, since its formatted text is one value.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    turns = df.groupBy(F.col(f"`{conv_col}`").alias(conv_col)).agg(F.sort_array(F.collect_list(turn)).alias("__turns"))
    marks = lambda m: F.array(_segment(F.lit(m), F.lit(False)))
    body = F.flatten(F.transform("__turns", lambda t: _turn_segments(t, template)))
    out = turns.select(
        conv_col, F.size("__turns").cast("long").alias("n_turns"),
        F.concat(marks(template.begin), body, marks(template.end)).alias("segments"),
        _first_error(F.transform("__turns", lambda t: t["role"]), machine).alias("error_at"))
    return out.select(conv_col, "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "")
                      .alias("formatted"), F.col("error_at").isNull().alias("valid"), "error_at")


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (array of role and text) that a formatted text was made of."""
    turns = [*template.roles.values(), template.other]
    closing = "|".join(re.escape(m) for m in sorted({t.closing for t in turns}, key=len, reverse=True))
    body = F.substring(formatted, F.lit(len(template.begin) + 1),
                       F.length(formatted) - len(template.begin) - len(template.end))
    pieces = F.filter(F.split(body, closing, -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        name_at, text_at = len(template.name_opening) + 1, F.instr(piece, template.other.opening)
        role = unescape(F.substring(piece, F.lit(name_at), text_at - name_at), template)
        text = F.substring(piece, text_at + len(template.other.opening), F.length(piece))
        for name, t in template.roles.items():
            own = F.startswith(piece, F.lit(t.opening))
            role = F.when(own, name).otherwise(role)
            text = F.when(own, F.substring(piece, F.lit(len(t.opening) + 1), F.length(piece))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
