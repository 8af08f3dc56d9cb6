"""Chat formatting with DataFrame functions only: a declarative template, a role automaton, loss flags, and back.

A template names the marks around each role's text and the roles that carry loss. Control strings inside texts are
escaped reversibly, so the marks can be read back from the formatted string. The order of turns is judged by a
finite-state machine over roles, folded over the turns of a conversation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"  # in texts: "\" becomes "\0", a control string's first character c becomes "\1"
START, ERROR = "start", "error"


@dataclass(frozen=True)
class Template:
    """Marks by role as (before, after); ``other`` serves roles without marks, with {role} for the escaped name.

    Every mark before a text must start with "<" or "[" and hold no backslash; ``transitions`` maps (state, role) to
    the next state, a missing entry is an error; ``final`` are the states in which a conversation may end.
    """

    marks: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>\n", "\n<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")})
    other: tuple = ("<|role:{role}|>", "<|end|>")
    loss_roles: tuple = ("assistant",)
    control: tuple = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|role:", "|>", "<|end|>")
    transitions: dict = field(default_factory=lambda: {
        (START, "system"): "system", (START, "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple = ("assistant",)

    def heads(self) -> list[str]:
        """Distinct control strings by falling length, so that no string hides a longer one."""
        return sorted(set(self.control), key=lambda c: (-len(c), c))


def escape(text: Column, t: Template) -> Column:
    """Text in which no control string of the template occurs; :func:`unescape` gives the text back."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for c, k in _codes(t).items():
        for string in (x for x in t.heads() if x[0] == c):
            out = F.replace(out, F.lit(string), F.lit(ESCAPE + k + string[1:]))
    return out


def unescape(text: Column, t: Template) -> Column:
    out = text
    for c, k in _codes(t).items():
        out = F.replace(out, F.lit(ESCAPE + k), F.lit(c))
    return F.replace(out, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _codes(t: Template) -> dict:
    """A one-digit code for each first character of a control string."""
    return {c: str(i + 1) for i, c in enumerate(sorted({s[0] for s in t.control}))}


def _marks(role: Column, t: Template) -> tuple[Column, Column]:
    before, after = t.other[0].split("{role}")
    opened = F.concat(F.lit(before), escape(role, t), F.lit(after))
    closed = F.lit(t.other[1])
    for name, (b, a) in t.marks.items():
        opened = F.when(role == name, F.lit(b)).otherwise(opened)
        closed = F.when(role == name, F.lit(a)).otherwise(closed)
    return opened, closed


def _machine(roles: Column, t: Template) -> Column:
    """The state after all turns, or ``error``."""
    def step(state: Column, role: Column) -> Column:
        return reduce(lambda rest, x: F.when((state == x[0][0]) & (role == x[0][1]), F.lit(x[1])).otherwise(rest),
                      t.transitions.items(), F.lit(ERROR))

    return F.aggregate(roles, F.lit(START), step)


def format_chats(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: the id column, formatted (string), segments (array of text and loss), valid.

    Turns are ordered by turn number, then role, then text; a null number comes first, a null role or text counts as
    empty, a null conversation id is a conversation of its own. Repeated rows are repeated turns. A turn gives three
    segments: mark, escaped text, mark; only the text of a loss role has loss. ``valid`` says whether the automaton
    accepts the roles; conversations that it rejects are formatted all the same. A conversation is one row by
    definition, so its turns meet in one task. An empty table gives an empty result.
    """
    t = template or Template()
    rows = turns.select(
        turns[conv_col].alias("conv"), turns[turn_col].alias("n"),
        F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text"))
    opened, closed = _marks(F.col("role"), t)
    loss = F.col("role").isin(list(t.loss_roles))
    turn = F.struct("n", "role", "text", opened.alias("opened"), escape(F.col("text"), t).alias("body"),
                    closed.alias("closed"), loss.alias("loss"))
    talks = rows.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    part = lambda x, flag: F.struct(x.alias("text"), flag.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        part(x.opened, F.lit(False)), part(x.body, x.loss), part(x.closed, F.lit(False)))))
    state = _machine(F.transform("turns", lambda x: x.role), t)
    return talks.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("turns", lambda x: F.concat(x.opened, x.body, x.closed)), "").alias("formatted"),
        segments.alias("segments"), state.isin(list(t.final)).alias("valid"))


def parse_chats(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation, read back: array of role, text and loss."""
    t = template or Template()
    before, after = t.other[0].split("{role}")
    named = [f"{re.escape(b)}(.*?){re.escape(a)}" for b, a in t.marks.values()]
    pattern = "(?s)(?:" + "|".join([*named, f"{re.escape(before)}(.*?){re.escape(after)}(.*?){re.escape(t.other[1])}"]) + ")"

    def one(piece: Column) -> Column:
        k = len(t.marks)
        role = unescape(F.regexp_extract(piece, pattern, k + 1), t)
        body = F.regexp_extract(piece, pattern, k + 2)
        loss = role.isin(list(t.loss_roles))
        for i, (name, (b, a)) in enumerate(t.marks.items()):
            is_it = piece.startswith(b)
            role = F.when(is_it, F.lit(name)).otherwise(role)
            body = F.when(is_it, F.regexp_extract(piece, pattern, i + 1)).otherwise(body)
            loss = F.when(is_it, F.lit(name in t.loss_roles)).otherwise(loss)
        return F.struct(role.alias("role"), unescape(body, t).alias("text"), loss.alias("loss"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), one)
