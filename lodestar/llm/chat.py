"""Chat formatting from a declarative template.

A template gives each role an opening and a closing mark and says whether the model
learns its text. A finite-state machine over roles, declared beside it, checks turn
order. The result is one string a conversation and the segments it is made of, each
with its loss flag. Control strings cannot arise from texts: every character that
starts a mark, and the escape sign, is written as a two-character code that holds no
such character, so a mark's first character in the output is always a mark's. The
codes are undone by plain replacement.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, for any other role, and the turn order.

    ``turns`` maps a state to the roles that may follow; a state is the role last
    seen, at first ``start``. ``ends`` are the states a conversation may stop in.
    ``codes`` maps each first character of a mark, and the escape sign last, to the
    letter that follows the sign.
    """

    head: str = "<s>"
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>\n", "\n<</SYS>>\n\n"),
            "user": Role("[INST] ", " [/INST] "),
            "assistant": Role("[OUT] ", "</s>", loss=True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE] ", "[TEXT] ", "[/TEXT] ")
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    codes: dict[str, str] = field(default_factory=lambda: {"<": "l", "[": "b", "\\": "s"})

    @property
    def sign(self) -> str:
        return list(self.codes)[-1]


def escape(text: Column, t: Template) -> Column:
    for ch, code in reversed(list(t.codes.items())):
        text = F.replace(text, F.lit(ch), F.lit(t.sign + code))
    return text


def unescape(text: Column, t: Template) -> Column:
    for ch, code in t.codes.items():
        text = F.replace(text, F.lit(t.sign + code), F.lit(ch))
    return text


def _segments(turn: Column, t: Template) -> Column:
    """The segments of one turn, as an array of (text, loss)."""

    def piece(text: Column, loss: bool = False) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    body = escape(turn["text"], t)
    a, b, c = t.other
    out = F.array(piece(F.concat(F.lit(a), escape(turn["role"], t), F.lit(b))), piece(body), piece(F.lit(c)))
    for name, r in t.roles.items():
        out = F.when(turn["role"] == name, F.array(piece(F.lit(r.opening)), piece(body, r.loss), piece(F.lit(r.closing)))).otherwise(out)
    return out


def _check(turns: Column, t: Template) -> Column:
    """(state, number of the first turn out of order or -1) after all turns."""
    allowed = F.array(*[F.lit(f"{state}\n{role}") for state, roles in t.turns.items() for role in roles])
    first = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        good = F.array_contains(allowed, F.concat(acc["state"], F.lit("\n"), turn["role"]))
        bad = F.when((acc["bad"] < 0) & ~good, acc["at"]).otherwise(acc["bad"])
        return F.struct(turn["role"].alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    return F.aggregate(turns, first, step)


def format_chats(rows: DataFrame, t: Template = Template()) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, ordered, bad_turn, text, segments.

    ``rows`` needs conv_id, turn, role and text; other columns, whatever their names,
    are not read. Turns go by turn, then role and text, nulls first; repeated rows are
    turns of their own. A null role or text is an empty one; a role without marks of
    its own gets the template's general ones. Rows whose conv_id is null are one
    conversation. ``ordered`` says whether the state machine accepts the turns and
    their end, ``bad_turn`` which turn (from 0) it refuses first, -1 if none; nothing
    is dropped. A conversation is one value of the output, so it is put together in one
    task, of whatever length. An empty table gives an empty table.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = F.flatten(F.transform("turns", lambda x: _segments(x, t)))
    head = F.array(F.struct(F.lit(t.head).alias("text"), F.lit(False).alias("loss")))
    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _check(F.col("turns"), t).alias("end"), F.concat(head, parts).alias("segments"))
    return out.select(
        "conv_id",
        "n_turns",
        ((F.col("end.bad") < 0) & F.col("end.state").isin(*t.ends)).alias("ordered"),
        F.col("end.bad").alias("bad_turn"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"),
        "segments",
    )


def read_turns(text: Column, t: Template = Template()) -> Column:
    """(role, text) of each turn, read from a formatted string alone."""
    marks = "".join(re.escape(c) for c in list(t.codes)[:-1])
    plain = f"[^{marks}]*"
    q = re.escape
    forms = [q(r.opening) + plain + q(r.closing) for r in t.roles.values()] + [q(t.other[0]) + plain + q(t.other[1]) + plain + q(t.other[2])]
    found = F.regexp_extract_all(text, F.lit("|".join(forms)), F.lit(0))

    def turn(x: Column) -> Column:
        a, b, c = t.other
        cut = F.instr(x, b)
        role = F.substring(x, F.lit(len(a) + 1), cut - len(a) - 1)
        body = F.substring(x, cut + len(b), F.length(x) - cut - len(b) - len(c) + 1)
        out = F.struct(unescape(role, t).alias("role"), unescape(body, t).alias("text"))
        for name, r in t.roles.items():
            body = F.substring(x, F.lit(len(r.opening) + 1), F.length(x) - len(r.opening) - len(r.closing))
            out = F.when(F.startswith(x, F.lit(r.opening)), F.struct(F.lit(name).alias("role"), unescape(body, t).alias("text"))).otherwise(out)
        return out

    return F.transform(found, turn)


def read_loss(segments: Column, t: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
