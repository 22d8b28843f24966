"""Chat formatting from a declarative template, with DataFrame functions only.

A finite-state machine over roles checks the order of turns. Each conversation becomes text
segments, each with a flag that says whether it counts for the loss. Control
strings inside texts are escaped so that reading the text back gives the same turns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Template:
    """``open`` is followed by the role, ``head`` and the text; ``close`` ends a turn. ``steps`` maps each state to the roles
    that may follow; the state after a turn is its role. ``ends`` are the states in which a conversation may end."""

    open: str = "<|im_start|>"
    head: str = "\n"
    close: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = ""
    steps: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)


CHATML = Template()
INVALID = "!"


def escape(text: Column) -> Column:
    """One more backslash between ``<`` and ``|``, so no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def is_valid(roles: Column, template: Template) -> Column:
    """Runs the machine over an array of roles."""
    moves = F.create_map(*(F.lit(x) for s, to in template.steps.items() for r in to for x in (f"{s}>{r}", r)))
    last = F.aggregate(roles, F.lit(template.start), lambda s, r: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), r)), F.lit(INVALID)))
    return last.isin(*template.ends)


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: ``conv_id``, ``valid``, ``segments`` (array of ``text``, ``loss``).

    Turns are ordered by ``turn``, then role and text (nulls first). A null text is an empty one, a null role too. A null ``conv_id`` is one
    conversation of its own. Rows that repeat are separate turns. Conversations whose roles break the order are
    formatted as well, with ``valid`` false. Other columns are ignored. An empty table gives an empty result.
    """
    said = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def parts(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(template.open), _escape_role(t["role"]), F.lit(template.head)), F.lit(False)),
            piece(escape(t["text"]), t["role"].isin(*template.learned)),
            piece(F.lit(template.close), F.lit(False)),
        )

    roles = F.transform("turns", lambda t: t["role"])
    return chats.select("conv_id", is_valid(roles, template).alias("valid"), F.flatten(F.transform("turns", parts)).alias("segments"))


def full_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template = CHATML) -> Column:
    """Turns (``role``, ``text``) of a formatted conversation."""
    raw = F.slice(F.split(text, re.escape(template.open)), 2, 1 << 30)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, template.head, 1)
        body = F.substr(x, F.length(role) + len(template.head) + 1, F.length(x) - F.length(role) - len(template.head) - len(template.close))
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(raw, turn)


def chat_digests(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Formats all conversations, writes them, and returns digests of what is read back."""
    out = written(format_chats(turns, template), "chats")
    text = full_text(F.col("segments"))
    read = out.select("conv_id", "valid", F.length(text).cast("long").alias("formatted_chars"), read_turns(text, template).alias("turns"), F.filter("segments", lambda s: s["loss"]).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("learned", lambda s: unescape(s["text"])), "")
    hexed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hexed(said).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        hexed(loss).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
