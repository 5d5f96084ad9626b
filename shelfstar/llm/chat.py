"""Conversations as training text: a finite-state machine over roles and a declarative template.

The template says how a turn is opened and closed, which texts count for the loss, and which order of
roles is allowed. Control strings inside texts and unknown roles are escaped, so ``read_back`` recovers
every turn from the formatted text alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``names``: role -> name in the text. ``order``: state -> {role: next state}. ``ends``: states that may end."""

    mark: str = "### "
    colon: str = ": "
    close: str = " </turn>\n"
    other: str = "role="
    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple = ("assistant",)
    order: dict = field(default_factory=lambda: {
        "start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    ends: tuple = ("answered",)

    #: Control strings and what stands for them; the backslash comes first when escaping and last when reading.
    @property
    def codes(self) -> list[tuple[str, str]]:
        return [("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"), (": ", "\\c")]


def _replace(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape(text: Column, t: Template) -> Column:
    return _replace(text, t.codes)


def unescape(text: Column, t: Template) -> Column:
    return _replace(text, [(b, a) for a, b in reversed(t.codes)])


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, text).

    Returns conv_id, ``valid`` and ``error_at`` (the first turn, from 0, that breaks the order of roles; the
    number of turns if the conversation stops too early), ``segments`` (text and loss flag, in order) and
    ``formatted``, which is all segments in a row. Turns are ordered by (turn, role, text), nulls first, so
    ties and repeated rows have a fixed place; a null text is empty, a null role is an unknown role without a
    name, rows with a null conv_id are one conversation. Invalid conversations are formatted as well. Other
    columns are ignored. A conversation becomes one row, so it must fit in one.
    """
    t = template or Template()
    names = F.create_map(*[F.lit(x) for kv in t.names.items() for x in kv])
    moves = F.create_map(*[F.lit(x) for s, to in t.order.items() for r, n in to.items() for x in (f"{s}\n{r}", n)])
    one = F.struct(F.col("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def header(x: Column) -> Column:
        known = F.try_element_at(names, x["role"])
        other = F.when(x["role"].isNull(), F.lit("role")).otherwise(F.concat(F.lit(t.other), escape(x["role"], t)))
        return F.concat(F.lit(t.mark), F.coalesce(known, other), F.lit(t.colon))

    def segments(x: Column) -> Column:
        quiet = F.lit(False)
        return F.array(F.struct(header(x).alias("text"), quiet.alias("loss")),
                       F.struct(escape(x["text"], t).alias("text"), F.coalesce(x["role"].isin(*t.loss), quiet).alias("loss")),
                       F.struct(F.lit(t.close).alias("text"), quiet.alias("loss")))

    def step(acc: Column, x: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), F.coalesce(x["role"], F.lit(""))))
        return F.struct(F.coalesce(to, F.lit("broken")).alias("state"), (acc["n"] + F.when(to.isNotNull(), 1).otherwise(0)).alias("n"))

    walked = F.aggregate("turns", F.struct(F.lit("start").alias("state"), F.lit(0).alias("n")), step)
    valid = F.col("walk.state").isin(*t.ends)
    return (chats.withColumn("walk", walked).withColumn("segments", F.flatten(F.transform("turns", segments)))
            .select("conv_id", valid.alias("valid"), F.when(~valid, F.col("walk.n")).alias("error_at"), "segments",
                    F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text, loss) that a formatted conversation holds."""
    t = template or Template()
    roles = F.create_map(*[F.lit(x) for r, n in t.names.items() for x in (n, r)])
    start = len(t.mark) + 1

    def turn(x: Column) -> Column:
        colon = F.instr(x, t.colon)
        name, text = F.substring(x, F.lit(start), colon - F.lit(start)), F.substr(x, colon + F.lit(len(t.colon)))
        other = F.when(F.startswith(name, F.lit(t.other)), unescape(F.substr(name, F.lit(len(t.other) + 1)), t))
        role = F.coalesce(F.try_element_at(roles, name), other)
        return F.struct(role.alias("role"), unescape(text, t).alias("text"), F.coalesce(role.isin(*t.loss), F.lit(False)).alias("loss"))

    parts = F.split(formatted, t.close.replace("/", "\\/"))
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)
