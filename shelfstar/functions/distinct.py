"""Exact distinct counts beside other measures, by nested grouping instead of row expansion.

Several distinct counts in one aggregation make Spark repeat every row once per distinct column. Here rows
are grouped by the query's keys and one more, the owner (a customer), first: a value that belongs to one
owner only (an order, a session) is counted inside its owner's group and the counts add up, and the owner
itself counts as one row. Each step combines before it shuffles, and a large group is spread over its owners.

Measures are SQL text, as in a metric view. ``grouped`` falls back to the plain aggregation where no
distinct count, or one that cannot be nested, is asked.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns whose values belong to one owner each.
OWNER = {"transaction_id": "customer_key", "session_id": "customer_key"}
_CALL = re.compile(r"\b(sum|count|avg|min|max)\s*\(", re.IGNORECASE)
_OTHER = re.compile(r"\b(stddev\w*|var\w*|median|percentile\w*|quantile\w*|collect\w*|any_value|first|last|bool_\w+|count_if)\s*\(", re.IGNORECASE)
_DISTINCT = re.compile(r"distinct\s+(?:case\s+when\s+(?P<cond>.+)\s+then\s+(?P<a>\w+)\s+end|(?P<b>\w+))", re.IGNORECASE | re.DOTALL)


def calls(text: str) -> list[tuple[int, int, str, str]]:
    """Aggregate calls of a measure as (start, end, function, argument)."""
    found, at = [], 0
    while m := _CALL.search(text, at):
        depth, end = 1, m.end()
        while depth and end < len(text):
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        found.append((m.start(), end, m.group(1).lower(), text[m.end():end - 1].strip()))
        at = end
    return found


def _distincts(measures: list[str]) -> set[str] | None:
    """The different distinct arguments of all measures; None if one has a form that cannot be nested."""
    found = set()
    for text in measures:
        for _, _, fn, arg in calls(text):
            if arg.lower().startswith("distinct"):
                if fn != "count" or not _DISTINCT.fullmatch(arg):
                    return None
                found.add(arg)
    return found


def _counted(arg: str) -> tuple[str, str | None]:
    m = _DISTINCT.fullmatch(arg)
    return m.group("a") or m.group("b"), m.group("cond")


def nest_key(measures: list[str], columns: list[str]) -> str | None:
    """The column to group by first, if nesting saves a row expansion and gives the same counts."""
    found = _distincts(measures)
    if not found or len(found) < 2 or any(_OTHER.search(m) for m in measures):
        return None
    counted = [_counted(a) for a in found]
    names = {c for c, _ in counted}
    if len(names) == 1:
        return next(iter(names & set(columns)), None)
    owners = {OWNER.get(c, c) for c in names}
    inner = [(c, cond) for c, cond in counted if c not in owners]
    if len(owners) == 1 and len(inner) == 1 and inner[0][1] is None and owners <= set(columns):
        return next(iter(owners))
    return None


def split(agg: dict[str, str], key: str) -> tuple[dict[str, str], dict[str, str]]:
    """Measures as text of the inner grouping (with ``key``) and of the outer one, where the key is named ``_key``."""
    inner: dict[str, str] = {}

    def part(fn: str, arg: str) -> str:
        return inner.setdefault(f"{fn}({arg})", f"_p{len(inner)}")

    def outer(fn: str, arg: str) -> str:
        if fn == "count" and arg.lower().startswith("distinct"):
            name, cond = _counted(arg)
            if name != key:
                return f"coalesce(sum({part(fn, arg)}), 0L)"
            return "count(_key)" if cond is None else f"count(case when {part('max', f'case when {cond} then 1 end')} = 1 then _key end)"
        if fn == "avg":
            return f"(sum({part('sum', arg)}) / nullif(sum({part('count', arg)}), 0))"
        if fn == "count":
            return f"coalesce(sum({part(fn, arg)}), 0L)"
        return f"{fn}({part(fn, arg)})"

    def rewrite(text: str) -> str:
        out, at = "", 0
        for start, end, fn, arg in calls(text):
            out, at = out + text[at:start] + outer(fn, arg), end
        return out + text[at:]

    outers = {name: rewrite(text) for name, text in agg.items()}
    return {name: text for text, name in inner.items()}, outers


def nested(df: DataFrame, by: dict[str, Column], agg: dict[str, str], key: str,
           expr: Callable[[str], Column] = F.expr) -> DataFrame:
    """``df.groupBy(by).agg(agg)``, grouped by ``by`` and ``key`` first. Rows without a key form one inner group,
    which counts for all measures but the distinct count of the key."""
    inner, outer = split(agg, key)
    keyed = df.groupBy(*[c.alias(n) for n, c in by.items()], F.col(key).alias("_key"))
    rows = keyed.agg(*[expr(text).alias(name) for name, text in inner.items()] or [F.lit(1).alias("_one")])
    return rows.groupBy(*by).agg(*[F.expr(text).alias(name) for name, text in outer.items()])


def grouped(df: DataFrame, by: dict[str, Column], agg: dict[str, str], expr: Callable[[str], Column] = F.expr) -> DataFrame:
    """Groups and measures at once; nested where that saves a row expansion."""
    key = nest_key(list(agg.values()), df.columns)
    if key is not None:
        return nested(df, by, agg, key, expr)
    return df.groupBy(*[c.alias(n) for n, c in by.items()]).agg(*[expr(x).alias(n) for n, x in agg.items()])
