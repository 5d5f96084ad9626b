"""Metric views and reports (M01, M02): named dimensions and measures over a relation.

A ``MetricView`` holds its source relation and its expressions as text, the way a semantic
layer defines them. ``query`` picks dimensions and measures and yields a ``Report``, which
compiles to a DataFrame aggregation (``frame``) and to the SQL that checks it (``sql``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstar.functions.distinct import grouped
from shelfstar.operators import facts, ledger
from shelfstar.star import Star


# -- relations: the same names on both sides -------------------------------------------------

def _dated(fn: Callable[[Star], DataFrame]):
    """Relations without a raw date to prune on filter their own day."""
    def build(star: Star, since):
        df = fn(star)
        return df if since is None else df.where(F.col("day") >= F.lit(since))
    return build


def _events_sales(star: Star, since) -> DataFrame:
    s = (star.sales(since).groupBy("customer_key", "day")
         .agg(F.max((~F.col("is_return")).cast("int")).alias("kept")))
    joined = star.events(since).join(s, ["customer_key", "day"], "left")
    return joined.withColumn("has_any_sale", F.col("kept").isNotNull()).withColumn(
        "has_purchase", F.coalesce(F.col("kept") == 1, F.lit(False))).drop("kept")


def _rfm(star: Star, since) -> DataFrame:
    kept = star.sales(since).where(~F.col("is_return")).groupBy("customer_key").agg(
        F.max("day").alias("last_day"), F.countDistinct("transaction_id").alias("frequency"),
        F.sum("net_cents").alias("monetary_cents"))
    return kept.withColumn("recency_days", F.datediff(F.lit(star.as_of), "last_day"))


def _moves_to(star: Star, since) -> DataFrame:
    to = star.location().select(F.col("location_key").alias("to_location_key"), "location_name", "region")
    return ledger.movements(star, since).join(to, "to_location_key", "left")


BASE: dict[str, Callable[[Star, object], DataFrame]] = {
    "lines": lambda s, since: s.lines(since),
    "sales": lambda s, since: s.sales(since),
    "events": lambda s, since: s.events(since),
    "customer": lambda s, _: s.customer(),
    "affinity": lambda s, _: facts.affinity(s),
    "inv": lambda s, _: ledger.positions(s),
    "walk": _dated(ledger.stock_walk),
    "inv_daily": _dated(ledger.daily_totals),
    "stockouts": _dated(ledger.stockout_events),
    "moves": ledger.movements,
    "moves_to": _moves_to,
    "carts": _dated(facts.carts),
    "forecast": _dated(facts.forecast),
    "sizefit": lambda s, _: facts.size_fit(s),
    "alloc": _dated(ledger.allocations),
    "events_sales": _events_sales,
    "rfm": _rfm,
}
DIMS: dict[str, tuple[str, Callable[[Star], DataFrame]]] = {
    "customer": ("customer_key", Star.customer), "product": ("product_key", Star.product),
    "location": ("location_key", Star.location), "channel": ("channel_key", Star.channel),
}
SQL_BASE = {
    "events": "events_f", "customer": "customer_d",
    "moves_to": """(select m.*, movement_type || '_reason_' || (transaction_id % 5 + 1) as movement_reason, location_name, region
        from moves m left join location_d on location_d.location_key = to_location_key)""",
    "moves": """(select *, movement_type || '_reason_' || (transaction_id % 5 + 1) as movement_reason,
        case movement_type when 'sale' then 'order' when 'transfer' then 'transfer' else 'adjustment' end as reference_type from moves)""",
    "events_sales": """(select e.*, k.kept is not null as has_any_sale, coalesce(k.kept = 1, false) as has_purchase from events_f e
        left join (select customer_key, day, max(case when is_return then 0 else 1 end) as kept from sales group by 1, 2) k
          using (customer_key, day))""",
    "rfm": """(select customer_key, max(day) as last_day, count(distinct transaction_id) as frequency,
        cast(sum(net_cents) as bigint) as monetary_cents, date_diff('day', max(day), (select d from horizon)) as recency_days
        from sales where not is_return {since} group by 1)""",
}


def relation(star: Star, names: str, since=None) -> DataFrame:
    """``"sales customer"`` -> the sales lines joined with the customer dimension."""
    base, *dims = names.split()
    df = BASE[base](star, since)
    for d in dims:
        key, fn = DIMS[d]
        df = df.join(fn(star), key)
    return df


def relation_sql(names: str, since: int | None = None) -> str:
    base, *dims = names.split()
    text = SQL_BASE.get(base, base)
    bound = f"day >= (select d from horizon) - {since}" if since is not None else ""
    if "{since}" in text:
        text = text.replace("{since}", f"and {bound}" if bound else "") + " r"
        bound = ""
    else:
        text = text + " r"
    text = f"(select * from {text} where {bound}) r" if bound else text
    for d in dims:
        text += f" join {d}_d using ({DIMS[d][0]})"
    return text


# -- the few functions that are spelled differently ------------------------------------------

def for_spark(text: str, star: Star) -> str:
    text = text.replace("{asof}", f"DATE'{star.as_of}'")
    text = re.sub(r"DAYS\(([^,()]+|\{[^}]*\}), ([^,()]+)\)", r"datediff(\1, \2)", text)
    text = re.sub(r"MONTHNAME\((\w+)\)", r"date_format(\1, 'MMMM')", text)
    text = re.sub(r"MONTH0\((\w+)\)", r"cast(trunc(\1, 'MM') as date)", text)
    return re.sub(r"WEEK0\((\w+)\)", r"cast(date_trunc('week', \1) as date)", text)


def for_check(text: str) -> str:
    text = re.sub(r"DAYS\(([^,()]+), ([^,()]+)\)", r"date_diff('day', \2, \1)", text)
    text = text.replace("{asof}", "(select d from horizon)").replace(" div ", " // ")
    text = re.sub(r"MONTHNAME\((\w+)\)", r"monthname(\1)", text)
    text = re.sub(r"MONTH0\((\w+)\)", r"cast(date_trunc('month', \1) as date)", text)
    return re.sub(r"WEEK0\((\w+)\)", r"cast(date_trunc('week', \1) as date)", text)


@dataclass(frozen=True)
class Report:
    """Aggregation of a relation: ``by`` groups, ``agg`` measures, ``post`` works on their names."""

    source: str
    by: dict[str, str] = field(default_factory=dict)
    agg: dict[str, str] = field(default_factory=dict)
    where: str | None = None
    since: int | None = None
    having: str | None = None
    post: dict[str, str] = field(default_factory=dict)
    keep: list[str] | None = None
    order: str | None = None
    limit: int | None = None

    def frame(self, star: Star) -> DataFrame:
        df = relation(star, self.source, None if self.since is None else star.days_back(self.since))
        e = lambda t: F.expr(for_spark(t, star))
        if self.where:
            df = df.where(e(self.where))
        if self.agg:
            df = grouped(df, {n: e(x) for n, x in self.by.items()}, self.agg, e)
        else:
            df = df.select(*[e(x).alias(n) for n, x in self.by.items()])
        if self.having:
            df = df.where(e(self.having))
        if self.post:
            df = df.select("*", *[e(x).alias(n) for n, x in self.post.items()])
        if self.order:
            keys = [k.split() for k in self.order.split(", ")]
            df = df.orderBy(*[F.col(k[0]).desc() if k[1:] == ["desc"] else F.col(k[0]).asc() for k in keys])
        df = df.limit(self.limit) if self.limit else df
        return df.select(*self.keep) if self.keep else df

    def sql(self) -> str:
        cols = [f"{x} as {n}" for n, x in {**self.by, **self.agg}.items()]
        text = f"select {', '.join(cols)} from {relation_sql(self.source, self.since)}"
        if self.where:
            text += f" where {self.where}"
        if self.agg and self.by:
            text += " group by " + ", ".join(str(i + 1) for i in range(len(self.by)))
        if self.having or self.post or self.order or self.keep:
            extra = "".join(f", {x} as {n}" for n, x in self.post.items())
            text = f"select *{extra} from ({text}) t" + (f" where {self.having}" if self.having else "")
        if self.order:
            keys = [k.split() for k in self.order.split(", ")]
            text = f"select {', '.join(self.keep) if self.keep else '*'} from ({text}) u order by " + ", ".join(
                f"{k[0]} desc nulls last" if k[1:] == ["desc"] else f"{k[0]} asc nulls first" for k in keys)
        elif self.keep:
            text = f"select {', '.join(self.keep)} from ({text}) u"
        return for_check(text + (f" limit {self.limit}" if self.limit else ""))


@dataclass(frozen=True)
class MetricView:
    """Named dimensions and measures over a filtered relation, aggregated at the query's grain."""

    source: str
    dimensions: dict[str, str]
    measures: dict[str, str]
    where: str | None = None
    since: int | None = None

    def query(self, dims: list[str] | None = None, measures: list[str] | dict[str, str] | None = None,
              where: str | None = None, having: str | None = None, extra: dict[str, str] | None = None,
              post: dict[str, str] | None = None, order: str | None = None, limit: int | None = None,
              since: int | None = None) -> Report:
        """``where`` filters dimensions before aggregation, ``having`` and ``post`` use result names,
        ``extra`` adds plain aggregates over dimensions."""
        dims = list(self.dimensions) if dims is None else dims
        names = measures if isinstance(measures, dict) else {m: m for m in (measures or self.measures)}
        put = lambda t: re.sub(r"\b(" + "|".join(map(re.escape, self.dimensions)) + r")\b",
                               lambda m: f"({self.dimensions[m.group(1)]})", t)
        filters = " and ".join(f"({w})" for w in (self.where, put(where) if where else None) if w) or None
        return Report(self.source, {d: self.dimensions[d] for d in dims},
                      {**{n: self.measures[m] for n, m in names.items()}, **{n: put(x) for n, x in (extra or {}).items()}},
                      filters, self.since if since is None else since, having, post or {}, None, order, limit)
