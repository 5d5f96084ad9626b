"""The metric layer and the star's tables in SQL (M02): ``ask`` answers a statement with named parameters.

Each metric view is a SQL table function over its relation. It groups by the dimensions listed in ``by`` (all
of them by default; the others read null) and returns every measure:

    ask(star, "select segment, total_revenue from customer_purchase_summary(by => 'segment', since => :day) "
              "where total_revenue > :least", day=date(1997, 1, 1), least=1000)

``keep_<dimension>`` filters a dimension before the aggregation, whether or not it is grouped by, and ``since``
and ``until`` bound the day where the relation has one. Measures are filtered with plain ``where``. Arguments
are constants of the plan: groupings and filters not asked vanish, and measures not selected are pruned. An
unknown name in ``by`` fails; with ``by => ''`` there is one row, or none over an empty relation.

Only the functions and tables that a statement names are registered, as temporary ones of the session.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from shelfstar.functions.distinct import nest_key, split
from shelfstar.operators import facts, ledger, publish
from shelfstar.plans import metric_views as mv
from shelfstar.plans.registry import query
from shelfstar.plans.report import MetricView, for_spark, relation
from shelfstar.star import Star

VIEWS: dict[str, MetricView] = {name.split("_", 1)[1]: view for name, view in mv.VIEWS.items()}
VIEWS["customer_segmentation"] = mv.customer_segmentation
TABLES = {**publish.TABLES, "gold_customer_dim": Star.customer, "gold_product_dim": Star.product, "gold_location_dim": Star.location,
          "gold_channel_dim": Star.channel, "sales_lines": Star.sales, "web_events": Star.events, "positions": ledger.positions,
          "stock_intervals": ledger.intervals, "affinity": facts.affinity}


def _functions(name: str, view: MetricView, star: Star, rows: DataFrame, source: str) -> str:
    e = lambda t: for_spark(t, star)
    dims, measures = {d: e(x) for d, x in view.dimensions.items()}, {m: e(x) for m, x in view.measures.items()}
    types = dict(view.query().frame(star).dtypes)
    asked = f"array_remove(split(replace({name}.by, ' ', ''), ','), '')"
    known = "array(" + ", ".join(f"'{d}'" for d in dims) + ")"
    odd = f"array_except({asked}, {known})"
    filters = [f"if(size({odd}) = 0, true, cast(raise_error(concat('no such dimension: ', array_join({odd}, ', '))) as boolean))"]
    filters += [f"({e(view.where)})"] if view.where else []
    filters += [f"({name}.keep_{d} is null or ({x}) = {name}.keep_{d})" for d, x in dims.items()]
    params = [f"by string default '{','.join(dims)}'", *[f"keep_{d} {types[d]} default null" for d in dims]]
    if "day" in rows.columns:
        params += ["since date default null", "until date default null"]
        filters += [f"({name}.since is null or day >= {name}.since)", f"({name}.until is null or day <= {name}.until)"]
    groups = [f"case when array_contains({asked}, '{d}') then {x} end as _d{i}" for i, (d, x) in enumerate(dims.items())]
    ids = ", ".join(f"_d{i}" for i in range(len(dims)))
    key = nest_key(list(measures.values()), rows.columns)
    # A key of the nested grouping keeps the rows narrow; without one the inner select only names dimensions.
    if key is None:
        body, outer = f"select {', '.join(groups)}, * from {source} where {' and '.join(filters)}", measures
    else:
        inner, outer = split(measures, key)
        parts = ", ".join(f"{text} as {n}" for n, text in inner.items()) or "1 as _one"
        named = f"select {', '.join(groups)}, * from {source} where {' and '.join(filters)}"
        body = f"select {ids}, {key} as _key, {parts} from ({named}) group by {ids}, {key}"
    out = [f"_d{i} as {d}" for i, d in enumerate(dims)] + [f"{x} as {m}" for m, x in outer.items()]
    columns = ", ".join(f"{n} {types[n]}" for n in [*dims, *measures])
    return (f"create or replace temporary function {name}({', '.join(params)}) returns table ({columns}) "
            f"return select {', '.join(out)} from ({body}) group by {ids}")


def publish_function(star: Star, name: str) -> None:
    """Registers the metric view ``name`` as a table function of the session."""
    view = VIEWS[name]
    rows = relation(star, view.source, None if view.since is None else star.days_back(view.since))
    rows.createOrReplaceTempView(f"_{name}_rows")
    star.spark.sql(_functions(name, view, star, rows, f"_{name}_rows"))


def publish_table(star: Star, name: str) -> None:
    TABLES[name](star).createOrReplaceTempView(name)


def ask(star: Star, text: str, **params) -> DataFrame:
    """The answer to a SQL statement over metric functions and star tables; ``:name`` stands for a parameter."""
    words = set(re.findall(r"\w+", text.lower()))
    for name in VIEWS:
        if re.search(rf"\b{name}\s*\(", text, re.IGNORECASE):
            publish_function(star, name)
    for name in TABLES:
        if name in words:
            publish_table(star, name)
    return star.spark.sql(text, args=params or None)


_SUMMARY = """select segment, channel_name, count(distinct transaction_id) as orders, sum(net_cents) / 1e2 as revenue, count(distinct customer_key) as customers
    from sales join customer_d using (customer_key) join channel_d using (channel_key)
    where not is_return and year(day) >= 1997 and channel_name <> 'In-Store Kiosk' group by 1, 2 having count(distinct transaction_id) > 10"""


@query("M02_metric_sql", _SUMMARY)
def metric_sql(star: Star) -> DataFrame:
    """The metric query written as SQL, with named arguments and parameters."""
    import datetime as dt
    return ask(star, """select segment, channel_name, transaction_count as orders, total_revenue as revenue, unique_customers as customers
        from customer_purchase_summary(by => 'segment,channel_name', since => :since)
        where channel_name <> :without and transaction_count > :least""", since=dt.date(1997, 1, 1), without="In-Store Kiosk", least=10)


@query("M02_funnel_sql", """select segment, count(distinct session_id) as total_sessions,
      count(distinct case when event_type = 'add_to_cart' then session_id end) as add_to_cart,
      count(distinct case when k.kept then session_id end) as purchases
    from events_f e join customer_d using (customer_key)
    left join (select customer_key, day, bool_or(not is_return) as kept from sales group by 1, 2) k using (customer_key, day)
    where e.day >= (select d from horizon) - 90 and year(e.day) = (select year(d) from horizon) group by 1""")
def funnel_sql(star: Star) -> DataFrame:
    """A dimension that is filtered but not grouped by."""
    return ask(star, "select segment, total_sessions, add_to_cart, purchases from engagement_funnel(by => 'segment', keep_year => :year)",
               year=star.as_of.year)


@query("I13_positions_sql", """select product_name, location_name, cast(quantity_on_hand as int) as quantity_on_hand,
      cast(quantity_available as int) as quantity_available, is_stockout
    from inv join product_d using (product_key) join location_d using (location_key)
    where location_key = 1 and category_level_1 = 'SMALL'""")
def positions_sql(star: Star) -> DataFrame:
    """Published tables in plain SQL with named parameters."""
    return ask(star, """select p.product_name, l.location_name, i.quantity_on_hand, i.quantity_available, i.is_stockout
        from gold_inventory_fact i join gold_product_dim p on i.product_key = p.product_key join gold_location_dim l on i.location_key = l.location_key
        where l.location_key = :location and p.category_level_1 = :category""", location=1, category="SMALL")
