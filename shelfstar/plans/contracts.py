"""Contract checks D01-D10 on the published tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstar.functions.exprs import half_up_sql as r
from shelfstar.functions.exprs import money, sum_long
from shelfstar.operators import contracts, facts, ledger, publish
from shelfstar.plans.customer import pct
from shelfstar.plans.inventory import POS
from shelfstar.plans.metric_views import count_if
from shelfstar.plans.registry import query, report
from shelfstar.plans.report import Report
from shelfstar.star import Star

# The published tables over the check tables (only the columns that the rules use).
_PUB = {
    "gold_inventory_fact": "inv",
    "gold_sales_fact": """(select *, allocated as quantity_sold, quantity as quantity_requested, is_constrained as is_inventory_constrained,
        stock_before as inventory_at_purchase from alloc where allocated > 0) t""",
    "gold_stockout_events": """(select *, start_date_key as stockout_start_date_key, end_date_key as stockout_end_date_key, lost_attempts as lost_sales_attempts,
        lost_units as lost_sales_quantity, lost_cents as lost_sales_revenue from stockouts) t""",
    "gold_cart_abandonment_fact": "carts"}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rule_sql(table: str, rules: dict[str, str], share: float = 0.0) -> str:
    return " union all ".join(
        f"""select '{table}' as "table", '{n}' as rule, count(*) filter (where {c}) as violations,
        count(*) filter (where {c}) <= {share}e0 * count(*) as passed from {_PUB[table]}""" for n, c in rules.items())


@query("D01_schema_contract")
def schema_contract(star: Star) -> DataFrame:
    return _union([contracts.check_schema(fn(star), contracts.load_contract(t)) for t, fn in publish.TABLES.items()])


def _fk(table: str, col: str, expr: str, dim: str, source: str) -> str:
    key = {"customer": ("customer_d", "customer_key"), "product": ("product_d", "product_key"), "location": ("location_d", "location_key"),
           "channel": ("channel_d", "channel_key")}.get(dim)
    target = (f"(select {key[1]} as k from {key[0]})" if key else
              "(select year(x) * 10000 + month(x) * 100 + day(x) as k from horizon, unnest(generate_series(d0, d + 365, interval 1 day)) as g(x))")
    return f"""select '{table}', 'foreign_key:{col}', count(*) from {source} where {expr} is not null and {expr} not in (select k from {target} d)"""


_DAY = "cast(year(day) * 10000 + month(day) * 100 + day(day) as int)"
_SOLD = "(select a.*, o_custkey as customer_key, transaction_id % 8 + 1 as channel_key from alloc a join orders on o_orderkey = transaction_id where allocated > 0) s"
_KEYS = "transaction_id, line_number, product_key, location_key, day, quantity, net_cents, discount_cents, is_return"


@query("D02_keys", f"""select "table", rule, violations, violations = 0 as passed from (
    select 'gold_sales_fact' as "table", 'unique:line_item_id' as rule, count(*) - count(distinct ({_KEYS})) as violations
      from lines join (select distinct transaction_id, line_number, product_key, location_key, day, net_cents, quantity, is_return from alloc where allocated > 0) a
      using (transaction_id, line_number, product_key, location_key, day, net_cents, quantity, is_return)
    union all select 'gold_inventory_fact', 'unique:product_key,location_key,date_key', count(*) - count(distinct (product_key, location_key)) from inv
    union all select 'gold_cart_abandonment_fact', 'unique:cart_id', count(*) - count(distinct cart_id) from carts
    union all select 'gold_stockout_events', 'unique:stockout_id', count(*) - count(distinct (product_key, location_key, day)) from stockouts
    union all {_fk('gold_sales_fact', 'customer_key', 'customer_key', 'customer', _SOLD)} union all {_fk('gold_sales_fact', 'product_key', 'product_key', 'product', _SOLD)}
    union all {_fk('gold_sales_fact', 'location_key', 'location_key', 'location', _SOLD)} union all {_fk('gold_sales_fact', 'channel_key', 'channel_key', 'channel', _SOLD)}
    union all {_fk('gold_sales_fact', 'date_key', _DAY, 'date', _SOLD)}
    union all {_fk('gold_inventory_fact', 'product_key', 'product_key', 'product', 'inv')} union all {_fk('gold_inventory_fact', 'location_key', 'location_key', 'location', 'inv')}
    union all {_fk('gold_inventory_fact', 'date_key', 'date_key', 'date', 'inv')}
    union all {_fk('gold_cart_abandonment_fact', 'customer_key', 'customer_key', 'customer', 'carts')}
    union all {_fk('gold_cart_abandonment_fact', 'channel_key', 'channel_key', 'channel', 'carts')} union all {_fk('gold_cart_abandonment_fact', 'date_key', 'date_key', 'date', 'carts')}
    union all {_fk('gold_stockout_events', 'product_key', 'product_key', 'product', 'stockouts')} union all {_fk('gold_stockout_events', 'location_key', 'location_key', 'location', 'stockouts')}
    union all {_fk('gold_stockout_events', 'stockout_start_date_key', 'start_date_key', 'date', 'stockouts')}
    union all {_fk('gold_stockout_events', 'stockout_end_date_key', 'end_date_key', 'date', 'stockouts')}) t""")
def keys(star: Star) -> DataFrame:
    dims = publish.dimension_keys(star)
    return _union([contracts.check_keys(fn(star), contracts.load_contract(t), dims) for t, fn in publish.TABLES.items()])


@query("D02_orphan_sales", "select count(*) as orphan_sales from orders join lineitem on l_orderkey = o_orderkey where o_custkey not in (select c_custkey from customer)")
def orphan_sales(star: Star) -> DataFrame:
    return star.sales().join(star.customer().select("customer_key"), "customer_key", "left_anti").agg(F.count("*").alias("orphan_sales"))


@query("D03_row_rules", " union all ".join(_rule_sql(t, rules) for t, rules in contracts.ROW_RULES.items()))
def row_rules(star: Star) -> DataFrame:
    return _union([contracts.row_rules(publish.TABLES[t](star), t, rules) for t, rules in contracts.ROW_RULES.items()])


@query("D03_history_rules", """
    with w as (select product_key, location_key, day, stock_end, lag(stock_end) over p as prev,
        coalesce(lead(day) over p, (select d + 1 from horizon)) as next, row_number() over p as nth, min(day) over (partition by product_key, location_key) as first
      from walk where day <= (select d from horizon) window p as (partition by product_key, location_key order by day)),
    sold as (select product_key, location_key, day, sum(allocated) as sold from alloc where allocated > 0 group by 1, 2, 3),
    t as (select cast(n * (date_diff('day', d0, d) + 1) as bigint) as position_days from horizon, (select count(distinct (product_key, location_key)) as n from lines) q),
    v as (select 'unique:product_key,location_key,date_key' as rule, (select count(*) - count(distinct (product_key, location_key, day)) from w) as violations
      union all select 'every_day_present', (select coalesce(sum(position_days), 0) from t)
        - (select coalesce(sum(date_diff('day', day, next)), 0) + coalesce(sum(case when nth = 1 then date_diff('day', (select d0 from horizon), first) end), 0) from w)
      union all select 'no_negative_stock', (select coalesce(sum(date_diff('day', day, next)), 0) from w where stock_end < 0)
      union all select 'stock_falls_by_sales_only', (select coalesce(sum(date_diff('day', day, next)), 0) from w left join sold using (product_key, location_key, day)
        where prev - stock_end > coalesce(sold, 0))
      union all select 'sales_day_has_state', (select count(*) from sold anti join w using (product_key, location_key, day))
      union all select 'foreign_key:product_key', (select coalesce(sum(date_diff('day', day, next)), 0) from w where product_key not in (select product_key from product_d))
      union all select 'foreign_key:location_key', (select coalesce(sum(date_diff('day', day, next)), 0) from w where location_key not in (select location_key from location_d)))
    select 'gold_inventory_fact' as "table", rule, cast(violations as bigint) as violations, violations = 0 as passed, position_days from v, t""")
def history_rules(star: Star) -> DataFrame:
    """D02 and D03 over the inventory of all days: rules on run lengths, counted in position-days, no day expanded."""
    return contracts.history_rules(ledger.intervals(star), ledger.allocations(star), star.product(), star.location(), star.first_day, star.as_of)


_RATE = f"({count_if('is_stockout')} * 1e2 / count(*))"


@query("D03_snapshot_history", """select cast(n * (date_diff('day', d0, d) + 1) as bigint) as position_days, cast(0 as bigint) as negative_days, cast(0 as bigint) as missing_or_double_days
    from horizon, (select count(distinct (product_key, location_key)) as n from lines) p""")
def snapshot_history(star: Star) -> DataFrame:
    """The daily snapshot over the whole history: every position has each day once, and no stock is negative."""
    return ledger.history_check(star)


@query("D04_stockout_rate_in_range", f"""select 'gold_inventory_fact' as "table", 'stockout_rate_5_to_10' as rule, cast(case when {_RATE} between 5 and 10 then 0 else 1 end as bigint) as violations,
    {_RATE} between 5 and 10 as passed, {_RATE} as value from inv""")
def stockout_rate(star: Star) -> DataFrame:
    return contracts.check_range(ledger.positions(star), "gold_inventory_fact", "stockout_rate_5_to_10", F.expr(_RATE), 5.0, 10.0)


report("D04_stockout_rate", Report("inv", {}, {"total_positions": "count(*)", "stockout_positions": count_if("is_stockout"),
       "stockout_rate_pct": pct(count_if("is_stockout"), "count(*)", 2)}))
report("D05_constrained_sales", Report("alloc", {}, {
    "total_sales": "count(*)", "constrained_sales": count_if("is_constrained"), "constrained_pct": pct(count_if("is_constrained"), "count(*)", 2),
    "total_requested": sum_long("quantity"), "total_sold": sum_long("allocated"), "lost_quantity": sum_long("quantity - allocated")}, "allocated > 0"))
report("D06_stockout_events", Report("stockouts", {}, {
    "total_events": "count(*)", "total_lost_attempts": sum_long("lost_attempts"), "total_lost_quantity": sum_long("lost_units"),
    "total_lost_revenue": money("lost_cents"), "peak_season_stockouts": count_if("peak_season_flag"), "avg_duration_days": r("avg(duration_days)", 1)}))
report("D07_low_stock_abandonment", Report("carts", {}, {
    "total_abandonments": "count(*)", "low_inventory_abandonments": count_if("low_inventory_trigger"),
    "low_inv_pct": pct(count_if("low_inventory_trigger"), "count(*)", 2), "avg_constrained_items": "avg(inventory_constrained_items)"}))


@query("D07_abandonment_rate_difference", """
    with s as (select customer_key, day, count(*) as n, max(case when c.cart_id is not null then 1 else 0 end) as lost,
        max(case when k.low > 0 then 1 else 0 end) as low
      from events_f e left join carts c using (customer_key, day)
      left join (select customer_key, day, count(*) filter (where stock <= 5) as low from cart_stock group by 1, 2) k using (customer_key, day)
      where event_type = 'add_to_cart' group by 1, 2),
    g as (select low, sum(lost) * 1e2 / count(*) as rate from s group by 1)
    select max(case when low = 0 then rate end) as normal_inventory_rate, max(case when low = 1 then rate end) as low_inventory_rate,
      max(case when low = 1 then rate end) - max(case when low = 0 then rate end) as rate_difference from g""")
def abandonment_difference(star: Star) -> DataFrame:
    """Share of cart sessions that end without purchase, with and without a low-stock item."""
    key = ["customer_key", "day"]
    low = facts.cart_item_stock(star).groupBy(*key).agg(F.max((F.col("stock") <= star.config.low_stock_threshold).cast("int")).alias("low"))
    lost = star.events().groupBy(*key).agg(F.max("conversion_flag").alias("bought"))
    g = low.join(lost, key).groupBy("low").agg((F.count(F.when(~F.col("bought"), 1)) * 100.0 / F.count("*")).alias("rate"))
    normal, scarce = F.max(F.when(F.col("low") == 0, F.col("rate"))), F.max(F.when(F.col("low") == 1, F.col("rate")))
    return g.agg(normal.alias("normal_inventory_rate"), scarce.alias("low_inventory_rate"), (scarce - normal).alias("rate_difference"))


@query("D08_return_restock_delay", f"""select min(delay) as min_delay, max(delay) as max_delay, {r('avg(delay)', 2)} as avg_delay, count(*) as return_count,
    count(*) filter (where delay not between 1 and 3) as violations from (select 1 + transaction_id % 3 as delay from alloc where is_return and allocated > 0) t""")
def restock_delay(star: Star) -> DataFrame:
    """Delay between the two date keys, computed on dates."""
    day = lambda c: F.to_date(F.col(c).cast("string"), "yyyyMMdd")
    s = publish.sales_fact(star).where("is_return and return_restocked_date_key is not null")
    delay = F.datediff(day("return_restocked_date_key"), day("date_key"))
    return s.select(delay.alias("delay")).selectExpr(
        "min(delay) as min_delay", "max(delay) as max_delay", f"{r('avg(delay)', 2)} as avg_delay", "count(*) as return_count",
        "count(case when delay not between 1 and 3 then 1 end) as violations")


@query("D09_stockout_duration", """select 'gold_stockout_events' as "table", 'duration_matches_dates' as rule,
    count(*) filter (where duration_days <> date_diff('day', day, end_day) + 1) as violations,
    count(*) filter (where duration_days <> date_diff('day', day, end_day) + 1) = 0 as passed from stockouts""")
def duration(star: Star) -> DataFrame:
    day = lambda c: f"to_date(cast({c} as string), 'yyyyMMdd')"
    return contracts.row_rules(publish.stockout_fact(star), "gold_stockout_events", {
        "duration_matches_dates": f"stockout_duration_days <> datediff({day('stockout_end_date_key')}, {day('stockout_start_date_key')}) + 1"})


@query("D09_events_agree_with_snapshots", """
    select count(*) as event_days, count(*) filter (where stock is null or stock <> 0) as misaligned_days
    from (select product_key, location_key, cast(x as date) as d from stockouts, unnest(generate_series(day, end_day - 1, interval 1 day)) as g(x)) e
    asof left join (select product_key, location_key, day, stock_end as stock from walk) w
      on e.product_key = w.product_key and e.location_key = w.location_key and e.d >= w.day""")
def events_agree(star: Star) -> DataFrame:
    """Every full day of an event (the restock day excluded) must be a day at zero.

    The zero days of the position up to the event's last day, less those before its first, must
    be the event's own days; no day is expanded.
    """
    e = ledger.stockout_events(star).select(*POS, F.col("day").alias("a"), F.date_sub("end_day", 1).alias("b"))
    ends = F.array(F.struct(F.date_sub("a", 1).alias("day"), F.lit(-1).alias("side")), F.struct(F.col("b").alias("day"), F.lit(1).alias("side")))
    probes = e.select(*POS, "a", F.inline(ends))
    hits = ledger.zero_days_until(star, probes).groupBy(*POS, "a").agg(
        F.sum(F.col("side") * F.col("zero_days")).alias("hit"), F.datediff(F.max("day"), F.col("a")).alias("d"))
    return hits.agg(F.sum(F.col("d") + 1).alias("event_days"), F.sum(F.col("d") + 1 - F.col("hit")).alias("misaligned_days"))


_TOLERANCE = {"lost_units_within_3_per_attempt": "lost_sales_quantity > lost_sales_attempts * 3"}
_REASON = {"reason_agrees_with_trigger": "suspected_reason = 'low_inventory' and not low_inventory_trigger"}


@query("D10_tolerance_rules", _rule_sql("gold_stockout_events", _TOLERANCE, 0.05) + " union all " + _rule_sql("gold_cart_abandonment_fact", _REASON, 0.1))
def tolerance(star: Star) -> DataFrame:
    return contracts.row_rules(publish.stockout_fact(star), "gold_stockout_events", _TOLERANCE, {n: 0.05 for n in _TOLERANCE}).unionByName(
        contracts.row_rules(publish.cart_abandonment_fact(star), "gold_cart_abandonment_fact", _REASON, {n: 0.1 for n in _REASON}))
