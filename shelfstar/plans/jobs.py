"""Conforming jobs C01-C11, ledger jobs L01-L18 and table jobs T01-T12 as named queries."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfstar.config import MONTH_FACTOR, SEGMENT_RULES
from shelfstar.functions.exprs import half_up_sql as r
from shelfstar.functions.exprs import money, sum_long
from shelfstar.operators import facts, ledger
from shelfstar.operators.calendar import HOLIDAYS, SALE_EVENTS, date_dimension, time_dimension
from shelfstar.plans.customer import pct
from shelfstar.plans.inventory import POS, cols
from shelfstar.plans.metric_views import COST, RETAIL, SEASON, count_if
from shelfstar.plans.registry import query, report
from shelfstar.plans.report import Report, for_check
from shelfstar.sources import tables
from shelfstar.sources.tables import scratch
from shelfstar.star import OPENING, Star

RAW = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
_q = lambda s: "'" + s.replace("'", "''") + "'"
_HOLIDAY = "case " + " ".join(f"when month(d) = {m} and day(d) = {x} then {_q(n)}" for n, (m, x) in HOLIDAYS.items()) + " end"
_SALE = "case month(d) " + " ".join(f"when {m} then {_q(n)}" for m, n in SALE_EVENTS.items()) + " end"
_DATES = f"""(select year(d) * 10000 + month(d) * 100 + day(d) as date_key, d as calendar_date, year(d) as year, quarter(d) as quarter, month(d) as month,
      monthname(d) as month_name, weekofyear(d) as week_of_year, day(d) as day_of_month, isodow(d) as day_of_week, dayname(d) as day_name,
      isodow(d) >= 6 as is_weekend, ({_HOLIDAY}) is not null as is_holiday, {_HOLIDAY} as holiday_name,
      case when month(d) >= 2 then year(d) else year(d) - 1 end as fiscal_year, (month(d) + 10) % 12 // 3 + 1 as fiscal_quarter,
      (month(d) + 10) % 12 + 1 as fiscal_month, {SEASON.replace('day', 'd')} as season, month(d) in (11, 12, 3, 4) as is_peak_season,
      ({_SALE}) is not null as is_sale_period, {_SALE} as sale_event_name
    from (select cast(x as date) as d from horizon, unnest(generate_series(d0, horizon.d + 365, interval 1 day)) as g(x)) s)"""


@query("C01_date_dimension", f"select * from {_DATES} t")
def dates(star: Star) -> DataFrame:
    return date_dimension(star.spark, star.first_day, star.as_of + dt.timedelta(days=365))


@query("C02_time_dimension", """
    select h * 100 + m as time_key, h as hour, m as minute, printf('%02d:%02d', h, m) as hour_minute, case when h < 12 then 'AM' else 'PM' end as am_pm,
      case when h <= 12 then h else h - 12 end as hour_12,
      case when h between 6 and 11 then 'Morning' when h between 12 and 16 then 'Afternoon' when h between 17 and 20 then 'Evening' else 'Night' end as period_of_day,
      h between 9 and 20 as is_business_hours, h in (12, 13, 17, 18, 19, 20) as is_peak_hours, coalesce(n, 0) as event_count
    from (select cast(q // 4 as int) as h, cast(q % 4 * 15 as int) as m from range(96) t(q)) d
    left join (select time_key, count(*) as n from events_f group by 1) e on e.time_key = h * 100 + m""")
def times(star: Star) -> DataFrame:
    """The time dimension with the events that fall into each slot."""
    seen = star.events().groupBy("time_key").agg(F.count("*").alias("n"))
    return time_dimension(star.spark).join(seen, "time_key", "left").withColumn("event_count", F.coalesce("n", F.lit(0))).drop("n")


report("C03_channel_dimension", Report(
    "lines channel", cols("channel_key", "channel_code", "channel_name", "channel_type", "channel_category", "device_category", "is_digital",
                          "is_owned", "commission_rate"),
    {"transactions": "count(distinct transaction_id)", "commission": r("sum(net_cents) * commission_rate / 1e4", 2)}))


@query("C04_location_dimension", "select * from location_d")
def locations(star: Star) -> DataFrame:
    return star.location()


@query("C05_product_dimension", "select * from product_d")
def products(star: Star) -> DataFrame:
    return star.product()


@query("C06_current_customers", "select * from customer_d where is_current")
def current_customers(star: Star) -> DataFrame:
    return star.customer().where("is_current")


def _rule(field: str) -> str:
    return ("(case segment " + " ".join(f"when '{s}' then {getattr(x, field)}" for s, x in SEGMENT_RULES.items()) + " end)")


@query("C07_line_pricing", f"""
    with a as (select s.*, price_cents, unit_cost_cents, season_code, segment, tax_rate_e5, (transaction_id * 7 + line_number * 13) % 100 as mix
      from sales s join product_d using (product_key) join customer_d using (customer_key) join location_d using (location_key)),
    b as (select *, season_code <> {SEASON} and mix < 20 as is_clearance, month(day) in (1, 2, 3, 5, 7, 9, 11, 12) and mix % 10 < 3 as is_promotional from a),
    c as (select *, cast(case when is_clearance then 30 + mix % 21 when is_promotional then 10 + mix % 21
        when mix < {_rule('discount_probability')} then {_rule('discount_low')} + mix % ({_rule('discount_high')} - {_rule('discount_low')} + 1) else 0 end as int) as discount_pct from b),
    d as (select *, price_cents * discount_pct // 100 as disc, (price_cents - price_cents * discount_pct // 100) * quantity as net from c)
    select transaction_id, line_number, customer_key, product_key, location_key, day, quantity, segment, is_clearance, is_promotional, discount_pct,
      disc as discount_cents, net as net_cents, net * tax_rate_e5 // 100000 as tax_cents, net - quantity * unit_cost_cents as margin_cents, is_return from d""")
def line_pricing(star: Star) -> DataFrame:
    return facts.priced_lines(star)


@query("C08_event_enrichment", "select * exclude (ts) from events_f")
def enriched_events(star: Star) -> DataFrame:
    return star.events().drop("ts")


_MULT = ("(case when is_peak_season then 1.5e0 else 1e0 end) * (case when is_sale_period then 1.3e0 else 1e0 end) * (case when is_holiday then 1.8e0 else 1e0 end) "
         "* (case when is_weekend then 1.2e0 else 1e0 end) * (case month " + " ".join(f"when {m} then {f}e0" for m, f in MONTH_FACTOR.items()) + " end)")


@query("C09_seasonality_multiplier", f"""
    select date_key, {_MULT} as multiplier, coalesce(n, 0) as transactions from {_DATES} t
    left join (select date_key as k, count(distinct transaction_id) as n from lines group by 1) s on k = date_key""")
def seasonality(star: Star) -> DataFrame:
    sold = star.lines().groupBy("date_key").agg(F.countDistinct("transaction_id").alias("n"))
    return facts.season_multiplier(dates(star)).join(sold, "date_key", "left").select(
        "date_key", "multiplier", F.coalesce("n", F.lit(0)).alias("transactions"))


@query("C10_preferred_channel_match", """
    select customer_key, preferred_channel, coalesce(m, cast(customer_key % 8 + 1 as int)) as channel_key, m is null as is_fallback
    from customer_d left join (select p, min(channel_key) as m from (select distinct preferred_channel as p from customer_d) t
      join channel_d on lower(channel_code) like '%' || p || '%' group by 1) x on p = preferred_channel""")
def preferred_channels(star: Star) -> DataFrame:
    return facts.preferred_channel_match(star)


@query("C11_return_rate", f"""
    select segment, channel_code, is_digital, {_rule('return_probability')} / 1e2 * case when is_digital then 2.5e0 else 0.8e0 end as expected_return_rate,
      count(*) as lines, count(*) filter (where is_return) as returns, count(*) filter (where is_return) / count(*) as observed_return_rate
    from sales join customer_d using (customer_key) join channel_d using (channel_key) group by 1, 2, 3""")
def return_rates(star: Star) -> DataFrame:
    return facts.return_rate(star)


# -- ledger --------------------------------------------------------------------------------------

@query("L01_opening_positions", f"select distinct product_key, location_key, {OPENING} as opening from lines")
def opening(star: Star) -> DataFrame:
    return ledger.opening_positions(star)


@query("L02_availability_check", f"""
    select event_id, product_key, location_key, day, requested, stock as available, stock >= requested as is_available
    from (select e.*, coalesce(stock_end, {OPENING.replace('product_key', 'e.product_key').replace('location_key', 'e.location_key')}) as stock
          from (select event_id, product_key, customer_key % 10 as location_key, day, 1 + event_id % 5 as requested
                from events_f where event_type = 'add_to_cart') e
          asof left join (select product_key, location_key, day, stock_end from walk) w
            on e.product_key = w.product_key and e.location_key = w.location_key and e.day >= w.day) t""")
def availability(star: Star) -> DataFrame:
    """Stock at the customer's store for each item put into a cart, without allocating it."""
    want = 1 + F.col("event_id") % 5
    return facts.cart_item_stock(star).select("event_id", *POS, "day", want.alias("requested"), F.col("stock").alias("available"),
                                              (F.col("stock") >= want).alias("is_available"))


@query("L03_allocate_in_order", """
    select transaction_id, line_number, product_key, location_key, day, quantity, cast(stock_before as bigint) as stock_before,
      cast(allocated as bigint) as allocated, is_constrained from alloc""")
def allocate_in_order(star: Star) -> DataFrame:
    return ledger.allocations(star).select("transaction_id", "line_number", *POS, "day", "quantity", "stock_before", "allocated", "is_constrained")


def _requests(star: Star) -> tuple[DataFrame, DataFrame]:
    req = star.lines().select(*POS, "day", F.col("transaction_id").alias("request_id"), F.col("quantity").alias("requested"),
                              (F.col("transaction_id") % 3).alias("priority"))
    return req, ledger.stock_walk(star).where("attempts > 0").select(*POS, "day", "stock_start")


def _batch_sql(order: str) -> str:
    return f"""
    with q as (select *, transaction_id as request_id, quantity as requested, transaction_id % 3 as priority,
        ((transaction_id * 7919 + 42 * 104729) % 1000003) * ((transaction_id * 7919 + 42 * 104729) % 1000003) % 1000003 as mix from lines),
    c as (select q.*, stock_start, sum(requested) over (partition by product_key, location_key, day order by {order} rows unbounded preceding) as cum
      from q join walk using (product_key, location_key, day))
    select product_key, location_key, day, request_id, requested, priority, stock_start, cast(least(cum, stock_start) - least(cum - requested, stock_start) as bigint) as allocated,
      least(cum, stock_start) - least(cum - requested, stock_start) < requested as is_constrained from c"""


@query("L04_batch_allocation_random", _batch_sql("mix, request_id, requested"))
def batch_random(star: Star) -> DataFrame:
    return ledger.batch_allocation(*_requests(star))


@query("L04_batch_allocation_priority", _batch_sql("priority desc, mix, request_id, requested"))
def batch_priority(star: Star) -> DataFrame:
    return ledger.batch_allocation(*_requests(star), by_priority=True)


_LEDGER = "select product_key, location_key, day, restock, request, attempts, cast(stock_start as bigint) as stock_start, stock_end from "
_LEDGER_COLUMNS = [*POS, "day", "restock", "request", "attempts", "stock_start", "stock_end"]


@query("L05_restock_of_returns", _LEDGER + "requested_walk")
def restock(star: Star) -> DataFrame:
    """Short form: requested quantities come back 1-3 days after the return. No other query rests on it."""
    return ledger.reflected_walk(ledger.requested_ledger(star)).select(*_LEDGER_COLUMNS)


@query("L05_restock_allocated_exact", _LEDGER + "walk")
def restock_exact(star: Star) -> DataFrame:
    """The ledger of all stock queries: only the allocated quantities come back."""
    return ledger.stock_walk(star).select(*_LEDGER_COLUMNS)


@query("L06_low_stock_flag", "select customer_key, product_key, location_key, day, stock, stock <= 5 as is_low_inventory from cart_stock")
def low_stock(star: Star) -> DataFrame:
    return facts.cart_item_stock(star).select("customer_key", *POS, "day", "stock",
                                              (F.col("stock") <= star.config.low_stock_threshold).alias("is_low_inventory"))


_SPANS = """(select product_key, location_key, day as first_day, coalesce(least(next_day - 1, (select d from horizon)), (select d from horizon)) as last_day,
        stock_end as stock, units_total, selling_days from walk where day <= (select d from horizon)
      union all select product_key, location_key, (select d0 from horizon), min(day) - 1, any_value(opening), any_value(units_total), any_value(selling_days)
      from walk group by 1, 2 having min(day) > (select d0 from horizon))"""


@query("L07_position_states", f"select product_key, location_key, first_day, last_day, cast(stock as bigint) as stock from {_SPANS} t")
def position_states(star: Star) -> DataFrame:
    """The daily snapshot in run-length form: every position, whole history."""
    return ledger.intervals(star).select(*POS, "first_day", "last_day", "stock")


@query("L07_daily_snapshot_by_location", for_check(f"""
    select location_key, cast(x as date) as day, count(*) as positions, cast(sum(stock) as bigint) as quantity_on_hand, count(*) filter (where stock = 0) as stockouts
    from {_SPANS} t, unnest(generate_series(first_day, last_day, interval 1 day)) as g(x) group by 1, 2"""))
def daily_snapshot(star: Star) -> DataFrame:
    """Position x day over the whole history, counted per location and day."""
    return ledger.location_days(star)


@query("L07_daily_snapshot", for_check("""
    select product_key, location_key, day, stock as quantity_on_hand, stock as quantity_available, cast(0 as bigint) as quantity_reserved, cast(0 as bigint) as quantity_damaged,
      stock = 0 as is_stockout, case when stock = 0 then coalesce(date_diff('day', since, day), 0) else 0 end as stockout_days
    from (select p.product_key, p.location_key, p.day, cast(coalesce(arg_max(stock_end, w.day), any_value(o)) as bigint) as stock,
            max(w.day) filter (where stock_start > 0 and stock_end = 0 and request > 0) as since
          from (select product_key, location_key, cast(x as date) as day, o from (select product_key, location_key, any_value(opening) as o from walk group by 1, 2) k,
                  unnest(generate_series({asof} - 6, {asof}, interval 1 day)) as g(x)) p
          left join walk w on w.product_key = p.product_key and w.location_key = p.location_key and w.day <= p.day group by 1, 2, 3) t"""))
def snapshot(star: Star) -> DataFrame:
    """The dense snapshot for a reporting period, here the week up to the latest day."""
    return ledger.snapshot(star, star.days_back(6), star.as_of)


@query("L08_stockout_periods", "select * from periods where end_day is not null")
def periods(star: Star) -> DataFrame:
    return ledger.stockout_periods(star).where("end_day is not null").select(*POS, "start_day", "end_day")


@query("L09_stockout_events", "select * from stockouts")
def stockout_events(star: Star) -> DataFrame:
    return ledger.stockout_events(star)


@query("L10_average_daily_sales", """select product_key, location_key, attempts_total / selling_days as avg_attempts, units_total / selling_days as avg_quantity
    from avg_daily""")
def average_daily(star: Star) -> DataFrame:
    return ledger.average_daily_sales(star).select(*POS, (F.col("attempts_total") / F.col("selling_days")).alias("avg_attempts"),
                                                   (F.col("units_total") / F.col("selling_days")).alias("avg_quantity"))


report("L11_inventory_valuation", Report("inv product", {
    **cols(*POS, "quantity_on_hand", "days_of_supply", "stock_cover_days", "reorder_point", "reorder_quantity", "is_overstock"),
    "inventory_value_cost": f"({COST} / 1e2)", "inventory_value_retail": f"({RETAIL} / 1e2)"}, {}))
report("L12_movement_ledger", Report("moves", cols(
    "movement_type", "product_key", "from_location_key", "to_location_key", "day", "quantity", "unit_cents", "total_cents", "movement_reason", "reference_type"), {}))
report("L13_stock_statistics", Report("inv", {}, {
    "total_positions": "count(*)", "stockout_positions": count_if("is_stockout"), "stockout_rate_pct": f"({count_if('is_stockout')} * 1e2 / count(*))",
    "low_inventory_positions": count_if("quantity_available > 0 and quantity_available <= 5"), "units_on_hand": sum_long("quantity_on_hand"),
    "pending_replenishments": count_if("quantity_in_transit > 0")}))


@query("L14_allocation_statistics", f"""
    select count(*) as total_allocations, count(*) filter (where allocated > 0 and allocated < quantity) as constrained_allocations, count(*) filter (where allocated = 0) as failed_allocations,
      {pct('count(*) filter (where allocated > 0 and allocated < quantity)', 'count(*)', 2)} as constrained_pct, {pct('count(*) filter (where allocated = 0)', 'count(*)', 2)} as failed_pct,
      cast(sum(quantity) as bigint) as units_requested, cast(sum(allocated) as bigint) as units_allocated from alloc""")
def allocation_statistics(star: Star) -> DataFrame:
    return ledger.allocation_statistics(ledger.allocations(star))


report("L15_stockout_statistics", Report("stockouts", {}, {
    "total_stockout_events": "count(*)", "avg_duration_days": "avg(duration_days)", "total_lost_revenue": money("lost_cents"),
    "peak_season_events": count_if("peak_season_flag"), "peak_season_pct": f"({count_if('peak_season_flag')} * 1e2 / nullif(count(*), 0))",
    "total_lost_sales_attempts": sum_long("lost_attempts")}))
report("L15_top_stockout_products", Report("stockouts", cols("product_key"), {
    "stockout_count": "count(*)", "total_lost_revenue": money("lost_cents")}, order="stockout_count desc, product_key", limit=10))


@query("L16_cart_abandonment", "select * from carts")
def cart_abandonment(star: Star) -> DataFrame:
    return facts.carts(star)


@query("L17_forecast_accuracy", "select * from forecast")
def forecast_accuracy(star: Star) -> DataFrame:
    return facts.forecast(star)


@query("L18_size_recommendation", """
    select s.*, case size_profile_bottoms when '28' then 'XS' when '30' then 'S' when '32' then 'M' when '34' then 'L' when '36' then 'XL' else 'M' end as usual_bottoms_letter
    from sizefit s join customer_d using (customer_key)""")
def size_recommendation(star: Star) -> DataFrame:
    who = star.customer().select("customer_key", facts.bottoms_as_letters(F.col("size_profile_bottoms")).alias("usual_bottoms_letter"))
    return facts.size_fit(star).join(who, "customer_key")


# -- tables --------------------------------------------------------------------------------------

@query("T01_filtered_scan", "select p_partkey, p_name, p_retailprice from part where p_size >= 25 and p_type = 'PROMO'")
def filtered_scan(star: Star) -> DataFrame:
    return tables.load(star.spark, f"{star.dir}/part.parquet", ["p_partkey", "p_name", "p_retailprice"],
                       (F.col("p_size") >= 25) & (F.col("p_type") == "PROMO"))


@query("T03_typed_create", """select c_custkey as customer_key, c_mktsegment as segment, c_acctbal as lifetime_value from customer""")
def typed_create(star: Star) -> DataFrame:
    """Rows appended to an empty table of a declared schema."""
    empty = tables.create(star.spark, [], "customer_key long, segment string, lifetime_value double")
    return empty.unionByName(star.raw("customer").select(F.col("c_custkey").alias("customer_key"), F.col("c_mktsegment").alias("segment"),
                                                         F.col("c_acctbal").alias("lifetime_value")))


@query("T04_schema_merge", """select s_suppkey, s_name, null as s_acctbal from supplier where s_suppkey % 2 = 0
    union all select s_suppkey, s_name, s_acctbal from supplier where s_suppkey % 2 = 1""")
def schema_merge(star: Star) -> DataFrame:
    s = star.raw("supplier")
    old = s.where("s_suppkey % 2 = 0").select("s_suppkey", "s_name")
    return tables.append_merged(old, s.where("s_suppkey % 2 = 1").select("s_suppkey", "s_name", "s_acctbal"))


@query("T07_table_report")
def table_report(star: Star) -> DataFrame:
    return tables.table_report(star.spark, {n: f"{star.dir}/{n}.parquet" for n in RAW})


@query("T08_load_summary", """
    select 'lineitem' as table_name, count(*) as record_count, cast(max(l_shipdate) as timestamp) as last_loaded from lineitem
    union all select 'orders', count(*), cast(max(o_orderdate) as timestamp) from orders union all select 'events', count(*), cast(max(ts) as timestamp) from events""")
def load_summary(star: Star) -> DataFrame:
    return tables.load_summary({"lineitem": (star.raw("lineitem"), "l_shipdate"), "orders": (star.raw("orders"), "o_orderdate"),
                                "events": (star.raw("events"), "ts")})


@query("T10_clustered_layout", "select transaction_id, product_key, location_key, day, quantity from lines")
def clustered_layout(star: Star) -> DataFrame:
    return tables.clustered(star.lines().select("transaction_id", "product_key", "location_key", "day", "quantity"), ["day", "product_key"])


@query("T11_snapshot_diff", """
    with o as (select c_custkey, c_mktsegment, c_acctbal from customer where c_custkey % 19 <> 0),
    n as (select c_custkey, case when c_custkey % 10 = 0 then 'MOVED' else c_mktsegment end as c_mktsegment, c_acctbal from customer where c_custkey % 17 <> 0)
    select coalesce(n.c_custkey, o.c_custkey) as c_custkey, case when o.c_custkey is null then 'insert' when n.c_custkey is null then 'delete' else 'update' end as change_type,
      coalesce(n.c_mktsegment, o.c_mktsegment) as c_mktsegment, coalesce(n.c_acctbal, o.c_acctbal) as c_acctbal
    from o full outer join n on o.c_custkey = n.c_custkey
    where o.c_custkey is null or n.c_custkey is null or o.c_mktsegment <> n.c_mktsegment""")
def snapshot_diff(star: Star) -> DataFrame:
    c = star.raw("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    moved = F.when(F.col("c_custkey") % 10 == 0, "MOVED").otherwise(F.col("c_mktsegment"))
    return tables.snapshot_diff(c.where("c_custkey % 19 <> 0"), c.where("c_custkey % 17 <> 0").withColumn("c_mktsegment", moved), ["c_custkey"])


def _order_versions(star: Star) -> tuple[DataFrame, DataFrame]:
    """Orders before and after a load that touched one month."""
    o = star.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"))
    k, month = F.col("o_orderkey"), F.col("o_orderdate").between("1996-03-01", "1996-03-31")
    old = o.where(~(month & (k % 11 == 0)))
    status = F.when(month & (k % 5 == 0), "X").otherwise(F.col("o_orderstatus"))
    return old, o.where(~(month & (k % 7 == 0))).withColumn("o_orderstatus", status)


_VERSIONS = """with o as (select o_orderkey, o_custkey, o_orderstatus, cast(o_orderdate as date) as o_orderdate,
      cast(o_orderdate as date) between date '1996-03-01' and date '1996-03-31' as m from orders),
    a as (select * from o where not (m and o_orderkey % 11 = 0)),
    b as (select o_orderkey, o_custkey, case when m and o_orderkey % 5 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_orderdate
      from o where not (m and o_orderkey % 7 = 0))"""


@query("T11_change_feed", _VERSIONS + """ select coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey,
      case when a.o_orderkey is null then 'insert' when b.o_orderkey is null then 'delete' else 'update' end as change_type,
      coalesce(b.o_custkey, a.o_custkey) as o_custkey, coalesce(b.o_orderstatus, a.o_orderstatus) as o_orderstatus,
      coalesce(b.o_orderdate, a.o_orderdate) as o_orderdate
    from a full outer join b on a.o_orderkey = b.o_orderkey
    where a.o_orderkey is null or b.o_orderkey is null or a.o_orderstatus <> b.o_orderstatus""")
def change_feed(star: Star) -> DataFrame:
    """Change feed by month: only months whose sums differ are joined row by row."""
    old, new = _order_versions(star)
    return tables.change_feed(old, new, ["o_orderkey"], F.trunc("o_orderdate", "MM"))


@query("T11_changed_months", _VERSIONS + """ select distinct date_trunc('month', coalesce(b.o_orderdate, a.o_orderdate))::date as part
    from a full outer join b on a.o_orderkey = b.o_orderkey
    where a.o_orderkey is null or b.o_orderkey is null or a.o_orderstatus <> b.o_orderstatus""")
def changed_months(star: Star) -> DataFrame:
    """Months to refresh: one aggregate a side."""
    return tables.parts_changed(*_order_versions(star), F.trunc("o_orderdate", "MM"))


@query("T12_count_check", """
    with e as (select 'customer' as t, count(distinct o_custkey) as n from orders union all select 'part', count(distinct l_partkey) from lineitem
      union all select 'orders', count(distinct l_orderkey) from lineitem union all select 'labels', count(*) from documents union all select 'missing', count(*) from pages),
    a as (select 'customer' as t, count(*) as n from customer union all select 'part', count(*) from part union all select 'orders', count(*) from orders
      union all select 'labels', count(*) from labels)
    select t as table_name, e.n as expected_count, coalesce(a.n, 0) as record_count, case when coalesce(a.n, 0) = 0 then 'EMPTY' when a.n < e.n * 0.8e0 then 'LOW'
      when a.n > e.n * 1.2e0 then 'HIGH' else 'OK' end as status from e left join a using (t)""")
def count_check(star: Star) -> DataFrame:
    """Tables against the number of their keys that other tables refer to, at any scale."""
    def counts(name: str, parts: dict[str, DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias(name)).select(F.lit(t).alias("table_name"), name) for t, df in parts.items()])

    used = {"customer": ("orders", "o_custkey"), "part": ("lineitem", "l_partkey"), "orders": ("lineitem", "l_orderkey")}
    expected = counts("expected_count", {**{t: star.raw(by).select(key).distinct() for t, (by, key) in used.items()},
                                         "labels": star.raw("documents"), "missing": star.raw("pages")})
    return tables.check_counts(counts("record_count", {t: star.raw(t) for t in ("customer", "part", "orders", "labels")}), expected,
                               star.config.count_tolerance)


# -- writes and upkeep -----------------------------------------------------------------------------

@query("T02_overwrite_then_append", "select c_custkey, c_mktsegment from customer")
def overwrite_then_append(star: Star) -> DataFrame:
    """A first write replaces what is there, a second one adds."""
    out, c = scratch(star.spark, "written"), star.raw("customer").select("c_custkey", "c_mktsegment")
    tables.write(c, out)
    tables.write(c.where("c_custkey % 2 = 0"), out)
    tables.write(c.where("c_custkey % 2 <> 0"), out, mode="append")
    return tables.load(star.spark, out)


def _database(star: Star) -> str:
    """A database whose tables lie in the shared folder."""
    path = scratch(star.spark, "tables")
    name = "db_" + path.rsplit("-", 1)[1]
    star.spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    return name


def _save_star(star: Star) -> dict[str, str]:
    db = _database(star)
    names = {"customer_dim": star.customer(), "product_dim": star.product(), "sales_fact": star.sales()}
    for name, df in names.items():
        df.write.mode("overwrite").saveAsTable(f"{db}.{name}")
    return {name: f"{db}.{name}" for name in names}


@query("T05_backup", "select c_mktsegment as segment, count(*) as customers from customer group by 1")
def backup(star: Star) -> DataFrame:
    """Copies outlive the tables they were taken from."""
    saved = _save_star(star)
    copies = tables.backup(star.spark, [saved["customer_dim"]], "_backup")
    star.spark.sql(f"DROP TABLE {saved['customer_dim']}")
    return star.spark.table(copies[0]).groupBy("segment").agg(F.count("*").alias("customers"))


@query("T06_drop_dependents_first", """select 'sales_fact' as table_name, 0 as position, count(*) as rows_dropped, false as is_left from lineitem join orders on l_orderkey = o_orderkey
    union all select 'customer_dim', 1, count(*), false from customer union all select 'product_dim', 2, count(*), false from part""")
def drop_dependents_first(star: Star) -> DataFrame:
    saved = _save_star(star)
    short = {full: name for name, full in saved.items()}
    rows = {full: star.spark.table(full).count() for full in short}
    order = tables.drop_tables(star.spark, list(short), {saved[t]: [saved[d] for d in needs if d in saved]
                                                        for t, needs in tables.DEPENDS_ON.items() if t in saved})
    done = [(short[full], i, rows[full], star.spark.catalog.tableExists(full)) for i, full in enumerate(order)]
    return tables.create(star.spark, done, "table_name string, position int, rows_dropped long, is_left boolean")


@query("T07_table_rows", " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in RAW))
def table_rows(star: Star) -> DataFrame:
    """Row counts of the table report, from the files."""
    return table_report(star).select("table_name", "row_count")


@query("T09_stage_log", """select 'customer_dim' as stage, 'done' as status, count(*) as rows_written, cast(1 as bigint) as runs from customer
    union all select 'product_dim', 'done', count(*), 2 from part union all select 'location_dim', 'done', count(*), 1 from supplier""")
def stage_log(star: Star) -> DataFrame:
    """Three stages, of which the second fails at first: a resumed run repeats it and skips what is done."""
    out = scratch(star.spark, "stages")
    log, runs = tables.StageLog(star.spark, f"{out}/log"), dict.fromkeys(("customer_dim", "product_dim", "location_dim"), 0)

    def stage(name: str, df: DataFrame, fails: bool) -> None:
        runs[name] += 1
        if fails:
            raise RuntimeError("a stage that fails")
        tables.write(df, f"{out}/{name}")

    for attempt in (1, 2):
        try:
            for name, df in (("customer_dim", star.customer()), ("product_dim", star.product()), ("location_dim", star.location())):
                log.run(name, lambda n=name, d=df: stage(n, d, attempt == 1 and n == "product_dim"))
        except RuntimeError:
            pass
    written = reduce(DataFrame.unionByName, [tables.load(star.spark, f"{out}/{n}").agg(F.count("*").alias("rows_written"))
                                             .select(F.lit(n).alias("stage"), "rows_written", F.lit(k).cast("long").alias("runs")) for n, k in runs.items()])
    return log.latest().select("stage", "status").join(written, "stage")


@query("T10_file_ranges", "select true as is_clustered, count(*) as rows_written from lineitem")
def file_ranges(star: Star) -> DataFrame:
    """Files of a clustered table cover ranges of days that do not overlap, so a scan of some days opens few of them."""
    out, parts = scratch(star.spark, "clustered"), int(star.spark.conf.get("spark.sql.shuffle.partitions"))
    tables.write(tables.clustered(star.lines().select("product_key", "location_key", "day", "quantity"), ["day", "product_key"], parts), out)
    key = F.struct("day", "product_key")
    files = tables.load(star.spark, out).groupBy(F.input_file_name().alias("file")).agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))
    before = F.lag("high").over(Window.partitionBy(F.lit(0)).orderBy("low", "high"))  # one row per file
    apart = files.withColumn("apart", F.coalesce(before < F.col("low"), F.lit(True)))
    return apart.agg(F.coalesce(F.every("apart"), F.lit(True)).alias("is_clustered"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_written"))


@query("T13_comments", """select * from (values ('customer_key', 'bigint', 'Key of the customer'), ('segment', 'string', 'Market segment'),
    ('ltv_cents', 'bigint', null)) c(column_name, data_type, comment), (select count(*) as rows_described from customer) n""")
def comments(star: Star) -> DataFrame:
    """Comments travel with the schema through a write."""
    out = scratch(star.spark, "described")
    c = star.customer().select("customer_key", "segment", "ltv_cents")
    tables.write(tables.describe(c, "Customers", {"customer_key": "Key of the customer", "segment": "Market segment"}), out)
    back = tables.load(star.spark, out)
    return tables.comment_report(star.spark, back).withColumn("rows_described", F.lit(back.count()))
