"""Inventory questions I01-I31."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfstar.functions.distinct import grouped
from shelfstar.functions.exprs import half_up
from shelfstar.functions.exprs import half_up_sql as r
from shelfstar.functions.exprs import money, stddev_sql, steady_avg, sum_long
from shelfstar.functions.exprs import steady_avg_sql as steady
from shelfstar.functions.ranking import percent_rank
from shelfstar.operators import facts, ledger
from shelfstar.operators.calendar import HOLIDAYS
from shelfstar.plans.customer import pct
from shelfstar.plans.metric_views import ACTIVE, COST, DUE, RETAIL, count_if
from shelfstar.plans.registry import query, report
from shelfstar.plans.report import Report, for_check, relation
from shelfstar.sources.tables import cut
from shelfstar.star import Star

NAMES = {"product_name": "product_name", "location_name": "location_name"}
POS = ["product_key", "location_key"]


def cols(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def cost(x: str) -> str:
    return f"({x} / 1e2)"


def ratio(a: Column, b: Column, scale: float = 100.0) -> Column:
    return a * scale / F.nullif(b, F.lit(0))


report("I01_health_dashboard", Report(
    "inv location product", cols("category_level_1", "category_level_2", "location_type", "region"),
    {"total_skus": "count(*)", "unique_products": "count(distinct product_key)", "total_units_on_hand": sum_long("quantity_on_hand"),
     "total_available_units": sum_long("quantity_available"), "total_cost_value": money(COST), "total_retail_value": money(RETAIL),
     "total_markup_value": money(f"{RETAIL} - {COST}"), "stockout_count": count_if("is_stockout"), "overstock_count": count_if("is_overstock"),
     "reorder_needed_count": count_if("quantity_available <= reorder_point"),
     "stockout_rate_pct": pct(count_if("is_stockout"), "count(*)", 2), "overstock_rate_pct": pct(count_if("is_overstock"), "count(*)", 2),
     "availability_rate_pct": pct("sum(quantity_available)", "sum(quantity_on_hand)", 2),
     "avg_days_supply": r("avg(days_of_supply)", 1), "avg_stock_cover": r("avg(stock_cover_days)", 1)}, ACTIVE))


def band(name: str, high: str, mid: str, low: str) -> str:
    return f"case when {name} >= 0.8e0 then '{high}' when {name} >= 0.5e0 then '{mid}' else '{low}' end"


# Published bands and labels.
_ABC = [band("rp", "A - High Revenue", "B - Medium Revenue", "C - Low Revenue"), band("tp", "Fast Moving", "Medium Moving", "Slow Moving"),
        band("ip", "High Investment", "Medium Investment", "Low Investment")]


@query("I02_abc_classification", for_check(f"""
    with base as (select product_key, coalesce(sum(s.net_cents), 0) as rev, coalesce(sum(s.quantity), 0) as sold,
        sum(i.quantity_on_hand * unit_cost_cents) as cost, sum(i.quantity_on_hand) as units
      from product_d p join inv i using (product_key)
      left join (select * from lines where not is_return and day >= {{asof}} - 90) s using (product_key)
      where product_active group by 1),
    k as (select *, case when cost > 0 then rev * 365e0 / (90 * cost) else 0e0 end as turns,
        case when units > 0 then sold * 365e0 / (90 * units) else 0e0 end as velocity from base),
    p as (select *, percent_rank() over (order by rev desc) as rp, percent_rank() over (order by cost desc) as ip,
        percent_rank() over (order by turns desc) as tp from k)
    select {_ABC[0]} as abc_revenue_class, {_ABC[1]} as velocity_class, {_ABC[2]} as investment_class, count(*) as product_count,
      sum(rev) / 1e2 as total_revenue, sum(cost) / 1e2 as total_investment, cast(sum(sold) as bigint) as total_units_sold,
      cast(sum(units) as bigint) as total_units_on_hand, {r(steady('turns'), 6)} as avg_turnover_ratio, {r(steady('velocity'), 6)} as avg_velocity,
      {r('sum(rev) * 1e2 / sum(sum(rev)) over ()', 2)} as revenue_share_pct,
      {r('sum(cost) * 1e2 / sum(sum(cost)) over ()', 2)} as investment_share_pct
    from p group by 1, 2, 3"""))
def abc_classification(star: Star) -> DataFrame:
    """Sales and stock are summed per product before they meet; each side is weighted by the number of
    rows on the other, which is what joining the row sets would give. Ranks are built per value block."""
    zero = F.lit(0).cast("long")
    sold = (star.lines(star.days_back(90)).where(~F.col("is_return")).groupBy("product_key")
            .agg(F.sum("net_cents").alias("r"), F.sum("quantity").alias("q"), F.count("*").alias("n")))
    stock = ledger.positions(star).groupBy("product_key").agg(F.sum("quantity_on_hand").alias("u"), F.count("*").alias("m"))
    times = F.greatest(F.coalesce("n", zero), F.lit(1))
    base = (star.product().where("product_active").select("product_key", "unit_cost_cents")
            .join(stock, "product_key").join(sold, "product_key", "left")
            .select("product_key", (F.coalesce("r", zero) * F.col("m")).alias("rev"), (F.coalesce("q", zero) * F.col("m")).alias("sold"),
                    (F.col("u") * F.col("unit_cost_cents") * times).alias("cost"), (F.col("u") * times).alias("units")))
    base = base.withColumn("turns", F.when(F.col("cost") > 0, F.col("rev") * 365.0 / F.nullif(90 * F.col("cost"), zero)).otherwise(F.lit(0.0)))
    base = base.withColumn("velocity", F.when(F.col("units") > 0, F.col("sold") * 365.0 / F.nullif(90 * F.col("units"), zero)).otherwise(F.lit(0.0)))
    base = cut(base.select("*", *[(-F.col(c)).alias(f"_{c}") for c in ("rev", "cost", "turns")]), "products")
    ranked = base
    for name, out in (("_rev", "rp"), ("_cost", "ip"), ("_turns", "tp")):
        ranked = percent_rank(ranked, name, out, base)
    total = base.agg(F.sum("rev").alias("rev"), F.sum("cost").alias("cost")).first()
    return ranked.groupBy(*[F.expr(e).alias(n) for e, n in zip(_ABC, ("abc_revenue_class", "velocity_class", "investment_class"))]).agg(
        F.count("*").alias("product_count"), (F.sum("rev") / 100.0).alias("total_revenue"), (F.sum("cost") / 100.0).alias("total_investment"),
        F.sum("sold").alias("total_units_sold"), F.sum("units").alias("total_units_on_hand"),
        half_up(steady_avg(F.col("turns")), 6).alias("avg_turnover_ratio"), half_up(steady_avg(F.col("velocity")), 6).alias("avg_velocity"),
        half_up(F.sum("rev") * 100.0 / F.lit(total.rev), 2).alias("revenue_share_pct"),
        half_up(F.sum("cost") * 100.0 / F.lit(total.cost), 2).alias("investment_share_pct"))


_FLOW = """case when from_location_type is null then 'External' else from_location_type end || ' → ' ||
    case when to_location_type is null then 'External' else to_location_type end as movement_flow,
  coalesce(from_region, 'External') || ' → ' || coalesce(to_region, 'External') as region_flow"""


@query("I03_movement_flow", for_check(f"""
    with g as (select movement_type, movement_type || '_reason_' || (transaction_id % 5 + 1) as movement_reason, month(day) as m,
        a.location_type as from_location_type, a.region as from_region, b.location_type as to_location_type, b.region as to_region,
        category_level_1, category_level_2, price_tier, count(*) as n, sum(quantity) as units, sum(total_cents) as cents,
        avg(quantity) as size
      from moves join product_d using (product_key) left join location_d a on from_location_key = a.location_key
      left join location_d b on to_location_key = b.location_key where day >= {{asof}} - 90
      group by 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
    select movement_type, movement_reason, {_FLOW}, category_level_1, price_tier, cast(sum(n) as bigint) as total_movements,
      cast(sum(units) as bigint) as total_units, sum(cents) / 1e2 as total_value, {r(steady('size'), 1)} as avg_units_per_movement,
      {r('sum(units) * 1e0 / nullif(sum(n), 0)', 1)} as units_per_transaction,
      {r('sum(cents) / 1e2 / nullif(sum(units), 0)', 2)} as avg_unit_value
    from g group by 1, 2, 3, 4, 5, 6 having sum(n) > 5 order by total_value desc, 1, 2, 3, 4, 5, 6 limit 250"""))
def movement_flow(star: Star) -> DataFrame:
    """Movements are cut down to keys and sums first; names are attached to the aggregate."""
    loc = star.location().select("location_key", "location_type", "region")
    part = star.product().select("product_key", "category_level_1", "category_level_2", "price_tier")

    def side(prefix: str) -> DataFrame:
        return loc.select(*[F.col(c).alias(f"{prefix}_{c}") for c in loc.columns])

    per = (ledger.movements(star, star.days_back(90))
           .join(part, "product_key").join(side("from"), "from_location_key", "left").join(side("to"), "to_location_key", "left")
           .groupBy("movement_type", "movement_reason", F.month("day").alias("m"), "from_location_type", "from_region", "to_location_type",
                    "to_region", "category_level_1", "category_level_2", "price_tier")
           .agg(F.count("*").alias("n"), F.sum("quantity").alias("units"), F.sum("total_cents").alias("cents"), F.avg("quantity").alias("size")))
    ext = F.lit("External")
    flow = F.concat(F.coalesce("from_location_type", ext), F.lit(" → "), F.coalesce("to_location_type", ext))
    regions = F.concat(F.coalesce("from_region", ext), F.lit(" → "), F.coalesce("to_region", ext))
    keys = ["movement_type", "movement_reason", "movement_flow", "region_flow", "category_level_1", "price_tier"]
    n, u, c = F.sum("n"), F.sum("units"), F.sum("cents")
    return (per.withColumn("movement_flow", flow).withColumn("region_flow", regions).groupBy(*keys).agg(
        n.alias("total_movements"), u.alias("total_units"), (c / 100.0).alias("total_value"),
        half_up(steady_avg(F.col("size")), 1).alias("avg_units_per_movement"), half_up(ratio(u, n, 1.0), 1).alias("units_per_transaction"),
        half_up(c / 100.0 / F.nullif(u, F.lit(0)), 2).alias("avg_unit_value"))
        .where("total_movements > 5").orderBy(F.desc("total_value"), *keys).limit(250))


def of_type(kind: str, x: str = "quantity") -> str:
    return f"sum(case when movement_type = '{kind}' then {x} end)"


@query("I04_supply_chain_efficiency", for_check(f"""
    with m as (select category_level_1, category_level_2, brand, location_type, region,
        count(*) filter (where movement_type = 'receipt') as receipts_count, cast({of_type('receipt')} as bigint) as total_received_units,
        count(*) filter (where movement_type = 'transfer') as transfers_count, cast({of_type('transfer')} as bigint) as total_transferred_units,
        count(*) filter (where movement_type = 'return') as returns_count, cast({of_type('return')} as bigint) as total_returned_units,
        count(*) filter (where movement_type = 'adjustment') as adjustments_count, cast({of_type('adjustment', 'abs(quantity)')} as bigint) as total_adjusted_units,
        sum(case when movement_type = 'adjustment' and quantity > 0 then quantity else 0 end) as up,
        sum(case when movement_type = 'adjustment' and quantity < 0 then -quantity else 0 end) as down
      from moves join product_d using (product_key) left join location_d on to_location_key = location_key
      where day >= {{asof}} - 90 group by 1, 2, 3, 4, 5)
    select category_level_1, category_level_2, location_type, region, receipts_count, total_received_units, transfers_count,
      total_transferred_units, returns_count, total_returned_units, adjustments_count, total_adjusted_units,
      {pct('up', 'total_adjusted_units', 1)} as positive_adj_pct, {pct('down', 'total_adjusted_units', 1)} as negative_adj_pct,
      {pct('total_returned_units', 'total_transferred_units', 2)} as return_rate_pct,
      {pct('total_adjusted_units', 'total_received_units', 2)} as adjustment_rate_pct
    from m where receipts_count > 0 or transfers_count > 0"""))
def supply_chain_efficiency(star: Star) -> DataFrame:
    part = star.product().select("product_key", "category_level_1", "category_level_2", "brand")
    to = star.location().select(F.col("location_key").alias("to_location_key"), "location_type", "region")
    kind, q = F.col("movement_type"), F.col("quantity")

    def count(k: str):
        return F.count(F.when(kind == k, 1))

    def units(k: str):
        return F.sum(F.when(kind == k, F.abs(q)))

    m = (ledger.movements(star, star.days_back(90)).join(part, "product_key").join(to, "to_location_key", "left")
         .groupBy("category_level_1", "category_level_2", "brand", "location_type", "region").agg(
             count("receipt").alias("receipts_count"), units("receipt").alias("total_received_units"),
             count("transfer").alias("transfers_count"), units("transfer").alias("total_transferred_units"),
             count("return").alias("returns_count"), units("return").alias("total_returned_units"),
             count("adjustment").alias("adjustments_count"), units("adjustment").alias("total_adjusted_units"),
             F.sum(F.when((kind == "adjustment") & (q > 0), q).otherwise(F.lit(0))).alias("up"),
             F.sum(F.when((kind == "adjustment") & (q < 0), -q).otherwise(F.lit(0))).alias("down")))
    c = F.col
    return m.where((c("receipts_count") > 0) | (c("transfers_count") > 0)).select(
        "category_level_1", "category_level_2", "location_type", "region", "receipts_count", "total_received_units", "transfers_count",
        "total_transferred_units", "returns_count", "total_returned_units", "adjustments_count", "total_adjusted_units",
        half_up(ratio(c("up"), c("total_adjusted_units")), 1).alias("positive_adj_pct"),
        half_up(ratio(c("down"), c("total_adjusted_units")), 1).alias("negative_adj_pct"),
        half_up(ratio(c("total_returned_units"), c("total_transferred_units")), 2).alias("return_rate_pct"),
        half_up(ratio(c("total_adjusted_units"), c("total_received_units")), 2).alias("adjustment_rate_pct"))


@query("I05_location_performance", for_check(f"""
    with i as (select location_key, count(distinct product_key) as products, sum(quantity_on_hand) as units, sum(quantity_available) as avail,
        sum({COST}) as cost, sum({RETAIL}) as retail, count(*) filter (where is_stockout) as outs, count(*) filter (where is_overstock) as overs,
        avg(days_of_supply) as supply from inv join product_d using (product_key) group by 1),
    s as (select location_key, count(distinct transaction_id) as txns, sum(net_cents) as rev, sum(quantity) as sold,
        count(distinct customer_key) as people from sales where not is_return and day >= {{asof}} - 30 group by 1),
    m as (select coalesce(to_location_key, from_location_key) as location_key, count(to_location_key) as n_in, count(from_location_key) as n_out,
        sum(case when to_location_key is not null then quantity else 0 end) as u_in,
        sum(case when from_location_key is not null then quantity else 0 end) as u_out from moves where day >= {{asof}} - 30 group by 1)
    select location_name, location_type, region, coalesce(products, 0) as unique_products_stocked, cast(units as bigint) as total_units_on_hand, cost / 1e2 as inventory_investment,
      retail / 1e2 as inventory_retail_value, coalesce(outs, 0) as stockout_skus, coalesce(overs, 0) as overstock_skus, {pct('outs', 'products', 1)} as stockout_rate_pct,
      {pct('overs', 'products', 1)} as overstock_rate_pct, {r('supply', 1)} as avg_days_supply, coalesce(txns, 0) as sales_transactions,
      coalesce(rev, 0) / 1e2 as sales_revenue_30d, cast(coalesce(sold, 0) as bigint) as units_sold_30d, coalesce(people, 0) as customers_30d,
      coalesce(n_in + n_out, 0) as total_movements_30d, cast(coalesce(u_in + u_out, 0) as bigint) as total_units_moved_30d,
      case when selling_sqft > 0 then {r('coalesce(rev, 0) / 1e2 / selling_sqft', 2)} end as revenue_per_sqft_30d,
      case when cost > 0 then {r('coalesce(rev, 0) * 365e0 / (30 * cost)', 2)} end as inventory_turns_annualized,
      {pct('coalesce(sold, 0)', 'avail', 2)} as sell_through_rate_30d_pct
    from location_d left join i using (location_key) left join s using (location_key) left join m using (location_key)
    where location_active"""))
def location_performance(star: Star) -> DataFrame:
    """Three aggregates on the location key, joined to the dimension."""
    part = star.product().select("product_key", "unit_cost_cents", "price_cents")
    i = (ledger.positions(star).join(part, "product_key").groupBy("location_key").agg(
        F.countDistinct("product_key").alias("products"), F.sum("quantity_on_hand").alias("units"), F.sum("quantity_available").alias("avail"),
        F.sum(F.expr(COST)).alias("cost"), F.sum(F.expr(RETAIL)).alias("retail"), F.count(F.when(F.col("is_stockout"), 1)).alias("outs"),
        F.count(F.when(F.col("is_overstock"), 1)).alias("overs"), F.avg("days_of_supply").alias("supply")))
    s = grouped(star.sales(star.days_back(30)).where(~F.col("is_return")), {"location_key": F.col("location_key")}, {
        "txns": "count(distinct transaction_id)", "rev": "sum(net_cents)", "sold": "sum(quantity)", "people": "count(distinct customer_key)"})
    to, src, q = F.col("to_location_key"), F.col("from_location_key"), F.col("quantity")
    m = (ledger.movements(star, star.days_back(30))
         .groupBy(F.coalesce(to, src).alias("location_key")).agg(
             (F.count(to) + F.count(src)).alias("moves"),
             F.sum(F.when(to.isNotNull(), q).otherwise(F.lit(0)) + F.when(src.isNotNull(), q).otherwise(F.lit(0))).alias("moved")))
    z, c = F.lit(0).cast("long"), F.col
    rev = F.coalesce("rev", z)
    kind = c("location_type")
    order = F.when(kind == "store", 1).when(kind == "warehouse", 2).when(kind == "dc", 3).otherwise(4)
    return (star.location().where("location_active").join(i, "location_key", "left").join(s, "location_key", "left").join(m, "location_key", "left")
            .orderBy(order, rev.desc(), "location_key").select(
                "location_name", "location_type", "region", F.coalesce("products", z).alias("unique_products_stocked"),
                c("units").alias("total_units_on_hand"), (c("cost") / 100.0).alias("inventory_investment"),
                (c("retail") / 100.0).alias("inventory_retail_value"), F.coalesce("outs", z).alias("stockout_skus"),
                F.coalesce("overs", z).alias("overstock_skus"), half_up(ratio(c("outs"), c("products")), 1).alias("stockout_rate_pct"),
                half_up(ratio(c("overs"), c("products")), 1).alias("overstock_rate_pct"), half_up(c("supply"), 1).alias("avg_days_supply"),
                F.coalesce("txns", z).alias("sales_transactions"), (rev / 100.0).alias("sales_revenue_30d"),
                F.coalesce("sold", z).alias("units_sold_30d"), F.coalesce("people", z).alias("customers_30d"),
                F.coalesce("moves", z).alias("total_movements_30d"), F.coalesce("moved", z).alias("total_units_moved_30d"),
                half_up(rev / 100.0 / F.nullif("selling_sqft", z), 2).alias("revenue_per_sqft_30d"),
                F.when(c("cost") > 0, half_up(rev * 365.0 / F.nullif(30 * c("cost"), z), 2)).alias("inventory_turns_annualized"),
                half_up(ratio(F.coalesce("sold", z), c("avail")), 2).alias("sell_through_rate_30d_pct")))


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_DIST = Report(
    "inv location product", cols("product_key", "category_level_2", "price_tier"),
    {**{f"{t}_q": sum_long(f"case when location_type = '{t}' then quantity_on_hand else 0 end") for t in ("store", "warehouse", "dc")},
     **{f"r{i}": sum_long(f"case when region = '{x}' then quantity_on_hand else 0 end") for i, x in enumerate(REGIONS)},
     "total": sum_long("quantity_on_hand"), "stocked": "count(distinct case when quantity_on_hand > 0 then location_key end)",
     "locations": "count(distinct location_key)", "top": "max(quantity_on_hand)", "retail": sum_long(RETAIL),
     "spread": stddev_sql("quantity_on_hand")}, ACTIVE, having="total > 0",
    post={"store_pct": pct("store_q", "total", 1), "warehouse_pct": pct("warehouse_q", "total", 1), "dc_pct": pct("dc_q", "total", 1),
          "imbalance": "(sqrt(" + " + ".join(f"(r{i} - total / 5e0) * (r{i} - total / 5e0)" for i in range(5)) + ") / (total / 5e0))",
          "coverage": pct("stocked", "locations", 1), "concentration": pct("top", "total", 1)})
_DIST_AGG = {"product_count": "count(*)", "total_units": sum_long("total"), "total_value": money("retail"),
             "avg_store_pct": r(steady("store_pct"), 1), "avg_warehouse_pct": r(steady("warehouse_pct"), 1), "avg_dc_pct": r(steady("dc_pct"), 1),
             "avg_location_coverage_pct": r(steady("coverage"), 1), "avg_regional_imbalance": r(steady("imbalance"), 2),
             "avg_max_concentration_pct": r(steady("concentration"), 1), "low_coverage_products": count_if("coverage < 50"),
             "high_concentration_products": count_if("concentration > 50"), "imbalanced_products": count_if("imbalance > 1.5e0")}


@query("I06_cross_location_distribution", "select category_level_2, price_tier, " + ", ".join(f"{x} as {n}" for n, x in _DIST_AGG.items())
       + f" from ({_DIST.sql()}) t group by 1, 2 having count(*) >= 5")
def cross_location_distribution(star: Star) -> DataFrame:
    """Regional pivot per product, then shares and imbalance per category."""
    return (_DIST.frame(star).groupBy("category_level_2", "price_tier").agg(*[F.expr(x).alias(n) for n, x in _DIST_AGG.items()])
            .where("product_count >= 5"))


GAP = "(forecast_quantity - actual_quantity)"
report("I07_forecast_accuracy", Report(
    "forecast product location", cols("category_level_1", "category_level_2", "location_type", "region"),
    {"forecast_count": "count(*)", "forecasts_with_actuals": "count(actual_quantity)", "total_forecasted": sum_long("forecast_quantity"),
     "total_actual": sum_long("actual_quantity"),
     "total_bias_pct": r("(sum(forecast_quantity) - sum(actual_quantity)) * 1e2 / nullif(sum(actual_quantity), 0)", 1),
     "mae": r(f"avg(abs({GAP}))", 2), "mean_bias": r(steady("bias"), 2), "mape_pct": r(steady("mape"), 1),
     "rmse": r(f"sqrt(avg({GAP} * {GAP}))", 2), "avg_accuracy_pct": r(steady("forecast_accuracy"), 1),
     "ci_hit_rate_pct": r(f"{count_if('actual_quantity between confidence_lower and confidence_upper')} * 1e2 / count(*)", 1),
     "directional_accuracy_pct": r(f"{count_if('(forecast_quantity > 0) = (actual_quantity > 0)')} * 1e2 / count(*)", 1)},
    "actual_quantity is not null", since=90, having="forecasts_with_actuals >= 5"))

# Published bands and labels.
RISK = ("case when is_stockout then 'CRITICAL - Stockout' when quantity_available <= reorder_point then 'HIGH - Below Reorder Point' "
        "when days_of_supply <= 7 then 'MEDIUM - Low Stock' when is_overstock then 'LOW - Overstock' else 'NORMAL' end")
_ORDER = ("case when quantity_available <= reorder_point and coalesce(velocity, 0) > 0 then reorder_quantity when is_stockout "
          "then greatest(reorder_quantity, coalesce(demand, 0) * 2) else 0 end")
# Published bands and labels.
_TREND = ("case when coalesce(u7, 0) * 428 > coalesce(u30, 0) * 120 then 'ACCELERATING' when coalesce(u7, 0) * 428 < coalesce(u30, 0) * 80 "
          "then 'DECELERATING' else 'STABLE' end")
_PLAN_COLS = f"""product_name, location_name, location_type, region, category_level_2, quantity_on_hand, quantity_available, quantity_in_transit,
    days_of_supply, risk_level, coalesce(u30, 0) as units_sold_30d, {r('coalesce(velocity, 0e0)', 2)} as avg_daily_sales,
    {r('coalesce(daily_demand, 0e0)', 2)} as forecasted_daily_demand, velocity_trend, recommended_order_quantity,
    recommended_order_quantity * unit_cost_cents / 1e2 as recommended_order_value, {COST} / 1e2 as current_investment,
    {r('case when velocity > 0 then (price_cents - unit_cost_cents) * velocity * 30 / 1e2 else 0e0 end', 2)} as potential_monthly_margin"""
_PLAN_KEEP = ("risk_level in ('CRITICAL - Stockout', 'HIGH - Below Reorder Point', 'MEDIUM - Low Stock') or recommended_order_quantity > 0 "
              "or velocity_trend = 'ACCELERATING'")
_PLAN_ORDER = "case risk_level when 'CRITICAL - Stockout' then 1 when 'HIGH - Below Reorder Point' then 2 when 'MEDIUM - Low Stock' then 3 else 4 end"


@query("I08_planning_recommendations", for_check(f"""
    with v as (select product_key, location_key, cast(sum(quantity) as bigint) as u30, avg(quantity) as velocity,
        cast(coalesce(sum(quantity) filter (where day >= {{asof}} - 7), 0) as bigint) as u7
      from lines where not is_return and day >= {{asof}} - 30 group by 1, 2),
    d as (select product_key, location_key, avg(forecast_quantity) as daily_demand, cast(sum(forecast_quantity) as bigint) as demand from forecast
      where day between {{asof}} and {{asof}} + 7 group by 1, 2),
    p as (select *, {RISK} as risk_level, {_ORDER} as recommended_order_quantity, {_TREND} as velocity_trend
      from inv join product_d using (product_key) join location_d using (location_key) left join v using (product_key, location_key)
      left join d using (product_key, location_key) where {ACTIVE}),
    o as (select product_key, location_key, {_PLAN_ORDER} as o, {_PLAN_COLS} from p where {_PLAN_KEEP})
    select * exclude (product_key, location_key, o) from o order by o, potential_monthly_margin desc, product_key, location_key limit 100"""))
def planning_recommendations(star: Star) -> DataFrame:
    sold = star.lines(star.days_back(30)).where(~F.col("is_return")).groupBy(*POS).agg(
        F.sum("quantity").alias("u30"), F.avg("quantity").alias("velocity"),
        F.sum(F.when(F.col("day") >= F.lit(star.days_back(7)), F.col("quantity")).otherwise(F.lit(0))).alias("u7"))
    week = facts.forecast(star).where(F.col("day").between(F.lit(star.as_of), F.lit(star.as_of + dt.timedelta(days=7))))
    demand = week.groupBy(*POS).agg(F.avg("forecast_quantity").alias("daily_demand"), F.sum("forecast_quantity").alias("demand"))
    plan = (relation(star, "inv product location").where(ACTIVE).join(sold, POS, "left").join(demand, POS, "left")
            .withColumn("risk_level", F.expr(RISK)).withColumn("recommended_order_quantity", F.expr(_ORDER))
            .withColumn("velocity_trend", F.expr(_TREND)).where(_PLAN_KEEP))
    out = plan.selectExpr(*POS, f"{_PLAN_ORDER} as o", *[x.strip() for x in _split(_PLAN_COLS)])
    return out.orderBy("o", F.desc("potential_monthly_margin"), *POS).limit(100).drop("o", *POS)


def _split(text: str) -> list[str]:
    """Top-level comma split of a select list."""
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur]


IS_HOLIDAY = "(month(day) * 100 + dayofmonth(day)) in (" + ", ".join(str(m * 100 + d) for m, d in HOLIDAYS.values()) + ")"
FISCAL_QUARTER = "cast((month(day) + 10) % 12 div 3 + 1 as int)"
_MICRO = "cast(floor({} * 1e0 / count(*) * 1e6) as bigint)"


@query("I09_stockout_impact", for_check(f"""
    with spans as (select product_key, location_key, greatest(a, {{asof}} - 90) as a, least(b, {{asof}}) as b from
        (select product_key, location_key, day as a, coalesce(next_day - 1, {{asof}}) as b, stock_end as stock from walk where day <= {{asof}}
         union all select product_key, location_key, (select d0 from horizon), min(day) - 1, any_value(opening) from walk where day <= {{asof}} group by 1, 2) t
        where stock = 0 and a <= b and b >= {{asof}} - 90 and a <= {{asof}}),
    outs as (select product_key, location_key, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from spans),
    pre as (select product_key, location_key, {_MICRO.format('sum(quantity)')} as u, {_MICRO.format('sum(net_cents)')} as c from lines
        where not is_return and day >= {{asof}} - 120 and day < {{asof}} - 90 group by 1, 2)
    select category_level_2, location_type, region, fiscal_quarter, n as stockout_days, products as products_with_stockouts,
      locs as locations_with_stockouts, pairs as unique_product_location_stockouts, {r('weekend * 1e2 / n', 1)} as weekend_stockout_pct,
      {r('holiday * 1e2 / n', 1)} as holiday_stockout_pct, {r('u / 1e6', 0)} as est_lost_units, {r('c / 1e8', 2)} as est_lost_revenue,
      {r('retail / 1e8', 2)} as est_lost_retail_value, {r('u / 1e6 / n', 1)} as avg_lost_units_per_day, {r('c / 1e8 / n', 2)} as avg_lost_revenue_per_day
    from (select category_level_2, brand, location_type, region, {FISCAL_QUARTER} as fiscal_quarter, count(*) as n,
            count(distinct product_key) as products, count(distinct location_key) as locs, count(distinct (product_key, location_key)) as pairs,
            count(*) filter (where isodow(day) >= 6) as weekend, count(*) filter (where {IS_HOLIDAY}) as holiday,
            coalesce(sum(u), 0) as u, coalesce(sum(c), 0) as c, coalesce(sum(u * price_cents), 0) as retail
          from outs join product_d using (product_key) join location_d using (location_key) left join pre using (product_key, location_key)
          where product_active group by 1, 2, 3, 4, 5) t"""))
def stockout_impact(star: Star) -> DataFrame:
    """Stockout days come from the run-length states that touch the window and are counted per position
    and quarter before anything is joined; the sales rate before the window is kept in millionths, so the
    totals are exact integer sums."""
    first = star.days_back(90)
    outs = (ledger.intervals(star).where((F.col("stock") == 0) & (F.col("last_day") >= F.lit(first)))
            .select(*POS, F.explode(F.sequence(F.greatest("first_day", F.lit(first)), "last_day")).alias("day"))
            .groupBy(*POS, F.expr(FISCAL_QUARTER).alias("fiscal_quarter")).agg(
                F.count("*").alias("n"), F.count(F.when(F.weekday("day") >= 5, 1)).alias("weekend"),
                F.count(F.when(F.expr(IS_HOLIDAY), 1)).alias("holiday")))
    pre = (star.lines(star.days_back(120), star.days_back(91)).where(~F.col("is_return")).groupBy(*POS).agg(
        F.expr(_MICRO.format("sum(quantity)")).alias("u"), F.expr(_MICRO.format("sum(net_cents)")).alias("c")))
    part = star.product().where("product_active").select("product_key", "category_level_2", "brand", "price_cents")
    loc = star.location().select("location_key", "location_type", "region")
    g = (outs.join(part, "product_key").join(loc, "location_key").join(pre, POS, "left")
         .groupBy("category_level_2", "brand", "location_type", "region", "fiscal_quarter").agg(
             F.sum("n").alias("n"), F.countDistinct("product_key").alias("products"), F.countDistinct("location_key").alias("locs"),
             F.count("*").alias("pairs"), F.sum("weekend").alias("weekend"), F.sum("holiday").alias("holiday"),
             F.coalesce(F.sum(F.col("n") * F.col("u")), F.lit(0)).alias("u"), F.coalesce(F.sum(F.col("n") * F.col("c")), F.lit(0)).alias("c"),
             F.coalesce(F.sum(F.col("n") * F.col("u") * F.col("price_cents")), F.lit(0)).alias("retail")))
    c, n = F.col, F.col("n")
    return g.select(
        "category_level_2", "location_type", "region", "fiscal_quarter", n.alias("stockout_days"), c("products").alias("products_with_stockouts"),
        c("locs").alias("locations_with_stockouts"), c("pairs").alias("unique_product_location_stockouts"),
        half_up(c("weekend") * 100.0 / n, 1).alias("weekend_stockout_pct"), half_up(c("holiday") * 100.0 / n, 1).alias("holiday_stockout_pct"),
        half_up(c("u") / 1e6, 0).alias("est_lost_units"), half_up(c("c") / 1e8, 2).alias("est_lost_revenue"),
        half_up(c("retail") / 1e8, 2).alias("est_lost_retail_value"), half_up(c("u") / 1e6 / n, 1).alias("avg_lost_units_per_day"),
        half_up(c("c") / 1e8 / n, 2).alias("avg_lost_revenue_per_day"))


_EOL = "case when end_of_life_date is not null then DAYS(end_of_life_date, {asof}) end"
# Published bands and labels.
_PRIORITY = ("case when days_until_eol <= 30 then 'URGENT - EOL Soon' when units_sold_30d = 0 then 'HIGH - No Sales 30d' "
             "when days_of_supply > 90 then 'HIGH - Excess Stock' when units_sold_7d = 0 and u14 > 0 then 'MEDIUM - Slowing' "
             "when is_overstock then 'MEDIUM - Overstock' else 'LOW' end")
# Published bands and labels.
_PRICE = ("price_cents * case when days_until_eol <= 30 then 40 when units_sold_30d = 0 then 50 when days_of_supply > 90 then 60 "
          "else 70 end / 1e4")
_QTY = "case when velocity > 0 then least(quantity_on_hand * 5e-1, velocity * 14) else quantity_on_hand * 3e-1 end"
_CLEAR = f"""product_name, category_level_2, location_name, location_type, region, quantity_on_hand, days_of_supply,
    {COST} / 1e2 as current_investment, {RETAIL} / 1e2 as current_retail_value, units_sold_30d, units_sold_7d,
    {r('velocity', 2)} as avg_daily_sales, days_since_launch, days_until_eol, season_code, clearance_priority,
    {r('qty', 0)} as recommended_clearance_qty, price_cents / 1e2 as current_price, {r('price', 2)} as recommended_clearance_price,
    {r('(price_cents / 1e2 - price) * 1e4 / price_cents', 0)} as discount_pct, {r('qty * price', 2)} as potential_clearance_revenue,
    {r('qty * (price - unit_cost_cents / 1e2)', 2)} as potential_margin, ({COST} - quantity_on_hand * unit_cost_cents) / 1e2 as carrying_cost_risk"""
_CLEAR_ORDER = ("case clearance_priority when 'URGENT - EOL Soon' then 1 when 'HIGH - No Sales 30d' then 2 when 'HIGH - Excess Stock' then 3 "
                "when 'MEDIUM - Slowing' then 4 when 'MEDIUM - Overstock' then 5 else 6 end")


@query("I10_overstock_clearance", for_check(f"""
    with s as (select product_key, location_key, cast(sum(quantity) as bigint) as u30, avg(quantity) as v,
        cast(coalesce(sum(quantity) filter (where day >= {{asof}} - 7), 0) as bigint) as u7, cast(coalesce(sum(quantity) filter (where day >= {{asof}} - 14), 0) as bigint) as u14
      from lines where not is_return and day >= {{asof}} - 30 group by 1, 2),
    a as (select * exclude (u14), coalesce(u30, 0) as units_sold_30d, coalesce(u7, 0) as units_sold_7d, coalesce(u14, 0) as u14,
        coalesce(v, 0e0) as velocity, DAYS({{asof}}, launch_date) as days_since_launch, {_EOL} as days_until_eol
      from inv join product_d using (product_key) join location_d using (location_key) left join s using (product_key, location_key)
      where product_active and (is_overstock or days_of_supply > 60 or (quantity_on_hand > 0 and u30 = 0))),
    b as (select *, {_PRIORITY} as clearance_priority, {_QTY} as qty, {_PRICE} as price from a),
    o as (select product_key, location_key, {_CLEAR_ORDER} as o, {_CLEAR} from b)
    select * exclude (product_key, location_key, o) from o order by o, carrying_cost_risk desc, product_key, location_key limit 100"""
    .replace("DAYS({asof}, launch_date)", "date_diff('day', launch_date, (select d from horizon))")))
def overstock_clearance(star: Star) -> DataFrame:
    def recent(days: int):
        return F.sum(F.when(F.col("day") >= F.lit(star.days_back(days)), F.col("quantity")).otherwise(F.lit(0)))

    s = star.lines(star.days_back(30)).where(~F.col("is_return")).groupBy(*POS).agg(
        F.sum("quantity").alias("u30"), F.avg("quantity").alias("v"), recent(7).alias("u7"), recent(14).alias("w14"))
    z, today = F.lit(0).cast("long"), F.lit(star.as_of)
    a = (relation(star, "inv product location").where("product_active").join(s, POS, "left")
         .where("is_overstock or days_of_supply > 60 or (quantity_on_hand > 0 and u30 = 0)")
         .withColumns({"units_sold_30d": F.coalesce("u30", z), "units_sold_7d": F.coalesce("u7", z), "u14": F.coalesce("w14", z),
                       "velocity": F.coalesce("v", F.lit(0.0)), "days_since_launch": F.datediff(today, "launch_date"),
                       "days_until_eol": F.datediff("end_of_life_date", today)})
         .withColumns({"clearance_priority": F.expr(_PRIORITY), "qty": F.expr(_QTY), "price": F.expr(_PRICE)}))
    out = a.selectExpr(*POS, f"{_CLEAR_ORDER} as o", *[x.strip() for x in _split(_CLEAR)])
    return out.orderBy("o", F.desc("carrying_cost_risk"), *POS).limit(100).drop("o", *POS)


_COMBO = ["category_level_1", "category_level_2", "brand", "price_tier", "location_type", "region"]
_FIN = f"""category_level_1, category_level_2, price_tier, location_type, region, cost / 1e2 as inventory_investment, retail / 1e2 as inventory_retail_value,
    (retail - cost) / 1e2 as inventory_markup_value, units as total_units_on_hand, products as unique_products, coalesce(rev, 0) / 1e2 as revenue_90d,
    coalesce(margin, 0) / 1e2 as gross_margin_90d, {r('coalesce(cogs, 0) * 365e0 / (90 * cost)', 2)} as inventory_turns_annual,
    {r('case when units > 0 then coalesce(sold, 0) * 365e0 / (90 * units) * 1e2 else 0e0 end', 1)} as sell_through_rate_pct,
    {r('coalesce(margin, 0) * 365e0 / (90 * cost) * 1e2', 1)} as inventory_roi_pct, {r('(retail - cost) * 1e2 / cost', 1)} as markup_pct,
    {r('supply', 1)} as avg_days_supply, out_cost / 1e2 as stockout_investment, over_cost / 1e2 as overstock_investment,
    {r('out_cost * 1e2 / cost', 1)} as stockout_investment_pct, {r('over_cost * 1e2 / cost', 1)} as overstock_investment_pct,
    {r('cost / 1e2 / nullif(products, 0)', 2)} as avg_investment_per_product, {r('coalesce(rev, 0) * 1e0 / cost', 2)} as revenue_to_investment_ratio_90d"""


@query("I11_financial_performance", for_check(f"""
    with s as (select product_key, {', '.join(_COMBO)}, cast(sum(net_cents) as bigint) as rev, cast(sum(quantity) as bigint) as sold, cast(sum(quantity * unit_cost_cents) as bigint) as cogs,
        cast(sum(net_cents - quantity * unit_cost_cents) as bigint) as margin
      from lines join product_d using (product_key) join location_d using (location_key) where not is_return and day >= {{asof}} - 90
      group by {', '.join(str(i + 1) for i in range(7))}),
    f as (select {', '.join('i.' + c for c in _COMBO)}, rev, sold, cogs, margin, cast(sum({COST}) as bigint) as cost, cast(sum({RETAIL}) as bigint) as retail,
        cast(sum(quantity_on_hand) as bigint) as units, count(distinct i.product_key) as products,
        cast(sum(case when is_stockout then {COST} else 0 end) as bigint) as out_cost, cast(sum(case when is_overstock then {COST} else 0 end) as bigint) as over_cost,
        avg(days_of_supply) as supply
      from (select * from inv join product_d using (product_key) join location_d using (location_key) where {ACTIVE}) i
      left join s on {' and '.join(f's.{c} = i.{c}' for c in _COMBO)}
      group by {', '.join('i.' + c for c in _COMBO)}, rev, sold, cogs, margin)
    select {_FIN} from f where cost > 10000"""))
def financial_performance(star: Star) -> DataFrame:
    """Stock and sales are aggregated to the six shared attributes before they are joined.

    Each distinct set of product sales totals of a combination gives one result row; equal
    sets merge, so the stock sums are multiplied by how often the set occurs.
    """
    attrs = (star.product().select("product_key", *_COMBO[:4], "unit_cost_cents", "price_cents", "product_active"),
             star.location().select("location_key", *_COMBO[4:], "location_active"))
    q, k = F.col("quantity"), F.col("unit_cost_cents")
    lines = (star.lines(star.days_back(90)).where(~F.col("is_return")).join(attrs[0], "product_key").join(attrs[1], "location_key")
             .groupBy("product_key", *_COMBO).agg(
                 F.sum("net_cents").alias("rev"), F.sum(q).alias("sold"), F.sum(q * k).alias("cogs"),
                 F.sum(F.col("net_cents") - q * k).alias("margin")))
    sets = lines.groupBy(*_COMBO, "rev", "sold", "cogs", "margin").agg(F.count("*").alias("times"))
    c, t = F.expr(COST), F.expr(RETAIL)
    stock = (ledger.positions(star).join(attrs[0], "product_key").join(attrs[1], "location_key").where(ACTIVE).groupBy(*_COMBO).agg(
        F.sum(c).alias("cost"), F.sum(t).alias("retail"), F.sum("quantity_on_hand").alias("units"),
        F.countDistinct("product_key").alias("products"), F.sum(F.when(F.col("is_stockout"), c).otherwise(F.lit(0))).alias("out_cost"),
        F.sum(F.when(F.col("is_overstock"), c).otherwise(F.lit(0))).alias("over_cost"), F.avg("days_of_supply").alias("supply")))
    both = stock.join(sets, _COMBO, "left")
    for name in ("cost", "retail", "units", "out_cost", "over_cost"):
        both = both.withColumn(name, F.col(name) * F.coalesce("times", F.lit(1)))
    return both.where("cost > 10000").selectExpr(*[x.strip() for x in _split(_FIN)])


report("I12_out_of_stock_now", Report("inv product location", {**NAMES, "stockout_duration_days": "stockout_days",
       **cols("quantity_available", "last_replenishment_date")}, {}, "is_stockout"))
SINCE_RESTOCK = "DAYS({asof}, last_replenishment_date)"
report("I12_out_longer_than_7_days", Report("inv product location", {**NAMES, "stockout_duration_days": "stockout_days",
       **cols("last_replenishment_date", "next_replenishment_date"), "days_since_replenishment": SINCE_RESTOCK}, {},
       "is_stockout and stockout_days > 7"))


_ONE_POSITION = [*NAMES, "quantity_on_hand", "quantity_available", "quantity_reserved", "quantity_in_transit", "quantity_damaged", "is_stockout"]


@query("I13_position_of_one_product", f"""
    select {', '.join(_ONE_POSITION)} from inv join product_d using (product_key) join location_d using (location_key)
    where product_name = 'small ring' and location_name = 'Supplier#000000007'""")
def one_position(star: Star, product_name: str = "small ring", location_name: str = "Supplier#000000007") -> DataFrame:
    """Position of a product at a location, by name; only its lines are replayed."""
    p = star.product().where(F.col("product_name") == F.lit(product_name)).select("product_key", "product_name")
    at = star.location().where(F.col("location_name") == F.lit(location_name)).select("location_key", "location_name")
    found = ledger.positions(star, p.select("product_key"), at.select("location_key"))
    return found.join(p, "product_key").join(at, "location_key").select(*_ONE_POSITION)


VALUES = {"total_inventory_value_cost": money(COST), "total_inventory_value_retail": money(RETAIL)}
report("I14_levels_by_category", Report("inv product", cols("category_level_1"), {
    "product_count": "count(distinct product_key)", "total_quantity_on_hand": sum_long("quantity_on_hand"),
    "total_quantity_available": sum_long("quantity_available"), **VALUES}))
NEAR = "(days_of_supply <= 7 or quantity_available * 2 <= reorder_point * 3)"
report("I15_stockout_risk_list", Report("inv product location", {
    **NAMES, **cols("quantity_available", "days_of_supply", "reorder_point", "next_replenishment_date"),
    "risk_level": "case when days_of_supply <= 3 or quantity_available <= reorder_point then 'High Risk' "
                  "when days_of_supply <= 7 or quantity_available * 2 <= reorder_point * 3 then 'Medium Risk' else 'Low Risk' end"}, {},
    f"quantity_available > 0 and {NEAR}"))


def best_sellers(star: Star, k: int = 20) -> DataFrame:
    sold = star.lines(star.days_back(90)).where(~F.col("is_return")).groupBy("product_key").agg(F.sum("quantity").alias("total_sold"))
    return F.broadcast(sold.orderBy(F.desc("total_sold"), "product_key").limit(k))


def best_positions(star: Star) -> DataFrame:
    best = best_sellers(star)
    return ledger.positions(star, best.select("product_key")).join(best, "product_key")


_BEST = for_check("""(select product_key, cast(sum(quantity) as bigint) as total_sold from lines where not is_return and day >= {asof} - 90
    group by 1 order by 2 desc, 1 limit 20)""")


@query("I16_best_seller_risk", f"""
    select product_name, location_name, quantity_available, days_of_supply, reorder_point, total_sold,
      case when days_of_supply <= 3 then 'High Risk' when days_of_supply <= 7 then 'Medium Risk' else 'Low Risk' end as risk_level
    from inv join {_BEST} b using (product_key) join product_d using (product_key) join location_d using (location_key)""")
def best_seller_risk(star: Star) -> DataFrame:
    return best_positions(star).join(star.product(), "product_key").join(star.location(), "location_key").selectExpr(
        "product_name", "location_name", "quantity_available", "days_of_supply", "reorder_point", "total_sold",
        "case when days_of_supply <= 3 then 'High Risk' when days_of_supply <= 7 then 'Medium Risk' else 'Low Risk' end as risk_level")


@query("I16_best_seller_supply", f"""
    select product_name, location_name, quantity_available, days_of_supply, stock_cover_days, reorder_point, reorder_quantity,
      case when days_of_supply <= 3 then 'Critical' when days_of_supply <= 7 then 'Low' when days_of_supply <= 14 then 'Adequate' else 'High' end as supply_status
    from inv join {_BEST} b using (product_key) join product_d using (product_key) join location_d using (location_key)""")
def best_seller_supply(star: Star) -> DataFrame:
    return best_positions(star).join(star.product(), "product_key").join(star.location(), "location_key").selectExpr(
        "product_name", "location_name", "quantity_available", "days_of_supply", "stock_cover_days", "reorder_point", "reorder_quantity",
        "case when days_of_supply <= 3 then 'Critical' when days_of_supply <= 7 then 'Low' when days_of_supply <= 14 then 'Adequate' "
        "else 'High' end as supply_status")


report("I17_overstocked", Report("inv product location", {**NAMES, **cols("quantity_on_hand", "days_of_supply", "is_overstock"),
       "inventory_value_cost": cost(COST), "inventory_value_retail": cost(RETAIL)}, {}, "is_overstock"))
report("I17_excess_by_days_of_supply", Report("inv product location", {
    **NAMES, **cols("quantity_on_hand", "days_of_supply"), "inventory_value_cost": cost(COST),
    "overstock_level": "case when days_of_supply > 90 then 'Severe Overstock' when days_of_supply > 60 then 'Moderate Overstock' else 'Normal' end"},
    {}, "days_of_supply > 60"))
report("I18_value_by_location", Report("inv product location", cols("location_name", "region"), {
    "product_count": "count(distinct product_key)", **VALUES, "total_margin_value": money(f"{RETAIL} - {COST}")}))
report("I18_value_by_category", Report("inv product", cols("category_level_1", "category_level_2"), {
    "product_count": "count(distinct product_key)", **VALUES, "avg_inventory_value_cost_per_product": f"(avg({COST}) / 1e2)"}))
report("I19_need_reordering", Report("inv product location", {
    **NAMES, **cols("quantity_available", "reorder_point", "reorder_quantity", "next_replenishment_date"),
    "quantity_below_reorder_point": "reorder_point - quantity_available",
    "reorder_status": f"case when next_replenishment_date is null then 'No schedule - Urgent' when {DUE} > 7 then 'Scheduled but delayed' else 'Scheduled' end"},
    {}, "quantity_available <= reorder_point"))
report("I20_in_transit", Report("inv product location", {
    **NAMES, **cols("quantity_in_transit", "quantity_available", "next_replenishment_date"), "days_until_arrival": DUE}, {}, "quantity_in_transit > 0"))
report("I21_movements_last_month", Report("moves", cols("movement_type"), {
    "movement_count": "count(*)", "total_quantity_change": sum_long("quantity"), "total_cost": money("total_cents"),
    "avg_unit_cost": "(avg(unit_cents) / 1e2)"}, "day < {asof}", since=30))


@query("I21_receipts_last_month", for_check("""
    select product_name, location_name, day as calendar_date, quantity as replenishment_quantity, movement_type
    from moves join product_d using (product_key) join location_d on to_location_key = location_key
    where movement_type in ('receipt', 'transfer') and day >= {asof} - 30 and day < {asof}"""))
def receipts_last_month(star: Star) -> DataFrame:
    """Incoming stock: first receipts and restocks."""
    m = ledger.movements(star, star.days_back(30)).where((F.col("day") < F.lit(star.as_of)) & F.col("movement_type").isin("receipt", "transfer"))
    to = star.location().select(F.col("location_key").alias("to_location_key"), "location_name")
    return m.join(star.product().select("product_key", "product_name"), "product_key").join(to, "to_location_key").select(
        "product_name", "location_name", F.col("day").alias("calendar_date"), F.col("quantity").alias("replenishment_quantity"), "movement_type")


@query("I22_turnover_by_category", for_check("""
    with spans as (select product_key, location_key, stock * (date_diff('day', greatest(a, {asof} - 90), b) + 1) as sd from
        (select product_key, location_key, day as a, coalesce(least(next_day - 1, {asof}), {asof}) as b, stock_end as stock from walk where day <= {asof}
         union all select product_key, location_key, (select d0 from horizon), min(day) - 1, any_value(opening) from walk where day <= {asof} group by 1, 2) t
        where b >= {asof} - 90 and a <= b),
    v as (select product_key, location_key, cast(sum(sd) as bigint) as sd from spans group by 1, 2),
    s as (select product_key, location_key, sum(net_cents) as rev from lines where not is_return and day >= {asof} - 90 group by 1, 2)
    select category_level_1, count(distinct product_key) as product_count, sum(sd * unit_cost_cents) / 91e0 / 1e2 as total_avg_inventory_value,
      sum(rev) / 1e2 as total_sales_revenue,
      case when sum(sd * unit_cost_cents) > 0 then sum(rev) * 91e0 / sum(sd * unit_cost_cents) else 0e0 end as inventory_turnover_rate
    from v join s using (product_key, location_key) join product_d using (product_key) group by 1"""))
def turnover_by_category(star: Star) -> DataFrame:
    """Mean stock over the window = stock x days of each state, without one row per day."""
    first = star.days_back(90)
    held = (ledger.intervals(star).where(F.col("last_day") >= F.lit(first)).groupBy(*POS).agg(
        F.sum(F.col("stock") * (F.datediff("last_day", F.greatest("first_day", F.lit(first))) + 1)).alias("sd")))
    s = star.lines(first).where(~F.col("is_return")).groupBy(*POS).agg(F.sum("net_cents").alias("rev"))
    worth, rev = F.sum(F.col("sd") * F.col("unit_cost_cents")), F.sum("rev")
    return (s.join(held, POS).join(star.product().select("product_key", "category_level_1", "unit_cost_cents"), "product_key")
            .groupBy("category_level_1").agg(
                F.countDistinct("product_key").alias("product_count"), (worth / 91.0 / 100.0).alias("total_avg_inventory_value"),
                (rev / 100.0).alias("total_sales_revenue"),
                F.when(worth > 0, rev * 91.0 / F.nullif(worth, F.lit(0))).otherwise(F.lit(0.0)).alias("inventory_turnover_rate")))


report("I23_stockouts_by_location", Report("stockouts location", cols("location_name", "region"), {
    "stockout_event_count": "count(*)", "total_lost_sales_revenue": money("lost_cents"), "total_lost_sales_quantity": sum_long("lost_units"),
    "avg_stockout_duration_days": "avg(duration_days)", "unique_products_affected": "count(distinct product_key)"}, since=90))
PRODUCT = cols("product_name", "category_level_1")
report("I23_revenue_impact_by_product", Report("stockouts product", PRODUCT, {
    "stockout_count": "count(*)", "total_lost_revenue": money("lost_cents"), "total_lost_quantity": sum_long("lost_units"),
    "avg_duration_days": "avg(duration_days)", "peak_season_lost_revenue": money("case when peak_season_flag then lost_cents else 0 end")},
    since=90, order="total_lost_revenue desc, product_name, category_level_1", limit=20))
report("I24_location_comparison", Report("inv product location", cols("region", "location_name"), {
    "product_count": "count(distinct product_key)", "total_quantity_available": sum_long("quantity_available"),
    "total_inventory_value_cost": money(COST), "stockout_count": count_if("is_stockout"), "overstock_count": count_if("is_overstock")}))
report("I25_daily_trend", Report("inv_daily", {
    "calendar_date": "day", "month_name": "MONTHNAME(day)", "year": "year(day)", "product_count": "product_count",
    "total_quantity_available": "quantity_available", "total_inventory_value_cost": cost("cost_cents"),
    "stockout_count": "stockouts", "overstock_count": "overstocks"}, {}, since=90))
report("I25_monthly_stockouts", Report("stockouts", {"month_name": "MONTHNAME(day)", "year": "year(day)"}, {
    "stockout_event_count": "count(*)", "total_lost_revenue": money("lost_cents"), "avg_duration_days": "avg(duration_days)",
    "peak_season_stockouts": count_if("peak_season_flag")}, since=180))
report("I26_network_health", Report("inv product", {}, {
    "total_products": "count(distinct product_key)", "stockout_count": count_if("is_stockout"), "overstock_count": count_if("is_overstock"),
    "high_risk_count": count_if("days_of_supply <= 3"), "excess_inventory_count": count_if("days_of_supply > 90"),
    "avg_days_of_supply": "avg(days_of_supply)", "total_inventory_value": money(COST)},
    post={"inventory_health_status": "case when stockout_count * 1e0 / total_products > 0.10e0 then 'Critical' "
          "when stockout_count * 1e0 / total_products > 0.05e0 then 'Poor' when high_risk_count * 1e0 / total_products > 0.15e0 then 'At Risk' "
          "when excess_inventory_count * 1e0 / total_products > 0.10e0 then 'Excess Inventory' else 'Healthy' end"}))
report("I27_replenishment_schedule", Report("inv product location", {
    **NAMES, **cols("quantity_available", "days_of_supply", "reorder_point", "last_replenishment_date", "next_replenishment_date"),
    "days_until_replenishment": DUE, "reorder_quantity": "reorder_quantity"}, {}, NEAR))
report("I28_top_products_by_lost_revenue", Report("stockouts product", {"product_name": "product_name", "category": "category_level_1"}, {
    "stockout_count": "count(*)", "total_lost_revenue": money("lost_cents"), "avg_duration_days": "avg(duration_days)"},
    order="total_lost_revenue desc, product_name, category", limit=10))
report("I29_locations_by_stockout_rate", Report("inv location", cols("location_key", "location_name", "location_type", "city"), {
    "stockout_rate_pct": pct(count_if("is_stockout"), "count(*)", 2), "stockout_positions": count_if("is_stockout")},
    order="stockout_rate_pct desc, location_key", limit=10,
    keep=["location_name", "location_type", "city", "stockout_rate_pct", "stockout_positions"]))
report("I30_abandonment_by_cause", Report("carts", {
    "abandonment_type": "case when low_inventory_trigger then 'Low Inventory' else 'Other Reasons' end"}, {
    "abandonment_count": "count(*)", "avg_cart_value": r("avg(cart_cents) / 1e2", 2), "total_lost_value": money("cart_cents")}))


@query("I31_turnover_from_positions", f"""
    select category_level_1 as category, cast(sum(quantity) as bigint) as total_sold, {r('avg(stock_end)', 0)} as avg_inventory,
      {r('sum(quantity) / nullif(avg(stock_end), 0)', 2)} as turnover_ratio
    from lines join walk using (product_key, location_key, day) join product_d using (product_key) group by 1""")
def turnover_from_positions(star: Star) -> DataFrame:
    """The walk already holds units and lines per position and day, so the sale lines are not joined again."""
    n = F.sum("attempts")
    mean = F.sum(F.col("attempts") * F.col("stock_end")) / n
    return (ledger.stock_walk(star).where("attempts > 0").join(star.product().select("product_key", "category_level_1"), "product_key")
            .groupBy(F.col("category_level_1").alias("category")).agg(
                F.sum("request").alias("total_sold"), half_up(mean, 0).alias("avg_inventory"),
                half_up(F.sum("request") / F.nullif(mean, F.lit(0.0)), 2).alias("turnover_ratio")))
