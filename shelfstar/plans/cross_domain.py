"""Questions that join customer behaviour with stock: X01-X11.

Where the published question joins row sets on a shared key (sales with forecasts of a
location, carts with affinity rows of a customer), each side is aggregated first and
carries its row count as a weight. The totals are the same as those of the joined rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfstar.functions.exprs import half_up
from shelfstar.functions.exprs import half_up_sql as r
from shelfstar.functions.exprs import steady_avg
from shelfstar.functions.exprs import steady_avg_sql as steady
from shelfstar.operators import facts, ledger
from shelfstar.plans.customer import pct
from shelfstar.plans.inventory import POS, cols, ratio
from shelfstar.plans.metric_views import RETAIL, count_if
from shelfstar.plans.registry import query, report
from shelfstar.plans.report import Report, for_check
from shelfstar.star import Star

# Published bands and labels.
COVER = ("case when avg_days_supply < 7 then 'CRITICAL - Stockout Risk' when avg_days_supply < 14 then 'WARNING - Low Coverage' else 'OK' end")


@query("X01_trending_fulfilment", for_check(f"""
    with w as (select product_key, sum(quantity) filter (where day >= {{asof}} - 7) as cur,
        sum(quantity) filter (where day between {{asof}} - 14 and {{asof}} - 8) as prev
      from lines where day >= {{asof}} - 14 group by 1),
    t as (select distinct product_key, cur, cur / prev - 1 as growth from w join affinity using (product_key) where cur / prev - 1 > 0.5e0),
    c as (select product_key, growth, sum(case when location_channel = 'physical' then quantity_available else 0 end) as store,
        sum(case when location_channel = 'digital' then quantity_available else 0 end) as wh, avg(days_of_supply) as avg_days_supply, cur * 4 as demand
      from t join inv using (product_key) join location_d using (location_key) group by product_key, growth, cur)
    select product_name, {r('growth * 1e2', 1)} as growth_pct, cast(store as bigint) as store_inventory, cast(wh as bigint) as warehouse_inventory,
      avg_days_supply, cast(demand as bigint) as projected_monthly_demand, {COVER} as inventory_status, {pct('(store + wh)', 'demand', 1)} as demand_coverage_pct
    from c join product_d using (product_key)"""))
def trending_fulfilment(star: Star) -> DataFrame:
    q, day = F.col("quantity"), F.col("day")
    week = (star.lines(star.days_back(14)).groupBy("product_key").agg(
        F.sum(F.when(day >= F.lit(star.days_back(7)), q)).alias("cur"),
        F.sum(F.when(day <= F.lit(star.days_back(8)), q)).alias("prev")))
    growth = F.col("cur") / F.nullif("prev", F.lit(0)) - 1
    hot = (week.withColumn("growth", growth).where("growth > 0.5")
           .join(facts.affinity(star).select("product_key").distinct(), "product_key", "left_semi"))
    at = star.location().select("location_key", "location_channel")
    stock = ledger.positions(star, hot.select("product_key")).join(hot, "product_key").join(at, "location_key").groupBy("product_key", "growth", "cur").agg(
        F.sum(F.when(F.col("location_channel") == "physical", F.col("quantity_available")).otherwise(F.lit(0))).alias("store_inventory"),
        F.sum(F.when(F.col("location_channel") == "digital", F.col("quantity_available")).otherwise(F.lit(0))).alias("warehouse_inventory"),
        F.avg("days_of_supply").alias("avg_days_supply"))
    demand = F.col("cur") * 4
    return stock.join(star.product().select("product_key", "product_name"), "product_key").select(
        "product_name", half_up(F.col("growth") * 100.0, 1).alias("growth_pct"), "store_inventory", "warehouse_inventory", "avg_days_supply",
        demand.alias("projected_monthly_demand"), F.expr(COVER).alias("inventory_status"),
        half_up(ratio(F.col("store_inventory") + F.col("warehouse_inventory"), demand), 1).alias("demand_coverage_pct"))


@query("X02_demand_supply_mismatch", f"""
    with c as (select segment, geo_region, product_key, category_level_2, count(distinct customer_key) as people, avg(score_pct) as score, sum(predicted_cents) as cents
        from affinity join customer_d using (customer_key) join product_d using (product_key) where score_pct > 8 group by 1, 2, 3, 4),
    i as (select product_key, region, quantity_available, {RETAIL} as retail, is_stockout, is_overstock
        from inv join location_d using (location_key) join product_d using (product_key))
    select segment, geo_region, category_level_2, cast(sum(people) as bigint) as high_affinity_customers, sum(cents) / 1e2 as revenue_opportunity,
      cast(sum(quantity_available) as bigint) as available_inventory, sum(retail) / 1e2 as inventory_value,
      cast(sum(case when is_stockout then people else 0 end) as bigint) as customers_facing_stockout,
      sum(case when is_stockout then cents else 0 end) / 1e2 as lost_revenue_opportunity,
      sum(case when is_overstock and score < 5 then retail else 0 end) / 1e2 as overstock_exposure
    from c left join i on c.product_key = i.product_key and c.geo_region = i.region group by 1, 2, 3""")
def demand_supply_mismatch(star: Star) -> DataFrame:
    who = star.customer().where("is_current").select("customer_key", "segment", "geo_region")
    part = star.product().select("product_key", "category_level_2", "price_cents")
    c = (facts.affinity(star).where("score_pct > 8").join(who, "customer_key").groupBy("segment", "geo_region", "product_key").agg(
        F.countDistinct("customer_key").alias("people"), F.avg("score_pct").alias("score"), F.sum("predicted_cents").alias("cents")))
    retail, z = F.expr("quantity_on_hand * price_cents"), F.lit(0)
    i = (ledger.positions(star).join(part, "product_key").join(star.location().select("location_key", "region"), "location_key")
         .groupBy("product_key", F.col("region").alias("geo_region")).agg(
             F.count("*").alias("n"), F.sum("quantity_available").alias("q"), F.sum(retail).alias("retail"),
             F.count(F.when(F.col("is_stockout"), 1)).alias("outs"), F.sum(F.when(F.col("is_overstock"), retail).otherwise(z)).alias("over")))
    n, outs = F.coalesce("n", F.lit(1)), F.coalesce("outs", z)
    both = c.join(i, ["product_key", "geo_region"], "left").join(part.drop("price_cents"), "product_key")
    return both.groupBy("segment", "geo_region", "category_level_2").agg(
        F.sum(F.col("people") * n).alias("high_affinity_customers"), (F.sum(F.col("cents") * n) / 100.0).alias("revenue_opportunity"),
        F.sum("q").alias("available_inventory"), (F.sum("retail") / 100.0).alias("inventory_value"),
        F.sum(F.col("people") * outs).alias("customers_facing_stockout"),
        (F.sum(F.col("cents") * outs) / 100.0).alias("lost_revenue_opportunity"),
        (F.sum(F.when(F.col("score") < 5, F.coalesce("over", z)).otherwise(z)) / 100.0).alias("overstock_exposure"))


@query("X03_stock_aware_recommendations", f"""
    with p as (select customer_key, preferred_channel, product_key, predicted_cents,
        row_number() over (partition by customer_key order by score_pct desc, product_key) as i
      from affinity join customer_d using (customer_key) where segment = 'HOUSEHOLD' and score_pct > 5),
    c as (select product_key, location_channel, sum(quantity_available) as q from inv join location_d using (location_key) group by 1, 2)
    select preferred_channel, count(distinct customer_key) as customers, count(distinct case when q > 0 then product_key end) as available_recommendations,
      count(distinct product_key) as total_recommendations,
      {pct('count(distinct case when q > 0 then product_key end)', 'count(distinct product_key)', 1)} as recommendation_fulfillment_rate,
      sum(case when q > 0 then predicted_cents else 0 end) / 1e2 as realizable_cltv,
      (sum(predicted_cents) - sum(case when q > 0 then predicted_cents else 0 end)) / 1e2 as missed_cltv_opportunity
    from p left join c using (product_key) where i <= 10 group by 1""")
def stock_aware_recommendations(star: Star, segment: str = "HOUSEHOLD", k: int = 10) -> DataFrame:
    """Top k per customer; the rank filter lets each map task drop all but k rows of a customer before the shuffle."""
    who = star.customer().where("is_current").where(F.col("segment") == segment).select("customer_key", "preferred_channel")
    w = Window.partitionBy("customer_key").orderBy(F.desc("score_pct"), "product_key")
    top = (facts.affinity(star).where("score_pct > 5").join(who, "customer_key")
           .withColumn("i", F.row_number().over(w)).where(F.col("i") <= k))
    c = (ledger.positions(star).join(star.location().select("location_key", "location_channel"), "location_key")
         .groupBy("product_key", "location_channel").agg(F.sum("quantity_available").alias("q"))
         .groupBy("product_key").agg(F.count("*").alias("n"), F.count(F.when(F.col("q") > 0, 1)).alias("ok")))
    both = top.join(c, "product_key", "left")
    here, cents, z = F.coalesce("ok", F.lit(0)), F.col("predicted_cents"), F.lit(1)
    open_, all_ = F.countDistinct(F.when(here > 0, F.col("product_key"))), F.countDistinct("product_key")
    won = F.sum(cents * here)
    return both.groupBy("preferred_channel").agg(
        F.countDistinct("customer_key").alias("customers"), open_.alias("available_recommendations"), all_.alias("total_recommendations"),
        half_up(ratio(open_, all_), 1).alias("recommendation_fulfillment_rate"), (won / 100.0).alias("realizable_cltv"),
        ((F.sum(cents * F.coalesce("n", z)) - won) / 100.0).alias("missed_cltv_opportunity"))


@query("X04_size_problems_and_stock", f"""
    with s as (select product_key, category_level_2, ordered_size, count(*) as orders, count(*) filter (where is_returned) as returns, avg(fit_score) as fit
        from sizefit join product_d using (product_key) group by 1, 2, 3),
    i as (select product_key, sum(quantity_on_hand) as q, sum({RETAIL}) as retail from inv join product_d using (product_key) group by 1)
    select category_level_2, ordered_size, cast(sum(orders) as bigint) as total_orders, cast(sum(returns) as bigint) as total_returns,
      {pct('sum(returns)', 'sum(orders)', 1)} as return_rate, {r(steady('fit'), 4)} as avg_fit_score, cast(sum(q) as bigint) as current_inventory,
      sum(retail) / 1e2 as tied_up_capital, {r('sum(returns) * avg(retail) / nullif(sum(q), 0) / 1e2', 2)} as return_cost_impact
    from s join i using (product_key) group by 1, 2 having sum(orders) > 50""")
def size_problems_and_stock(star: Star) -> DataFrame:
    part = star.product().select("product_key", "category_level_2", "price_cents")
    s = facts.size_fit(star).groupBy("product_key", "ordered_size").agg(
        F.count("*").alias("orders"), F.count(F.when(F.col("is_returned"), 1)).alias("returns"), F.avg("fit_score").alias("fit"))
    i = ledger.positions(star).groupBy("product_key").agg(F.sum("quantity_on_hand").alias("q"))
    both = s.join(i, "product_key").join(part, "product_key").withColumn("retail", F.col("q") * F.col("price_cents"))
    o, b, q = F.sum("orders"), F.sum("returns"), F.sum("q")
    return both.groupBy("category_level_2", "ordered_size").agg(
        o.alias("total_orders"), b.alias("total_returns"), half_up(ratio(b, o), 1).alias("return_rate"),
        half_up(steady_avg(F.col("fit")), 4).alias("avg_fit_score"), q.alias("current_inventory"), (F.sum("retail") / 100.0).alias("tied_up_capital"),
        half_up(b * F.avg("retail") / F.nullif(q, F.lit(0)) / 100.0, 2).alias("return_cost_impact")).where("total_orders > 50")


_NEED = "avg_q * 30 * (1 + dev / avg_q)"


@query("X05_allocation_by_demand_pattern", for_check(f"""
    with d as (select location_key, category_level_2, avg(quantity) as avg_q, stddev_samp(quantity) as dev, {steady('forecast_accuracy')} as acc
        from (select location_key, category_level_2, quantity from lines join product_d using (product_key) where day >= {{asof}} - 30) s
        join (select location_key, forecast_accuracy from forecast) f using (location_key) group by 1, 2),
    e as (select customer_key % 10 as location_key, count(distinct customer_key) as people from events_f group by 1),
    c as (select location_key, category_level_2, sum(quantity_on_hand) as q, avg(days_of_supply) as supply, count(*) filter (where is_stockout) as outs,
        count(*) filter (where is_overstock) as overs from inv join product_d using (product_key) group by 1, 2)
    select location_name, location_type, category_level_2, {r('avg_q', 1)} as avg_daily_velocity, {r('dev / avg_q', 2)} as coefficient_of_variation,
      coalesce(people, 0) as engaged_customers, cast(q as bigint) as current_inventory, supply as days_of_supply, outs as stockout_skus, overs as overstock_skus,
      {r('acc', 1)} as forecast_accuracy_pct, {r(_NEED, 0)} as recommended_inventory, {r(f'{_NEED} - q', 0)} as inventory_gap
    from d join c using (location_key, category_level_2) join location_d using (location_key) left join e using (location_key) where avg_q > 0"""))
def allocation_by_demand_pattern(star: Star) -> DataFrame:
    """The published join repeats each sale line once per forecast row of its location; the sample
    deviation of such repeated values follows from the plain sums and that count."""
    part = star.product().select("product_key", "category_level_2")
    key = ["location_key", "category_level_2"]
    q = F.col("quantity")
    s = (star.lines(star.days_back(30)).join(part, "product_key").groupBy(*key).agg(
        F.count("*").alias("n"), F.sum(q).alias("sx"), F.sum(q * q).alias("sxx")))
    f = facts.forecast(star).groupBy("location_key").agg(F.count("*").alias("k"), steady_avg(F.col("forecast_accuracy")).alias("acc"))
    e = star.events().groupBy((F.col("customer_key") % 10).alias("location_key")).agg(F.countDistinct("customer_key").alias("people"))
    c = (ledger.positions(star).join(part, "product_key").groupBy(*key).agg(
        F.sum("quantity_on_hand").alias("q"), F.avg("days_of_supply").alias("supply"), F.count(F.when(F.col("is_stockout"), 1)).alias("outs"),
        F.count(F.when(F.col("is_overstock"), 1)).alias("overs")))
    n, k = F.col("n"), F.col("k")
    spread = F.col("sxx") - F.col("sx") * 1.0 * F.col("sx") / n
    dev = F.when(n * k > 1, F.sqrt(F.greatest(F.lit(0.0), spread) * k / F.nullif(n * k - 1, F.lit(0))))
    both = (s.join(f, "location_key").join(c, key).join(star.location().select("location_key", "location_name", "location_type"), "location_key")
            .join(e, "location_key", "left").withColumn("avg_q", F.col("sx") / n).withColumn("dev", dev).where("avg_q > 0"))
    need = F.col("avg_q") * 30 * (1 + F.col("dev") / F.col("avg_q"))
    return both.select("location_name", "location_type", "category_level_2", half_up(F.col("avg_q"), 1).alias("avg_daily_velocity"),
                       half_up(F.col("dev") / F.col("avg_q"), 2).alias("coefficient_of_variation"),
                       F.coalesce("people", F.lit(0)).alias("engaged_customers"), F.col("q").alias("current_inventory"),
                       F.col("supply").alias("days_of_supply"), F.col("outs").alias("stockout_skus"), F.col("overs").alias("overstock_skus"),
                       half_up(F.col("acc"), 1).alias("forecast_accuracy_pct"), half_up(need, 0).alias("recommended_inventory"),
                       half_up(need - F.col("q"), 0).alias("inventory_gap"))


@query("X06_omnichannel_fulfilment", f"""
    with o as (select customer_key, case when count(distinct channel_key) >= 3 then 'Omnichannel' when count(distinct channel_key) = 2
        then 'Multichannel' else 'Single Channel' end as channel_behavior from sales group by 1),
    v as (select customer_key, channel_behavior, count(distinct transaction_id) as txns, sum(net_cents) as cents, max(score_pct) as top
      from o join (select * from sales where not is_return) s using (customer_key)
      left join (select customer_key as ck, cart_id from carts) c on c.ck = s.customer_key
      left join (select customer_key as ak, score_pct from affinity) a on a.ak = s.customer_key group by 1, 2),
    f as (select customer_key, count(distinct case when stock_end > 0 then product_key end) as ok, count(distinct product_key) as n,
        count(distinct case when stock_end = 0 then product_key end) as outs from sales join walk using (product_key, location_key, day) group by 1)
    select channel_behavior, count(distinct customer_key) as customer_count, {r('avg(cents) / 1e2', 2)} as avg_customer_value, {r('avg(txns)', 1)} as avg_transactions,
      {r(steady('ok * 1e2 / nullif(n, 0)'), 1)} as fulfillment_rate, {r('avg(outs)', 1)} as avg_stockout_encounters,
      sum(cents) / 1e2 as total_segment_revenue, {r('avg(top) / 1e2', 3)} as avg_max_affinity
    from v join f using (customer_key) group by 1""")
def omnichannel_fulfilment(star: Star) -> DataFrame:
    """Cart and affinity rows enter as counts per customer (the weights of the published join).

    Distinct counts are taken level by level (customer and order, customer and product), which needs
    no row expansion: an order has one channel, and a product counts once per customer.
    """
    kept = ~F.col("is_return")
    sales = star.sales()
    orders = sales.groupBy("customer_key", "transaction_id").agg(
        F.min("channel_key").alias("channel"), F.max(kept).alias("kept"), F.sum(F.when(kept, F.col("net_cents"))).alias("cents"))
    s = orders.groupBy("customer_key").agg(
        F.size(F.collect_set("channel")).alias("channels"), F.count(F.when(F.col("kept"), 1)).alias("txns"), F.sum("cents").alias("cents"))
    c = facts.carts(star).groupBy("customer_key").agg(F.count("*").alias("nc"))
    a = facts.affinity(star).groupBy("customer_key").agg(F.count("*").alias("na"), F.max("score_pct").alias("top"))
    walk = ledger.stock_walk(star).where("attempts > 0").select(*POS, "day", "stock_end")
    pairs = sales.join(walk, [*POS, "day"]).groupBy("customer_key", "product_key").agg(
        F.max(F.col("stock_end") > 0).alias("some"), F.max(F.col("stock_end") == 0).alias("none"))
    f = pairs.groupBy("customer_key").agg(
        F.count(F.when(F.col("some"), 1)).alias("ok"), F.count("*").alias("n"), F.count(F.when(F.col("none"), 1)).alias("outs"))
    kind = (F.when(F.col("channels") >= 3, "Omnichannel").when(F.col("channels") == 2, "Multichannel").otherwise("Single Channel"))
    one = F.lit(1)
    v = (s.where(F.col("txns") > 0).join(c, "customer_key", "left").join(a, "customer_key", "left").join(f, "customer_key")
         .withColumn("cents", F.col("cents") * F.coalesce("nc", one) * F.coalesce("na", one)))
    return v.groupBy(kind.alias("channel_behavior")).agg(
        F.countDistinct("customer_key").alias("customer_count"), half_up(F.avg("cents") / 100.0, 2).alias("avg_customer_value"),
        half_up(F.avg("txns"), 1).alias("avg_transactions"), half_up(steady_avg(ratio(F.col("ok"), F.col("n"))), 1).alias("fulfillment_rate"),
        half_up(F.avg("outs"), 1).alias("avg_stockout_encounters"), (F.sum("cents") / 100.0).alias("total_segment_revenue"),
        half_up(F.avg("top") / 100.0, 3).alias("avg_max_affinity"))


@query("X07_recommendations_for_one_customer", """
    select customer_key, product_name, category_level_2, price_cents / 1e2 as base_price, score_pct / 1e2 as affinity_score,
      predicted_cents / 1e2 as predicted_cltv_impact, quantity_available
    from affinity join product_d using (product_key) join inv using (product_key)
    where customer_key = 1 and score_pct > 4 and quantity_available > 0 order by score_pct desc, product_key, location_key limit 10""")
def recommendations_for(star: Star, customer_key: int = 1, min_score: float = 0.04, k: int = 10) -> DataFrame:
    """What to offer one customer from current stock; the customer's rows are cut out at the scans."""
    mine = facts.affinity(star, customer_key).where(F.col("score_pct") > int(min_score * 100))
    stock = ledger.positions(star, mine.select("product_key")).where("quantity_available > 0").select(*POS, "quantity_available")
    return (mine.join(star.product(), "product_key").join(stock, "product_key")
            .orderBy(F.desc("score_pct"), "product_key", "location_key").limit(k).selectExpr(
                "customer_key", "product_name", "category_level_2", "price_cents / 1e2 as base_price", "score_pct / 1e2 as affinity_score",
                "predicted_cents / 1e2 as predicted_cltv_impact", "quantity_available"))


report("X08_products_to_rebalance", Report(
    "inv product location", cols("product_id", "product_name", "location_type"),
    {"total_qty": "cast(sum(quantity_on_hand) as bigint)", "avg_days_supply": "avg(days_of_supply)", "stockout_locations": count_if("is_stockout"),
     "overstock_locations": count_if("is_overstock")}, having="stockout_locations > 0 and overstock_locations > 0"))
report("X09_forecast_models_to_adjust", Report(
    "forecast product", cols("product_id", "product_name", "category_level_2"),
    {"avg_accuracy": r(steady("forecast_accuracy"), 4), "avg_mape": r(steady("mape"), 4), "total_actual": "cast(sum(actual_quantity) as bigint)",
     "total_forecast": "cast(sum(forecast_quantity) as bigint)", "forecast_count": "count(*)"}, since=30, having="avg_accuracy < 8e1"))


@query("X10_size_fit_patterns", f"""
    with g as (select product_id, product_name, ordered_size, kept_size, fit_description, count(*) as n, count(*) filter (where is_returned) as b,
        sum(fit_score) as fit from sizefit join product_d using (product_key) group by 1, 2, 3, 4, 5),
    h as (select product_id, product_name, ordered_size, kept_size, cast(sum(n) as bigint) as order_count, cast(sum(b) as bigint) as return_count,
        {r('sum(fit) / sum(n)', 4)} as avg_fit_score, arg_max(fit_description, row(n, length(fit_description), fit_description)) as most_common_feedback from g group by 1, 2, 3, 4)
    select * from h where order_count > 10 and return_count > order_count * 3e-1""")
def size_fit_patterns(star: Star) -> DataFrame:
    """Most frequent feedback from counts per value (longer text, then the later one, wins a tie), in two small aggregations."""
    keys = ["product_id", "product_name", "ordered_size", "kept_size"]
    per = facts.size_fit(star).groupBy("product_key", "ordered_size", "kept_size", "fit_description").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("is_returned"), 1)).alias("b"), F.sum("fit_score").alias("fit"))
    named = per.join(star.product().select("product_key", "product_id", "product_name"), "product_key")
    return named.groupBy(*keys).agg(
        F.sum("n").alias("order_count"), F.sum("b").alias("return_count"), half_up(F.sum("fit") / F.sum("n"), 4).alias("avg_fit_score"),
        F.max_by("fit_description", F.struct("n", F.length("fit_description"), "fit_description")).alias("most_common_feedback")).where(
            "order_count > 10 and return_count > order_count * 3e-1")


report("X11_affinity_coverage", Report("affinity", {}, {
    "use_case": "max('Personalization Data')", "customers_with_affinity": "count(distinct customer_key)", "avg_affinity": "(avg(score_pct) / 1e2)",
    "max_affinity": "(max(score_pct) / 1e2)", "avg_cltv_impact": "(avg(predicted_cents) / 1e2)"}, "score_pct > 0"))
report("X11_stock_health", Report("inv", {}, {
    "use_case": "max('Inventory Health')", "stockout_count": count_if("is_stockout"), "overstock_count": count_if("is_overstock"),
    "avg_days_supply": r("avg(days_of_supply)", 1), "products_tracked": "count(distinct product_key)", "locations_tracked": "count(distinct location_key)"}))
report("X11_forecast_accuracy", Report("forecast", {}, {
    "use_case": "max('Demand Forecast')", "forecasts_with_actuals": "count(*)", "avg_accuracy_pct": r(steady("forecast_accuracy"), 1),
    "avg_mape": r(steady("mape"), 1), "products_forecasted": "count(distinct product_key)"}, "actual_quantity is not null"))
