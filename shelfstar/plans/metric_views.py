"""The 20 metric views (M03-M22) and the published queries on them."""

from __future__ import annotations

from shelfstar.functions.exprs import half_up_sql as r2
from shelfstar.functions.exprs import money, sum_long
from shelfstar.plans.registry import report
from shelfstar.plans.report import MetricView
from shelfstar.star import SEASON_OF_DAY as SEASON

ACTIVE = "location_active and product_active"
COST, RETAIL = "quantity_on_hand * unit_cost_cents", "quantity_on_hand * price_cents"
CATEGORY = {"location_name": "location_name", "region": "region", "product_category": "category_level_1"}
# Published bands and labels.
PEAK = "case when month(day) in (11, 12, 3, 4) then 'Peak Season' else 'Regular Season' end"
CALENDAR = {"calendar_date": "day", "month_name": "MONTHNAME(day)", "year": "year(day)"}


def count_if(cond: str) -> str:
    return f"count(case when {cond} then 1 end)"


def share(cond: str) -> str:
    return f"({count_if(cond)} * 1e2 / nullif(count(*), 0))"


current_status = MetricView(
    "inv location product",
    {**CATEGORY, "stockout_status": "case when is_stockout then 'Out of Stock' else 'In Stock' end",
     "overstock_status": "case when is_overstock then 'Overstocked' else 'Normal' end"},
    {"total_quantity_available": sum_long("quantity_available"), "total_quantity_on_hand": sum_long("quantity_on_hand"),
     "total_inventory_value_cost": money(COST), "total_inventory_value_retail": money(RETAIL),
     "total_margin_value": money(f"{RETAIL} - {COST}"), "stockout_product_count": count_if("is_stockout"),
     "overstock_product_count": count_if("is_overstock"), "product_count": "count(*)",
     "average_days_of_supply": "avg(days_of_supply)"}, ACTIVE)

stockout_risk = MetricView(
    "inv location product",
    {**CATEGORY,
     "risk_level": "case when days_of_supply <= 3 then 'High Risk' when days_of_supply <= 7 then 'Medium Risk' else 'Low Risk' end",
     "reorder_status": "case when quantity_available < reorder_point then 'Below Reorder Point' "
                       "when quantity_available = reorder_point then 'At Reorder Point' else 'Above Reorder Point' end"},
    {"products_at_risk_count": "count(*)", "average_days_of_supply": "avg(days_of_supply)",
     "products_below_reorder_point_count": count_if("quantity_available < reorder_point"),
     "total_quantity_at_risk": sum_long("case when days_of_supply <= 7 then quantity_available else 0 end"),
     "average_reorder_quantity_needed": "avg(case when quantity_available < reorder_point then reorder_quantity else 0 end)",
     "products_with_no_replenishment_scheduled": count_if("next_replenishment_date is null and days_of_supply <= 7")},
    f"quantity_available > 0 and {ACTIVE}")

overstock_analysis = MetricView(
    "inv location product",
    {**CATEGORY, "overstock_severity": "case when days_of_supply > 90 then 'Severe Overstock' "
                                       "when days_of_supply > 60 then 'Moderate Overstock' else 'Normal' end"},
    {"overstock_product_count": "count(*)", "total_overstock_quantity": sum_long("quantity_on_hand"),
     "total_overstock_value_cost": money(COST), "average_days_of_supply": "avg(days_of_supply)",
     "products_above_90_days_supply": count_if("days_of_supply > 90")},
    f"(is_overstock or days_of_supply > 60) and {ACTIVE}")

value_summary = MetricView(
    "inv location product",
    {"location_name": "location_name", "region": "region", "location_type": "location_type",
     "product_category_l1": "category_level_1", "product_category_l2": "category_level_2"},
    {"total_inventory_value_cost": money(COST), "total_inventory_value_retail": money(RETAIL),
     "total_margin_value": money(f"{RETAIL} - {COST}"), "product_count": "count(distinct product_key)",
     "average_inventory_value_per_product": f"(avg({COST}) / 1e2)",
     "average_margin_per_product": f"(avg({RETAIL} - {COST}) / 1e2)"}, ACTIVE)

DUE = "DAYS(next_replenishment_date, {asof})"
reorder_management = MetricView(
    "inv location product",
    {**CATEGORY, "reorder_urgency": f"case when next_replenishment_date is null then 'Critical - No Schedule' "
                                    f"when {DUE} > 7 then 'Delayed - Schedule >7 Days' else 'Scheduled - Within 7 Days' end"},
    {"products_needing_reorder_count": "count(*)", "total_reorder_quantity_needed": sum_long("reorder_quantity"),
     "average_days_until_replenishment": f"avg({DUE})",
     "products_with_no_schedule_count": count_if("next_replenishment_date is null"),
     "products_with_delayed_schedule_count": count_if(f"{DUE} > 7")},
    f"quantity_available <= reorder_point and {ACTIVE}")

movement_summary = MetricView(
    "moves_to",
    {"movement_date": "day", "month_name": "MONTHNAME(day)", "year": "year(day)", "movement_type": "movement_type",
     "location_name": "location_name", "movement_reason": "movement_reason"},
    {"movement_count": "count(*)", "total_quantity_moved": sum_long("abs(quantity)"), "total_movement_cost": money("total_cents"),
     "average_movement_quantity": "avg(abs(quantity))", "average_movement_cost_per_unit": "(avg(unit_cents) / 1e2)"})

stockout_impact = MetricView(
    "stockouts location product",
    {"stockout_start_date": "day", "stockout_month": "MONTH0(day)", **CATEGORY,
     "peak_season": "case when peak_season_flag then 'Peak Season' else 'Regular Season' end",
     "stockout_duration_category": "case when duration_days <= 7 then 'Short Duration (<=7 days)' else 'Extended Duration (>7 days)' end"},
    {"stockout_event_count": "count(*)", "total_lost_sales_revenue": money("lost_cents"),
     "total_lost_sales_quantity": sum_long("lost_units"), "average_stockout_duration_days": "avg(duration_days)",
     "total_lost_sales_attempts": sum_long("lost_attempts"),
     "peak_season_lost_revenue": money("case when peak_season_flag then lost_cents else 0 end")}, ACTIVE)

location_comparison = MetricView(
    "inv location product",
    {"region": "region", "location_name": "location_name", "location_type": "location_type"},
    {"product_count": "count(distinct product_key)", "total_quantity_available": sum_long("quantity_available"),
     "total_inventory_value_cost": money(COST), "stockout_product_count": count_if("is_stockout"),
     "overstock_product_count": count_if("is_overstock"), "stockout_rate": share("is_stockout"),
     "overstock_rate": share("is_overstock"), "average_days_of_supply": "avg(days_of_supply)"}, "location_active")

trends_daily = MetricView(
    "inv_daily",
    {**CALENDAR, "quarter": "quarter(day)", "season": SEASON, "peak_season_indicator": PEAK},
    {"product_count": "max(product_count)", "total_quantity_available": sum_long("quantity_available"),
     "total_inventory_value_cost": money("cost_cents"), "stockout_product_count": sum_long("stockouts"),
     "overstock_product_count": sum_long("overstocks"), "average_days_of_supply": "(sum(supply_days) * 1e0 / sum(positions))"})

health_score = MetricView(
    "inv location product",
    {**CATEGORY, "health_status": "case when is_stockout then 'Critical' when days_of_supply <= 3 then 'At Risk' "
                                  "when days_of_supply > 90 or is_overstock then 'Excess Inventory' else 'Healthy' end"},
    {"total_products": "count(*)", "stockout_product_count": count_if("is_stockout"),
     "overstock_product_count": count_if("is_overstock"), "high_risk_product_count": count_if("days_of_supply <= 3"),
     "excess_inventory_product_count": count_if("days_of_supply > 90"), "average_days_of_supply": "avg(days_of_supply)",
     "stockout_rate": share("is_stockout"), "overstock_rate": share("is_overstock"),
     "health_score": "greatest(0e0, least(1e2, 1e2 - (10 * " + count_if("is_stockout") + " + 5 * " + count_if("is_overstock")
                     + " + 5 * " + count_if("days_of_supply <= 3") + ") * 1e0 / nullif(count(*), 0)))"}, ACTIVE)

customer_segmentation = MetricView(
    "customer",
    {"segment": "segment", "loyalty_tier": "loyalty_tier", "geo_region": "geo_region", "acquisition_channel": "acquisition_channel"},
    {"customer_count": "count(distinct customer_key)", "average_lifetime_value": "(avg(ltv_cents) / 1e2)",
     "total_lifetime_value": money("ltv_cents"), "min_lifetime_value": "(min(ltv_cents) / 1e2)",
     "max_lifetime_value": "(max(ltv_cents) / 1e2)"}, "is_current")

# Published bands and labels.
LOYALTY = ("case when recency_days > 90 and frequency < 3 then 'At Risk' "
           "when recency_days <= 30 and frequency >= 5 and monetary_cents > 100000 then 'Champion' "
           "when recency_days <= 60 and frequency >= 3 then 'Loyal' else 'Regular' end")
rfm_analysis = MetricView(
    "rfm customer", {"segment": "segment", "loyalty_status": LOYALTY},
    {"customer_count": "count(*)", "average_recency_days": "avg(recency_days)", "average_frequency": "avg(frequency)",
     "average_monetary_value": "(avg(monetary_cents) / 1e2)", "total_monetary_value": money("monetary_cents"),
     "champions_count": count_if(f"({LOYALTY}) = 'Champion'"), "at_risk_count": count_if(f"({LOYALTY}) = 'At Risk'")},
    "is_current", since=365)

ORDERS = {"transaction_count": "count(distinct transaction_id)", "total_revenue": money("net_cents"),
          "average_order_value": "(avg(net_cents) / 1e2)", "unique_customers": "count(distinct customer_key)"}
PER_CUSTOMER = "(count(distinct transaction_id) * 1e0 / nullif(count(distinct customer_key), 0))"
purchase_summary = MetricView(
    "sales customer channel",
    {"segment": "segment", "channel_name": "channel_name", "month_name": "MONTHNAME(day)", "year": "year(day)", "calendar_date": "day"},
    {**ORDERS, "transactions_per_customer": PER_CUSTOMER}, "is_current and not is_return")

# Published bands and labels.
LEVEL = "case when score_pct >= 70 then 'High Affinity' when score_pct >= 40 then 'Medium Affinity' else 'Low Affinity' end"
SCORE = "(avg(score_pct) / 1e2)"
product_affinity = MetricView(
    "affinity customer product",
    {"segment": "segment", "category_level_1": "category_level_1", "category_level_2": "category_level_2", "affinity_level": LEVEL},
    {"customer_count": "count(distinct customer_key)", "product_count": "count(distinct product_key)",
     "average_affinity_score": SCORE, "total_purchases": sum_long("purchase_count"),
     "average_predicted_cltv_impact": "(avg(predicted_cents) / 1e2)", "total_predicted_cltv_impact": money("predicted_cents"),
     "high_affinity_customer_count": "count(distinct case when score_pct >= 70 then customer_key end)"},
    "is_current and product_active")

channel_behavior = MetricView(
    "sales customer channel",
    {"channel_name": "channel_name", "segment": "segment", "digital": "case when is_digital then 'Digital' else 'Physical' end"},
    {**ORDERS, "transactions_per_customer": PER_CUSTOMER}, "is_current and not is_return")

# Published bands and labels.
MOVED = "case when acquisition_channel = preferred_channel then 'Same Channel' else 'Migrated' end"
channel_migration = MetricView(
    "customer",
    {"acquisition": "acquisition_channel", "preferred": "preferred_channel", "segment": "segment", "migration_status": MOVED},
    {"customer_count": "count(distinct customer_key)", "average_cltv": "(avg(ltv_cents) / 1e2)", "total_cltv": money("ltv_cents"),
     "migration_rate": share("acquisition_channel <> preferred_channel")}, "is_current")

SEEN, ADDED, BOUGHT = ("count(distinct case when event_type = 'product_view' then session_id end)",
                       "count(distinct case when event_type = 'add_to_cart' then session_id end)",
                       "count(distinct case when has_purchase then session_id end)")
engagement_funnel = MetricView(
    "events_sales customer channel",
    {"segment": "segment", "channel_name": "channel_name", "month_name": "MONTHNAME(day)", "year": "year(day)"},
    {"total_sessions": "count(distinct session_id)", "views": SEEN, "add_to_cart": ADDED, "purchases": BOUGHT,
     "cart_conversion_rate": f"({ADDED} * 1e2 / nullif({SEEN}, 0))", "purchase_conversion_rate": f"({BOUGHT} * 1e2 / nullif({ADDED}, 0))",
     "overall_conversion_rate": f"({BOUGHT} * 1e2 / nullif({SEEN}, 0))"}, "is_current", since=90)

cart_abandonment = MetricView(
    "carts customer",
    {"segment": "segment", "abandonment_stage": "abandonment_stage",
     "recovery_status": "case when is_recovered then 'Recovered' when recovery_email_sent then 'Email Sent - Not Recovered' "
                        "else 'No Recovery Attempt' end"},
    {"total_carts": "count(*)", "abandoned_carts": count_if("not is_recovered"), "recovered_carts": count_if("is_recovered"),
     "abandonment_rate": share("not is_recovered"),
     "recovery_rate": f"({count_if('is_recovered')} * 1e2 / nullif({count_if('recovery_email_sent')}, 0))",
     "lost_revenue": money("case when is_recovered then 0 else cart_cents end"),
     "recovered_revenue": money("case when is_recovered then recovered_cents else 0 end"),
     "average_cart_value": "(avg(cart_cents) / 1e2)", "average_items_per_cart": "avg(items_count)"}, "is_current")

personalization_impact = MetricView(
    "affinity customer", {"segment": "segment", "affinity_level": LEVEL},
    {"customers_with_affinity": "count(distinct customer_key)", "average_affinity_score": SCORE,
     "total_purchases_from_affinity": sum_long("purchase_count"), "average_purchases_per_customer": "avg(purchase_count)",
     "average_predicted_cltv_impact": "(avg(predicted_cents) / 1e2)", "total_predicted_cltv_impact": money("predicted_cents"),
     "current_average_cltv": "(avg(ltv_cents) / 1e2)",
     "high_affinity_customer_count": "count(distinct case when score_pct >= 70 then customer_key end)"}, "is_current")

segment_trends = MetricView(
    "sales customer",
    {**CALENDAR, "quarter": "quarter(day)", "season": SEASON, "peak_season_indicator": PEAK, "segment": "segment"},
    {**ORDERS, "revenue_per_customer": "(sum(net_cents) / 1e2 / nullif(count(distinct customer_key), 0))"},
    "is_current and not is_return")

VIEWS = {"M03_inventory_current_status": current_status, "M04_inventory_stockout_risk": stockout_risk,
         "M05_inventory_overstock_analysis": overstock_analysis, "M06_inventory_value_summary": value_summary,
         "M07_inventory_reorder_management": reorder_management, "M08_inventory_movement_summary": movement_summary,
         "M09_inventory_stockout_impact": stockout_impact, "M10_inventory_location_comparison": location_comparison,
         "M11_inventory_trends_daily": trends_daily, "M12_inventory_health_score": health_score,
         "M14_customer_rfm_analysis": rfm_analysis,
         "M15_customer_purchase_summary": purchase_summary, "M16_product_affinity": product_affinity,
         "M17_channel_behavior": channel_behavior, "M18_channel_migration": channel_migration,
         "M19_engagement_funnel": engagement_funnel, "M20_cart_abandonment": cart_abandonment,
         "M21_personalization_impact": personalization_impact, "M22_segment_trends_daily": segment_trends}

for _name, _view in VIEWS.items():
    report(_name, _view.query())

flagship = report("M01_metric_view", purchase_summary.query(["segment", "channel_name"]))
report("M02_metric_query", purchase_summary.query(
    ["segment", "channel_name"], {"orders": "transaction_count", "revenue": "total_revenue", "customers": "unique_customers"},
    where="year >= 1997 and channel_name <> 'In-Store Kiosk'", having="orders > 10", extra={"months": "count(distinct month_name)"},
    post={"revenue_per_order": r2("revenue / orders", 2)}, order="revenue desc, segment, channel_name", limit=25))

# Published queries, in the order of the published notebooks.
LOC = ["location_name", "region"]
V, S, O, U, G = current_status, stockout_risk, overstock_analysis, value_summary, reorder_management
report("M23_status_by_location", V.query(LOC, ["total_quantity_available", "total_inventory_value_cost", "product_count"],
                                         order="total_inventory_value_cost desc, location_name"))
report("M23_stockouts_by_category", V.query(
    ["product_category"], ["stockout_product_count", "product_count"], where="stockout_status = 'Out of Stock'",
    post={"stockout_rate_pct": r2("stockout_product_count * 1e2 / product_count", 2)}, order="stockout_product_count desc, product_category"))
report("M23_top_margin_locations", V.query(
    LOC, ["total_margin_value", "total_inventory_value_cost", "total_inventory_value_retail"],
    post={"margin_pct": r2("total_margin_value / nullif(total_inventory_value_cost, 0) * 1e2", 2)},
    order="total_margin_value desc, location_name", limit=10))
report("M24_high_risk", S.query(["location_name", "product_category"], ["products_at_risk_count", "average_days_of_supply",
       "products_below_reorder_point_count"], where="risk_level = 'High Risk'", order="products_at_risk_count desc, location_name, product_category"))
report("M24_unscheduled", S.query([*LOC, "product_category"], ["products_with_no_replenishment_scheduled", "average_days_of_supply"],
       having="products_with_no_replenishment_scheduled > 0", order="products_with_no_replenishment_scheduled desc, location_name, product_category"))
report("M24_risk_by_region", S.query(["region", "risk_level"], {"total_products_at_risk": "products_at_risk_count",
       "avg_days_of_supply": "average_days_of_supply"}, order="region, risk_level"))
report("M25_severe", O.query(["location_name", "product_category"], ["overstock_product_count", "total_overstock_value_cost",
       "average_days_of_supply"], where="overstock_severity = 'Severe Overstock'", order="total_overstock_value_cost desc, location_name, product_category"))
report("M25_by_category", O.query(["product_category"], {"total_overstock_products": "overstock_product_count",
       "total_value_at_cost": "total_overstock_value_cost", "avg_days_of_supply": "average_days_of_supply"}, order="total_value_at_cost desc, product_category"))
report("M25_by_severity", O.query(["location_name", "overstock_severity"], {"products": "overstock_product_count",
       "total_units": "total_overstock_quantity", "total_cost_value": "total_overstock_value_cost"}, order="location_name, total_cost_value desc"))
report("M26_by_location", U.query(LOC, ["total_inventory_value_cost", "total_inventory_value_retail", "total_margin_value", "product_count"],
       order="total_inventory_value_cost desc, location_name"))
report("M26_by_category", U.query(["product_category_l1"], {"total_cost": "total_inventory_value_cost", "total_retail": "total_inventory_value_retail",
       "total_margin": "total_margin_value", "products": "product_count", "avg_value_per_product": "average_inventory_value_per_product"},
       order="total_cost desc, product_category_l1"))
report("M26_by_region", U.query(["region"], {"total_investment": "total_inventory_value_cost", "total_products": "product_count",
       "avg_margin_per_product": "average_margin_per_product"}, order="total_investment desc, region"))
report("M27_critical", G.query(["location_name", "product_category", "reorder_urgency"], ["products_needing_reorder_count",
       "total_reorder_quantity_needed"], where="reorder_urgency = 'Critical - No Schedule'",
       order="products_needing_reorder_count desc, location_name, product_category"))
report("M27_by_location", G.query(LOC, {"total_products": "products_needing_reorder_count", "total_units_to_reorder": "total_reorder_quantity_needed",
       "avg_days_until_restock": "average_days_until_replenishment"}, order="total_products desc, location_name"))
report("M27_delayed", G.query(["product_category"], {"delayed_products": "products_with_delayed_schedule_count",
       "avg_days_until_restock": "average_days_until_replenishment"}, having="delayed_products > 0", order="delayed_products desc, product_category"))
report("M28_by_type", movement_summary.query(["movement_type"], {"total_movements": "movement_count", "total_units": "total_quantity_moved",
       "total_cost": "total_movement_cost", "avg_units_per_movement": "average_movement_quantity"}, since=30, order="total_movements desc, movement_type"))
report("M28_returns_by_location", movement_summary.query(["location_name"], {"receipt_count": "movement_count",
       "total_units_received": "total_quantity_moved", "avg_cost_per_unit": "average_movement_cost_per_unit"},
       where="movement_type in ('receipt', 'transfer')", since=30, order="receipt_count desc, location_name"))
report("M28_top_reasons", movement_summary.query(["movement_reason", "movement_type"], {"total_movements": "movement_count",
       "total_units": "total_quantity_moved"}, since=7, order="total_movements desc, movement_reason", limit=10))
report("M29_total", stockout_impact.query([], {"total_lost_revenue": "total_lost_sales_revenue", "total_lost_units": "total_lost_sales_quantity",
       "total_stockout_events": "stockout_event_count", "avg_stockout_duration": "average_stockout_duration_days"}))
report("M29_by_location", stockout_impact.query(LOC, {"stockout_events": "stockout_event_count", "lost_revenue": "total_lost_sales_revenue",
       "lost_units": "total_lost_sales_quantity", "avg_duration_days": "average_stockout_duration_days"}, order="lost_revenue desc, location_name"))
report("M29_peak_by_category", stockout_impact.query(["product_category"], {"events": "stockout_event_count",
       "peak_season_lost_revenue": "peak_season_lost_revenue", "total_lost_revenue": "total_lost_sales_revenue"}, where="peak_season = 'Peak Season'",
       post={"peak_season_pct": r2("peak_season_lost_revenue / nullif(total_lost_revenue, 0) * 1e2", 2)}, order="peak_season_lost_revenue desc, product_category"))
report("M30_by_location", location_comparison.query([*LOC, "location_type"], ["product_count", "total_quantity_available",
       "total_inventory_value_cost", "stockout_rate", "overstock_rate", "average_days_of_supply"], order="stockout_rate desc, location_name"))
report("M30_by_region", location_comparison.query(["region"], {"total_products": "product_count", "avg_stockout_rate": "stockout_rate",
       "avg_overstock_rate": "overstock_rate", "avg_days_of_supply": "average_days_of_supply"},
       extra={"locations": "count(distinct location_name)"}, order="avg_stockout_rate, region"))
report("M30_by_type", location_comparison.query(["location_type"], {"avg_quantity_per_location": "total_quantity_available",
       "avg_stockout_rate": "stockout_rate", "avg_days_of_supply": "average_days_of_supply"},
       extra={"locations": "count(distinct location_name)"}, order="avg_stockout_rate, location_type"))
report("M31_last_30_days", trends_daily.query(["calendar_date"], {"total_units": "total_quantity_available", "total_value": "total_inventory_value_cost",
       "stockouts": "stockout_product_count", "avg_days_of_supply": "average_days_of_supply"}, since=30, order="calendar_date"))
report("M31_monthly", trends_daily.query(["year", "month_name"], {"avg_daily_units": "total_quantity_available",
       "avg_daily_value": "total_inventory_value_cost", "avg_daily_stockouts": "stockout_product_count",
       "avg_days_of_supply": "average_days_of_supply"}, order="year, month_name"))
report("M31_peak", trends_daily.query(["peak_season_indicator"], {"avg_quantity": "total_quantity_available", "avg_stockouts": "stockout_product_count",
       "avg_overstock": "overstock_product_count", "avg_days_of_supply": "average_days_of_supply"}, order="peak_season_indicator"))
H = health_score
report("M32_overall", H.query([], {"overall_health_score": "health_score", "total_products": "total_products",
       "total_stockouts": "stockout_product_count", "total_overstock": "overstock_product_count", "avg_stockout_rate": "stockout_rate",
       "avg_overstock_rate": "overstock_rate"}))
report("M32_by_status", H.query([*LOC, "health_status"], ["health_score", "stockout_rate", "overstock_rate", "average_days_of_supply"],
       order="health_score, location_name, health_status"))
report("M32_poor_categories", H.query(["product_category", "health_status"], {"products": "total_products", "avg_health_score": "health_score",
       "avg_stockout_rate": "stockout_rate", "high_risk_products": "high_risk_product_count"}, where="health_status in ('Critical', 'Poor')",
       order="avg_health_score, product_category"))
report("M32_by_region", H.query(["region"], {"avg_health_score": "health_score", "avg_stockout_rate": "stockout_rate",
       "avg_overstock_rate": "overstock_rate", "total_high_risk_products": "high_risk_product_count"},
       extra={"locations": "count(distinct location_name)"}, order="avg_health_score desc, region"))
report("M32_by_location", H.query(["location_name"], {"avg_health_score": "health_score", "avg_stockout_rate": "stockout_rate",
       "avg_overstock_rate": "overstock_rate", "total_high_risk_products": "high_risk_product_count"}, order="avg_health_score desc, location_name"))
C, P = customer_segmentation, purchase_summary
report("M33_segments", C.query(["segment"], {"customer_count": "customer_count", "avg_cltv": "average_lifetime_value",
       "total_cltv": "total_lifetime_value"}, order="avg_cltv desc, segment"))
report("M33_segment_region", C.query(["segment", "geo_region"], {"customer_count": "customer_count", "avg_cltv": "average_lifetime_value"},
       order="segment, customer_count desc, geo_region"))
report("M33_at_risk", rfm_analysis.query(["segment", "loyalty_status"], {"customer_count": "customer_count", "avg_recency": "average_recency_days",
       "avg_frequency": "average_frequency", "avg_monetary": "average_monetary_value"}, where="loyalty_status = 'At Risk'", order="customer_count desc, segment"))
report("M33_champions", rfm_analysis.query(["segment"], {"champion_count": "champions_count", "avg_value": "average_monetary_value"},
       order="champion_count desc, segment"))
report("M33_order_value", P.query(["segment"], {"transaction_count": "transaction_count", "avg_order_value": "average_order_value",
       "total_revenue": "total_revenue"}, order="avg_order_value desc, segment"))
report("M33_by_channel", P.query(["channel_name", "segment"], {"transactions": "transaction_count", "avg_order_value": "average_order_value",
       "frequency": "transactions_per_customer"}, order="channel_name, segment"))
report("M34_high_affinity", product_affinity.query(["category_level_1", "affinity_level"], {"customers": "customer_count",
       "avg_affinity": "average_affinity_score", "predicted_impact": "total_predicted_cltv_impact"}, where="affinity_level = 'High Affinity'",
       order="avg_affinity desc, category_level_1"))
report("M34_by_segment", product_affinity.query(["segment", "category_level_1"], {"avg_affinity": "average_affinity_score",
       "customer_count": "customer_count"}, order="segment, avg_affinity desc"))
report("M34_channels", channel_behavior.query(["channel_name", "digital"], {"unique_customers": "unique_customers", "transactions": "transaction_count",
       "revenue": "total_revenue", "avg_order_value": "average_order_value"}, order="revenue desc, channel_name"))
report("M34_migration", channel_migration.query(["acquisition", "preferred", "migration_status"], {"customer_count": "customer_count",
       "avg_cltv": "average_cltv", "migration_rate": "migration_rate"}, order="customer_count desc, acquisition, preferred"))
report("M35_funnel", engagement_funnel.query(["segment", "channel_name"], {"views": "views", "add_to_cart": "add_to_cart", "purchases": "purchases",
       "cart_conv_rate": "cart_conversion_rate", "purchase_conv_rate": "purchase_conversion_rate", "overall_conv_rate": "overall_conversion_rate"},
       order="overall_conv_rate desc, segment, channel_name"))
report("M35_abandonment", cart_abandonment.query(["segment", "abandonment_stage"], ["total_carts", "abandonment_rate", "recovery_rate",
       "lost_revenue", "recovered_revenue"], order="lost_revenue desc, segment"))
report("M35_personalization", personalization_impact.query(["segment", "affinity_level"], {"customers": "customers_with_affinity",
       "avg_affinity": "average_affinity_score", "predicted_impact": "total_predicted_cltv_impact", "current_cltv": "current_average_cltv"},
       order="predicted_impact desc, segment"))
report("M35_monthly_revenue", segment_trends.query(["segment", "year", "month_name"], {"revenue": "total_revenue", "transactions": "transaction_count",
       "customers": "unique_customers", "avg_order_value": "average_order_value"}, order="year desc, month_name, segment"))
report("M35_peak", segment_trends.query(["segment", "peak_season_indicator", "season"], {"revenue": "total_revenue",
       "avg_order_value": "average_order_value", "customers": "unique_customers"}, order="segment, peak_season_indicator, revenue desc"))
