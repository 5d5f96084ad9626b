"""Customer questions Q01-Q27, the median view M13 and the affinity and channel tables A01-A02."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfstar.functions.exprs import half_up
from shelfstar.functions.exprs import half_up_sql as r
from shelfstar.functions.exprs import money, steady_avg, sum_long
from shelfstar.functions.exprs import steady_avg_sql as steady
from shelfstar.functions.ranking import exact_percentiles, ntile
from shelfstar.operators import facts
from shelfstar.plans.metric_views import LOYALTY, count_if, customer_segmentation
from shelfstar.plans.registry import query, report
from shelfstar.plans.report import Report, for_check
from shelfstar.sources.tables import cut as written
from shelfstar.star import Star

AVG_CENTS = "(avg({}) / 1e2)"


def pct(part: str, whole: str, digits: int) -> str:
    return r(f"{part} * 1e2 / nullif({whole}, 0)", digits)


@query("A01_customer_product_affinity", """
    select customer_key, product_key, score_pct / 1e2 as affinity_score, purchase_count, view_count, cart_add_count,
      days_since_last_interaction, floor(view_to_purchase_ratio * 1e4 + 5e-1) / 1e4 as view_to_purchase_ratio,
      floor(cart_to_purchase_ratio * 1e4 + 5e-1) / 1e4 as cart_to_purchase_ratio,
      row_number() over (partition by customer_key order by score_pct desc, product_key) as recommendation_rank,
      predicted_cents / 1e2 as predicted_cltv_impact
    from affinity""")
def affinity_table(star: Star) -> DataFrame:
    return facts.ranked_affinity(star).select(
        "customer_key", "product_key", (F.col("score_pct") / 100.0).alias("affinity_score"), "purchase_count", "view_count",
        "cart_add_count", "days_since_last_interaction",
        half_up(F.col("view_to_purchase_ratio"), 4).alias("view_to_purchase_ratio"),
        half_up(F.col("cart_to_purchase_ratio"), 4).alias("cart_to_purchase_ratio"), "recommendation_rank",
        (F.col("predicted_cents") / 100.0).alias("predicted_cltv_impact"))


@query("A02_channel_performance", """
    select coalesce(s.channel_key, t.channel_key) as channel_key,
      cast(year(coalesce(s.day, t.day)) * 10000 + month(coalesce(s.day, t.day)) * 100 + day(coalesce(s.day, t.day)) as int) as date_key,
      coalesce(uc, 0) as unique_customers, coalesce(tc, 0) as transaction_count, coalesce(rev, 0) / 1e2 as total_revenue,
      coalesce(rev / n / 1e2, 0e0) as avg_order_value, coalesce(sc, 0) as session_count, coalesce(vc, 0) as visitor_count,
      case when sc > 0 then tc / sc else 0e0 end as conversion_rate, case when tc > 0 then ret / tc else 0e0 end as return_rate
    from (select channel_key, day, count(distinct customer_key) as uc, count(distinct transaction_id) as tc, sum(net_cents) as rev,
            count(*) as n, count(*) filter (where is_return) as ret from sales group by 1, 2) s
    full outer join (select channel_key, day, count(distinct session_id) as sc, count(distinct customer_key) as vc
                     from events_f group by 1, 2) t on s.channel_key = t.channel_key and s.day = t.day""")
def channel_table(star: Star) -> DataFrame:
    return facts.channel_performance(star)


@query("M13_customer_segmentation", """
    select segment, loyalty_tier, geo_region, acquisition_channel, count(distinct customer_key) as customer_count,
      avg(ltv_cents) / 1e2 as average_lifetime_value, sum(ltv_cents) / 1e2 as total_lifetime_value,
      min(ltv_cents) / 1e2 as min_lifetime_value, max(ltv_cents) / 1e2 as max_lifetime_value,
      quantile_cont(ltv_cents, 0.5) / 1e2 as median_lifetime_value
    from customer_d group by 1, 2, 3, 4""")
def segmentation(star: Star) -> DataFrame:
    """All measures from one histogram per group; a customer is one row of the dimension."""
    people = star.customer().where("is_current")
    return ltv_spread(people, list(customer_segmentation.dimensions), {
        "customer_count": "n", "average_lifetime_value": "avg", "total_lifetime_value": "sum", "min_lifetime_value": "min",
        "max_lifetime_value": "max", "median_lifetime_value": "median"})


def ltv_spread(people: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    n, v = F.col("_n"), F.col("ltv_cents")
    total = F.sum(v * n)
    stats = exact_percentiles(people, "ltv_cents", {"median": 0.5}, keys, {
        "n": F.sum(n), "avg": total / F.sum(n), "sum": total, "min": F.min(v), "max": F.max(v)})
    money_of = lambda c: F.col(c) if c == "n" else F.col(c) / 100.0
    return stats.select(*keys, *[money_of(c).alias(name) for name, c in names.items()])


@query("Q01_lifetime_value_tiers", f"""
    with m as (select customer_key, segment, ltv_cents, count(distinct transaction_id) as orders, sum(net_cents) as spent,
        avg(net_cents) / 1e2 as basket, date_diff('day', min(day), max(day)) as lifespan,
        count(*) filter (where is_return) * 1e2 / count(*) as return_rate
      from customer_d left join sales using (customer_key) group by 1, 2, 3),
    p as (select quantile_cont(ltv_cents, 0.25) as a, quantile_cont(ltv_cents, 0.5) as b, quantile_cont(ltv_cents, 0.75) as c,
        quantile_cont(ltv_cents, 0.9) as d from m)
    select case when ltv_cents >= d then 'VIP (Top 10%)' when ltv_cents >= c then 'High Value (75-90%)'
        when ltv_cents >= b then 'Mid Value (50-75%)' when ltv_cents >= a then 'Low Value (25-50%)'
        else 'Entry Level (Bottom 25%)' end as value_tier, segment, count(*) as customer_count, avg(orders) as avg_orders,
      avg(spent) / 1e2 as avg_revenue, {r(steady('basket'), 4)} as avg_basket_size, avg(lifespan) as avg_lifespan_days,
      {r(steady('return_rate'), 4)} as avg_return_rate
    from m cross join p group by 1, 2""")
def lifetime_value_tiers(star: Star) -> DataFrame:
    """Cut-offs are four exact percentiles (one row), used as literals."""
    people = star.customer().where("is_current").select("customer_key", "segment", "ltv_cents")
    cut = exact_percentiles(people, "ltv_cents", {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.9}).first()
    bought = star.sales().groupBy("customer_key").agg(
        F.countDistinct("transaction_id").alias("orders"), F.sum("net_cents").alias("spent"), F.count("*").alias("n"),
        F.datediff(F.max("day"), F.min("day")).alias("lifespan"), F.sum(F.col("is_return").cast("long")).alias("returns"))
    v = F.col("ltv_cents")
    tier = (F.when(v >= cut.d, "VIP (Top 10%)").when(v >= cut.c, "High Value (75-90%)").when(v >= cut.b, "Mid Value (50-75%)")
            .when(v >= cut.a, "Low Value (25-50%)").otherwise("Entry Level (Bottom 25%)"))
    rate = F.coalesce(F.col("returns") * 100.0 / F.col("n"), F.lit(0.0))
    return (people.join(bought, "customer_key", "left").groupBy(tier.alias("value_tier"), "segment").agg(
        F.count("*").alias("customer_count"), F.avg(F.coalesce("orders", F.lit(0))).alias("avg_orders"),
        (F.avg("spent") / 100.0).alias("avg_revenue"),
        half_up(steady_avg(F.col("spent") / F.col("n") / 100.0), 4).alias("avg_basket_size"),
        F.avg("lifespan").alias("avg_lifespan_days"), half_up(steady_avg(rate), 4).alias("avg_return_rate")))


@query("Q02_channel_journey", """
    with j as (select customer_key, acquisition_channel, preferred_channel, channel_category,
        row_number() over (partition by customer_key order by day, transaction_id, line_number, net_cents) as i,
        count(*) over (partition by customer_key) as n
      from sales join customer_d using (customer_key) join channel_d using (channel_key))
    select acquisition_channel, preferred_channel, channel_category as current_channel, count(distinct customer_key) as customers,
      count(*) filter (where i = 1) * 1e2 / count(*) as pct_first_purchase,
      count(*) filter (where i = n) * 1e2 / count(*) as pct_last_purchase, avg(n) as avg_purchases_per_customer
    from j group by 1, 2, 3 having count(*) > 5""")
def channel_journey(star: Star) -> DataFrame:
    """First and last purchase come from min/max of (day, order), so no customer is sorted in one task."""
    when = F.struct("day", "transaction_id")
    per = (star.sales().join(star.channel().select("channel_key", "channel_category"), "channel_key")
           .groupBy("customer_key", "channel_category").agg(F.count("*").alias("n"), F.min(when).alias("lo"), F.max(when).alias("hi")))
    w = Window.partitionBy("customer_key")  # at most one row per channel category
    first, last = F.col("lo") == F.min("lo").over(w), F.col("hi") == F.max("hi").over(w)
    per = per.select("customer_key", "channel_category", "n", first.cast("long").alias("f"), last.cast("long").alias("l"),
                     F.sum("n").over(w).alias("total"))
    who = star.customer().where("is_current").select("customer_key", "acquisition_channel", "preferred_channel")
    n = F.sum("n")
    return (per.join(who, "customer_key").groupBy("acquisition_channel", "preferred_channel", F.col("channel_category").alias("current_channel"))
            .agg(F.countDistinct("customer_key").alias("customers"), (F.sum("f") * 100.0 / n).alias("pct_first_purchase"),
                 (F.sum("l") * 100.0 / n).alias("pct_last_purchase"),
                 (F.sum(F.col("n") * F.col("total")) / n).alias("avg_purchases_per_customer"), n.alias("lines"))
            .where("lines > 5").drop("lines"))


# Published bands and labels.
RFM_LABEL = """case when r_score >= 4 and f_score >= 4 and m_score >= 4 then 'Champions'
    when r_score >= 3 and f_score >= 3 and m_score >= 4 then 'Loyal Customers'
    when r_score >= 3 and f_score <= 2 and m_score >= 3 then 'Potential Loyalists'
    when r_score >= 4 and f_score <= 2 then 'New Customers' when r_score <= 2 and f_score >= 3 then 'At Risk'
    when r_score <= 2 and f_score <= 2 and m_score >= 3 then 'Cant Lose Them'
    when r_score <= 2 and f_score <= 2 and m_score <= 2 then 'Lost' else 'Others' end"""


@query("Q03_rfm_scores", f"""
    with gaps as (select customer_key, transaction_id, day, net_cents,
        lead(day) over (partition by customer_key order by day) as next_day from sales where not is_return),
    c as (select customer_key, count(distinct transaction_id) as frequency, date_diff('day', max(day), (select d from horizon)) as recency,
        sum(net_cents) as monetary, avg(date_diff('day', day, next_day)) as cycle from gaps group by 1),
    s as (select *, ntile(5) over (order by recency desc, customer_key) as r_score, ntile(5) over (order by frequency, customer_key) as f_score,
        ntile(5) over (order by monetary, customer_key) as m_score from c)
    select {RFM_LABEL} as rfm_segment, count(*) as customer_count, avg(frequency) as avg_frequency, avg(recency) as avg_recency_days,
      avg(monetary) / 1e2 as avg_monetary, {r(steady('cycle'), 4)} as avg_purchase_cycle_days
    from s group by 1""")
def rfm_scores(star: Star) -> DataFrame:
    """Mean gap between purchases telescopes to (last - first) / (lines - 1); tiles are ranked block-wise."""
    span, n = F.datediff(F.max("day"), F.min("day")), F.count("*")
    c = star.sales().where(~F.col("is_return")).groupBy("customer_key").agg(
        F.countDistinct("transaction_id").alias("frequency"), (-F.datediff(F.lit(star.as_of), F.max("day"))).alias("freshness"),
        F.sum("net_cents").alias("monetary"), F.when(n > 1, span / F.nullif(n - 1, F.lit(0))).alias("cycle"))
    c = written(c, "customers")
    rows = c.count()
    for value, score in {"freshness": "r_score", "frequency": "f_score", "monetary": "m_score"}.items():
        c = ntile(c, 5, value, "customer_key", score, rows)
    return c.groupBy(F.expr(RFM_LABEL).alias("rfm_segment")).agg(
        F.count("*").alias("customer_count"), F.avg("frequency").alias("avg_frequency"),
        F.avg(-F.col("freshness")).alias("avg_recency_days"), (F.avg("monetary") / 100.0).alias("avg_monetary"),
        half_up(steady_avg(F.col("cycle")), 4).alias("avg_purchase_cycle_days"))


def category_pairs(star: Star) -> DataFrame:
    """Pairs of categories of one basket. A basket is first reduced to one row per category, so the
    pairs come from at most as many entries as there are categories, never from its lines."""
    p = star.product().select("product_key", F.col("category_level_2").alias("category"))
    cells = (star.sales().where(~F.col("is_return")).join(p, "product_key").groupBy("transaction_id", "customer_key", "category")
             .agg(F.sum("net_cents").alias("rev")))
    basket = cells.groupBy("transaction_id", "customer_key").agg(
        F.sort_array(F.collect_list(F.struct("category", "rev"))).alias("c")).where(F.size("c") > 1)
    i = basket.select("transaction_id", "customer_key", "c", F.posexplode("c").alias("i", "a"))
    return i.select("customer_key", "a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b")).select(
        "customer_key", F.col("a.category").alias("category_1"), F.col("b.category").alias("category_2"),
        (F.col("a.rev") + F.col("b.rev")).alias("rev"))


_PAIRS = """select x.transaction_id, x.customer_key, x.category as category_1, y.category as category_2, x.rev + y.rev as rev
    from {c} x join {c} y on x.transaction_id = y.transaction_id and x.category < y.category"""
_CELLS = """(select transaction_id, customer_key, category_level_2 as category, sum(net_cents) as rev
    from sales join product_d using (product_key) where not is_return group by 1, 2, 3)"""


@query("Q04_category_pairs", f"""
    select category_1, category_2, count(*) as co_occurrence_count, count(distinct customer_key) as unique_customers,
      floor(avg(rev) + 5e-1) / 1e2 as avg_combined_revenue,
      floor(count(*) * 1e2 / (select count(distinct transaction_id) from sales) * 1e2 + 5e-1) / 1e2 as basket_percentage
    from ({_PAIRS.format(c=_CELLS)}) t group by 1, 2 having count(*) > 10 order by 3 desc, 1, 2 limit 20""")
def basket_pairs(star: Star) -> DataFrame:
    baskets = star.sales().agg(F.countDistinct("transaction_id")).first()[0]
    n = F.count("*")
    return (category_pairs(star).groupBy("category_1", "category_2").agg(
        n.alias("co_occurrence_count"), F.countDistinct("customer_key").alias("unique_customers"),
        (F.floor(F.avg("rev") + 0.5) / 100.0).alias("avg_combined_revenue"),
        half_up(n * 100.0 / F.lit(baskets), 2).alias("basket_percentage"))
        .where("co_occurrence_count > 10").orderBy(F.desc("co_occurrence_count"), "category_1", "category_2").limit(20))


@query("Q18_category_co_purchase", f"""
    select category_1 as category1, category_2 as category2, count(*) as co_occurrence_count
    from ({_PAIRS.format(c=_CELLS)}) t group by 1, 2 order by 3 desc, 1, 2 limit 20""")
def co_purchase(star: Star) -> DataFrame:
    return (category_pairs(star).groupBy(F.col("category_1").alias("category1"), F.col("category_2").alias("category2"))
            .agg(F.count("*").alias("co_occurrence_count"))
            .orderBy(F.desc("co_occurrence_count"), "category1", "category2").limit(20))


@query("Q05_channel_funnel", f"""
    select channel_category, count(distinct customer_key) as unique_visitors, cast(sum(v) as bigint) as total_product_views,
      cast(sum(c) as bigint) as total_add_to_carts, cast(sum(p) as bigint) as total_purchases,
      {pct('sum(c)', 'sum(v)', 2)} as view_to_cart_pct, {pct('sum(p)', 'sum(c)', 2)} as cart_to_purchase_pct,
      {pct('sum(p)', 'sum(v)', 2)} as overall_conversion_pct, {r(steady('t'), 0)} as avg_seconds_engaged
    from (select customer_key, event_type, channel_key, channel_category, count(*) filter (where event_type = 'product_view') as v,
            count(*) filter (where event_type = 'add_to_cart') as c, count(*) filter (where event_type = 'checkout_complete') as p,
            avg(time_on_page) as t
          from events_f join channel_d using (channel_key) group by 1, 2, 3, 4) e group by 1""")
def channel_funnel(star: Star) -> DataFrame:
    e = star.events().join(star.channel().select("channel_key", "channel_category"), "channel_key")
    per = e.groupBy("customer_key", "event_type", "channel_key", "channel_category").agg(
        F.count("*").alias("n"), F.avg("time_on_page").alias("t"))

    def total(kind: str):
        return F.sum(F.when(F.col("event_type") == kind, F.col("n")).otherwise(F.lit(0)))

    def rate(a, b):
        return half_up(a * 100.0 / F.nullif(b, F.lit(0)), 2)

    v, c, p = total("product_view"), total("add_to_cart"), total("checkout_complete")
    return per.groupBy("channel_category").agg(
        F.countDistinct("customer_key").alias("unique_visitors"), v.alias("total_product_views"), c.alias("total_add_to_carts"),
        p.alias("total_purchases"), rate(c, v).alias("view_to_cart_pct"), rate(p, c).alias("cart_to_purchase_pct"),
        rate(p, v).alias("overall_conversion_pct"), half_up(steady_avg(F.col("t")), 0).alias("avg_seconds_engaged"))


report("Q06_abandonment_recovery", Report(
    "carts", {"abandonment_week": "WEEK0(day)", "abandonment_stage": "abandonment_stage"},
    {"total_abandonments": "count(*)", "total_abandoned_value": money("cart_cents"), "avg_cart_value": r("avg(cart_cents) / 1e2", 2),
     "avg_items": r("avg(items_count)", 1),
     "email_open_rate": pct(count_if("recovery_email_opened"), count_if("recovery_email_sent"), 1),
     "email_click_rate": pct(count_if("recovery_email_clicked"), count_if("recovery_email_opened"), 1),
     "recovery_rate": pct(count_if("is_recovered"), "count(*)", 1), "recovered_revenue": money("recovered_cents"),
     "revenue_recovery_rate": pct("sum(recovered_cents)", "sum(cart_cents)", 1)},
    order="abandonment_week desc, total_abandonments desc"))


@query("Q07_personalization_effect", f"""
    select segment, preferred_category, count(*) as customer_count, {r('avg(products)', 1)} as avg_products_interested,
      {r(steady('score'), 3)} as avg_affinity_score, {r('avg(bought)', 1)} as avg_purchases, {r('avg(viewed)', 1)} as avg_product_views,
      {r(steady('conv') + ' * 1e2', 2)} as conversion_rate_pct, {r(steady('impact'), 2)} as predicted_cltv_impact
    from (select customer_key, segment, preferred_category, count(distinct product_key) as products, avg(score_pct) / 1e2 as score,
            sum(purchase_count) as bought, sum(view_count) as viewed,
            avg(floor(view_to_purchase_ratio * 1e4 + 5e-1)) / 1e4 as conv, avg(predicted_cents) / 1e2 as impact
          from affinity join customer_d using (customer_key) group by 1, 2, 3) t group by 1, 2""")
def personalization_effect(star: Star) -> DataFrame:
    per = facts.affinity(star).groupBy("customer_key").agg(
        F.count("*").alias("products"), (F.avg("score_pct") / 100.0).alias("score"), F.sum("purchase_count").alias("bought"),
        F.sum("view_count").alias("viewed"),
        (F.avg(F.floor(F.col("view_to_purchase_ratio") * 1e4 + 0.5)) / 1e4).alias("conv"), (F.avg("predicted_cents") / 100.0).alias("impact"))
    who = star.customer().where("is_current").select("customer_key", "segment", "preferred_category")
    return per.join(who, "customer_key").groupBy("segment", "preferred_category").agg(
        F.count("*").alias("customer_count"), half_up(F.avg("products"), 1).alias("avg_products_interested"),
        half_up(steady_avg(F.col("score")), 3).alias("avg_affinity_score"), half_up(F.avg("bought"), 1).alias("avg_purchases"),
        half_up(F.avg("viewed"), 1).alias("avg_product_views"), half_up(steady_avg(F.col("conv")) * 100.0, 2).alias("conversion_rate_pct"),
        half_up(steady_avg(F.col("impact")), 2).alias("predicted_cltv_impact"))


# Published bands and labels.
DIVERSITY = ("case when l2 >= 5 then 'Highly Diverse' when l2 >= 3 then 'Moderately Diverse' when l2 = 2 then 'Limited Diversity' "
             "else 'Single Category' end")


@query("Q08_category_diversity", f"""
    select {DIVERSITY} as customer_diversity, count(*) as customer_count, avg(l1) as avg_l1_categories, avg(l2) as avg_l2_categories,
      avg(bought) as avg_purchases, avg(rev) / 1e2 as avg_revenue, {r(steady('top') + ' * 1e2', 4)} as avg_revenue_concentration_pct
    from (select customer_key, count(distinct category_level_1) as l1, count(distinct category_level_2) as l2, sum(n) as bought,
            sum(rev) as rev, max(rev) / nullif(sum(rev), 0) as top
          from (select customer_key, category_level_1, category_level_2, count(distinct transaction_id) as n, sum(net_cents) as rev
                from sales join product_d using (product_key) where not is_return group by 1, 2, 3) c group by 1) t group by 1""")
def category_diversity(star: Star) -> DataFrame:
    cells = (star.sales().where(~F.col("is_return"))
             .join(star.product().select("product_key", "category_level_1", "category_level_2"), "product_key")
             .groupBy("customer_key", "category_level_1", "category_level_2")
             .agg(F.countDistinct("transaction_id").alias("n"), F.sum("net_cents").alias("rev")))
    per = cells.groupBy("customer_key").agg(
        F.size(F.collect_set("category_level_1")).alias("l1"), F.size(F.collect_set("category_level_2")).alias("l2"),
        F.sum("n").alias("bought"), F.sum("rev").alias("rev"), (F.max("rev") / F.nullif(F.sum("rev"), F.lit(0))).alias("top"))
    return per.groupBy(F.expr(DIVERSITY).alias("customer_diversity")).agg(
        F.count("*").alias("customer_count"), F.avg("l1").alias("avg_l1_categories"), F.avg("l2").alias("avg_l2_categories"),
        F.avg("bought").alias("avg_purchases"), (F.avg("rev") / 100.0).alias("avg_revenue"),
        half_up(steady_avg(F.col("top")) * 100.0, 4).alias("avg_revenue_concentration_pct"))


@query("Q09_cohort_retention", f"""
    with r as (select cast(date_trunc('month', acquisition_date) as date) as cohort_month, acquisition_channel,
        (year(day) - year(acquisition_date)) * 12 + month(day) - month(acquisition_date) as months_since_acquisition,
        count(distinct customer_key) as active_customers, sum(net_cents) as cents
      from sales join customer_d using (customer_key) where not is_return group by 1, 2, 3),
    k as (select * from r where months_since_acquisition <= 60)
    select cohort_month, acquisition_channel, months_since_acquisition, active_customers, first_value(active_customers) over w as cohort_size,
      {r('active_customers * 1e2 / first_value(active_customers) over w', 1)} as retention_rate, cents / 1e2 as monthly_revenue,
      {r('cents / 1e2 / nullif(active_customers, 0)', 2)} as revenue_per_customer
    from k window w as (partition by cohort_month, acquisition_channel order by months_since_acquisition)""")
def cohort_retention(star: Star) -> DataFrame:
    who = star.customer().where("is_current").select("customer_key", "acquisition_channel", "acquisition_date")
    months = (F.year("day") - F.year("acquisition_date")) * 12 + F.month("day") - F.month("acquisition_date")
    cohort = F.trunc("acquisition_date", "MM").cast("date")
    active = (star.sales().where(~F.col("is_return")).join(who, "customer_key")
              .groupBy(cohort.alias("cohort_month"), "acquisition_channel", months.alias("months_since_acquisition"))
              .agg(F.countDistinct("customer_key").alias("active_customers"), F.sum("net_cents").alias("cents"))
              .where("months_since_acquisition <= 60"))
    w = Window.partitionBy("cohort_month", "acquisition_channel").orderBy("months_since_acquisition")
    size = F.first("active_customers").over(w)
    return active.select("cohort_month", "acquisition_channel", "months_since_acquisition", "active_customers",
                         size.alias("cohort_size"), half_up(F.col("active_customers") * 100.0 / size, 1).alias("retention_rate"),
                         (F.col("cents") / 100.0).alias("monthly_revenue"),
                         half_up(F.col("cents") / 100.0 / F.nullif("active_customers", F.lit(0)), 2).alias("revenue_per_customer"))


# Published bands and labels.
STATUS = ("case when idle <= 30 then 'Active' when idle <= 90 then 'Cooling' when idle <= 180 then 'At Risk' "
          "when idle <= 365 then 'Dormant' else 'Lost' end")


@query("Q10_reactivation", f"""
    select {STATUS} as customer_status, segment, count(*) as customer_count, avg(ltv_cents) / 1e2 as avg_ltv, avg(orders) as avg_total_orders,
      avg(spent) / 1e2 as avg_total_spent, {r(steady('basket'), 4)} as avg_basket_size, avg(idle) as avg_days_inactive,
      sum(ltv_cents) / 1e2 as total_ltv_at_risk,
      {r(steady('orders * 3e1 / nullif(age, 0)'), 4)} as avg_expected_monthly_orders
    from (select customer_key, segment, ltv_cents, date_diff('day', max(day), (select d from horizon)) as idle,
            date_diff('day', (select d0 from horizon), max(day)) as age,
            count(distinct transaction_id) as orders, sum(net_cents) as spent, avg(net_cents) / 1e2 as basket
          from sales join customer_d using (customer_key) where not is_return group by 1, 2, 3) t group by 1, 2""")
def reactivation(star: Star) -> DataFrame:
    last = F.max("day")
    per = star.sales().where(~F.col("is_return")).groupBy("customer_key").agg(
        F.datediff(F.lit(star.as_of), last).alias("idle"), F.datediff(last, F.lit(star.first_day)).alias("age"),
        F.countDistinct("transaction_id").alias("orders"), F.sum("net_cents").alias("spent"), (F.avg("net_cents") / 100.0).alias("basket"))
    who = star.customer().where("is_current").select("customer_key", "segment", "ltv_cents")
    return per.join(who, "customer_key").groupBy(F.expr(STATUS).alias("customer_status"), "segment").agg(
        F.count("*").alias("customer_count"), (F.avg("ltv_cents") / 100.0).alias("avg_ltv"), F.avg("orders").alias("avg_total_orders"),
        (F.avg("spent") / 100.0).alias("avg_total_spent"), half_up(steady_avg(F.col("basket")), 4).alias("avg_basket_size"),
        F.avg("idle").alias("avg_days_inactive"), (F.sum("ltv_cents") / 100.0).alias("total_ltv_at_risk"),
        half_up(steady_avg(F.col("orders") * 30.0 / F.nullif("age", F.lit(0))), 4).alias("avg_expected_monthly_orders"))


report("Q11_size_fit_returns", Report(
    "sizefit customer product", {"category_level_2": "category_level_2", "fit_description": "fit_description"},
    {"order_count": "count(*)", "returns": count_if("is_returned"), "return_rate": pct(count_if("is_returned"), "count(*)", 1),
     "unique_customers": "count(distinct customer_key)", "correct_size_orders": count_if("ordered_size = kept_size"),
     "size_accuracy_rate": pct(count_if("ordered_size = kept_size"), "count(*)", 1)}, "is_current", having="order_count > 10"))

BY_SEGMENT = {"segment": "segment"}
LTV = AVG_CENTS.format("ltv_cents")
report("Q12_segment_counts", Report("customer", BY_SEGMENT, {"customer_count": "count(*)"}, "is_current", order="customer_count desc, segment"))
report("Q12_segment_value", Report("customer", BY_SEGMENT, {"avg_cltv": LTV, "customer_count": "count(*)"}, "is_current"))


@query("Q12_segment_spread", """
    select segment, count(*) as customer_count, avg(ltv_cents) / 1e2 as avg_cltv, min(ltv_cents) / 1e2 as min_cltv,
      max(ltv_cents) / 1e2 as max_cltv, quantile_cont(ltv_cents, 0.5) / 1e2 as median_cltv from customer_d group by 1""")
def segment_spread(star: Star) -> DataFrame:
    return ltv_spread(star.customer().where("is_current"), ["segment"], {
        "customer_count": "n", "avg_cltv": "avg", "min_cltv": "min", "max_cltv": "max", "median_cltv": "median"})


SOLD = "is_current and not is_return"
report("Q13_order_value_and_frequency", Report(
    "sales customer", BY_SEGMENT, {"avg_transactions_per_customer": "(count(distinct transaction_id) * 1e0 / count(distinct customer_key))",
                                   "avg_order_value": AVG_CENTS.format("net_cents")}, SOLD))
report("Q14_purchase_frequency", Report("sales", {"customer_key": "customer_key"},
                                        {"purchase_frequency": "count(distinct transaction_id)"}, "not is_return"))
report("Q15_loyalty_status", Report(
    "rfm customer", {"customer_key": "customer_key", "segment": "segment", "recency_days": "recency_days", "frequency": "frequency",
                     "monetary_value": "(monetary_cents / 1e2)", "loyalty_status": LOYALTY}, {}, "is_current", since=365,
    post={"rank": "case loyalty_status when 'At Risk' then 1 when 'Champion' then 2 when 'Loyal' then 3 else 4 end"},
    order="rank, recency_days desc", keep=["customer_key", "segment", "recency_days", "frequency", "monetary_value", "loyalty_status"]))
report("Q16_recent_frequent_high_spend", Report(
    "rfm customer", {"customer_id": "customer_id", "segment": "segment", "recency": "recency_days", "frequency": "frequency",
                     "monetary": "(monetary_cents / 1e2)"}, {},
    "is_current and recency_days <= 30 and frequency >= 5 and monetary_cents >= 100000", order="monetary desc"))
report("Q17_trending_products", Report(
    "sales product", {"product_name": "product_name", "category_level_2": "category_level_2"},
    {"purchase_count": "count(distinct transaction_id)", "total_quantity": sum_long("quantity"), "total_revenue": money("net_cents"),
     "unique_customers": "count(distinct customer_key)"}, "not is_return and product_active", since=30,
    order="purchase_count desc, product_name", limit=20))
SCORES = {"avg_affinity_score": AVG_CENTS.format("score_pct"), "customer_count": "count(distinct customer_key)",
          "total_purchases": sum_long("purchase_count")}
report("Q19_high_affinity_products", Report(
    "affinity product", {"product_name": "product_name", "category_level_2": "category_level_2"}, SCORES,
    "score_pct > 5 and product_active", order="avg_affinity_score desc, total_purchases desc, product_name", limit=20))
report("Q19_category_affinity", Report(
    "affinity customer product", {**BY_SEGMENT, "category_level_2": "category_level_2"}, SCORES, "is_current and product_active"))
report("Q20_channel_preference", Report(
    "sales channel customer", {"channel_name": "channel_name"},
    {"unique_customers": "count(distinct customer_key)", "transaction_count": "count(distinct transaction_id)",
     "total_revenue": money("net_cents"), "avg_order_value": AVG_CENTS.format("net_cents")}, SOLD))
report("Q20_channel_flow", Report(
    "customer", {"acquisition_channel": "acquisition_channel", "preferred_channel": "preferred_channel"},
    {"customer_count": "count(*)", "avg_cltv": LTV}, "is_current"))


def stages(flag: str) -> dict[str, str]:
    return {"s1": "count(distinct case when event_type = 'product_view' then session_id end)",
            "s2": "count(distinct case when event_type = 'add_to_cart' then session_id end)",
            "s3": f"count(distinct case when {flag} then session_id end)"}


def rate(a: str, b: str) -> str:
    return f"{a} * 1e0 / nullif({b}, 0) * 1e2"


report("Q21_funnel_conversion", Report(
    "events_sales", {}, dict(zip(("views", "add_to_cart", "purchases"), stages("has_any_sale").values())), since=30,
    post={"cart_conversion_rate": rate("add_to_cart", "views"), "purchase_conversion_rate": rate("purchases", "add_to_cart"),
          "overall_conversion_rate": rate("purchases", "views")}))
report("Q22_funnel_drop_off", Report(
    "events_sales", {}, dict(zip(("stage1_views", "stage2_cart", "stage3_purchase"), stages("has_purchase").values())), since=30,
    post={"drop_off_views_to_cart": "stage1_views - stage2_cart", "drop_off_cart_to_purchase": "stage2_cart - stage3_purchase",
          "drop_off_rate_views_to_cart": rate("(stage1_views - stage2_cart)", "stage1_views"),
          "drop_off_rate_cart_to_purchase": rate("(stage2_cart - stage3_purchase)", "stage2_cart")}))
LOST, BACK, SENT = count_if("not is_recovered"), count_if("is_recovered"), count_if("recovery_email_sent")
CART_VALUE = AVG_CENTS.format("cart_cents")
report("Q23_abandonment_rate", Report("carts", {}, {"total_carts": "count(*)", "abandoned_carts": LOST, "abandonment_rate": f"({rate(LOST, 'count(*)')})"}))
report("Q23_campaign_effect", Report("carts", {}, {
    "total_abandonments": "count(*)", "recovery_emails_sent": SENT, "recovery_conversions": BACK,
    "abandonment_rate": f"({rate(LOST, 'count(*)')})", "recovery_conversion_rate": f"({rate(BACK, SENT)})"}))
report("Q23_abandonment_by_segment", Report("carts customer", BY_SEGMENT, {
    "total_abandonments": "count(*)", "abandoned_carts": LOST, "abandonment_rate": f"({rate(LOST, 'count(*)')})", "avg_cart_value": CART_VALUE}, "is_current"))
WON = "case when is_recovered then cart_cents else 0 end"
report("Q24_revenue_recovery", Report("carts", {}, {
    "total_abandonments": "count(*)", "total_abandoned_value": money("cart_cents"), "recovered_revenue": money(WON),
    "revenue_recovery_rate": f"(sum({WON}) * 1e2 / nullif(sum(cart_cents), 0))"}))
IMPACT = AVG_CENTS.format("predicted_cents")
report("Q25_personalization_response", Report("affinity customer", BY_SEGMENT, {
    "avg_affinity_score": AVG_CENTS.format("score_pct"), "customers_with_affinity": "count(distinct customer_key)",
    "total_purchases": sum_long("purchase_count"), "avg_predicted_cltv_impact": IMPACT}, "is_current and score_pct > 5"))
report("Q25_targeting_impact", Report("affinity customer", BY_SEGMENT, {
    "targeted_customers": "count(distinct customer_key)", "total_predicted_cltv_impact": money("predicted_cents"),
    "avg_predicted_cltv_impact": IMPACT, "current_avg_cltv": LTV}, "is_current and score_pct > 5"))

# Published bands and labels.
RISK = ("case when low_inventory_abandonments > 10 and recent_demand > 100 then 'Stockout Risk' when recent_demand < 10 "
        "then 'Overstock Risk' else 'Normal' end")


@query("Q26_demand_versus_low_stock", for_check(f"""
    select *, {RISK} as risk_level from (
      select product_name, category_level_2, count(distinct transaction_id) as recent_purchase_count,
        cast(sum(quantity) as bigint) as recent_demand,
        (select count(*) from carts c join customer_d u using (customer_key) where c.low_inventory_trigger
           and u.preferred_category = s.category_level_2) as low_inventory_abandonments
      from (select * from sales join product_d using (product_key) where not is_return and product_active
            and day >= {{asof}} - 30) s group by product_key, product_name, category_level_2) t
    where low_inventory_abandonments > 0 or recent_demand < 10"""))
def demand_versus_low_stock(star: Star) -> DataFrame:
    """The correlated count per category is one small aggregate, joined."""
    low = (facts.carts(star).where("low_inventory_trigger").join(star.customer().select("customer_key", "preferred_category"), "customer_key")
           .groupBy(F.col("preferred_category").alias("category_level_2")).agg(F.count("*").alias("low")))
    p = star.product().where("product_active").select("product_key", "product_name", "category_level_2")
    recent = (star.sales(star.days_back(30)).where(~F.col("is_return")).groupBy("product_key")
              .agg(F.countDistinct("transaction_id").alias("recent_purchase_count"), F.sum("quantity").alias("recent_demand")))
    return (recent.join(p, "product_key").join(low, "category_level_2", "left")
            .select("product_name", "category_level_2", "recent_purchase_count", "recent_demand",
                    F.coalesce("low", F.lit(0)).alias("low_inventory_abandonments"))
            .withColumn("risk_level", F.expr(RISK)).where("low_inventory_abandonments > 0 or recent_demand < 10"))


BY_STAGE = {"abandonment_stage": "abandonment_stage"}
report("Q27_abandonment_by_stage", Report("carts", BY_STAGE, {
    "abandonment_count": "count(*)", "low_inventory_abandonments": count_if("low_inventory_trigger")}))
report("Q27_abandonment_value_by_stage", Report("carts", BY_STAGE, {
    "abandonment_count": "count(*)", "avg_cart_value": CART_VALUE, "low_inventory_abandonments": count_if("low_inventory_trigger")}))
