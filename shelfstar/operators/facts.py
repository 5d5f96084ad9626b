"""Facts derived from sales, events and stock: pricing, carts, affinity, channels, forecast, fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfstar.config import (DIGITAL_RETURN_FACTOR, MONTH_FACTOR, SEGMENT_RULES, STORE_RETURN_FACTOR)
from shelfstar.functions.distinct import grouped
from shelfstar.functions.exprs import date_key
from shelfstar.functions.ranking import row_number_in_blocks
from shelfstar.operators import ledger
from shelfstar.star import CHANNELS, SEASON_OF_DAY, TOP_SIZES, Star, nth, stored

REASONS = ["high_shipping", "price_concern", "comparison_shopping", "technical_issue", "payment_issue"]
KEPT_REASONS = ["changed_mind", "found_better_price", "quality_issue"]
SALE_MONTHS = (1, 2, 3, 5, 7, 9, 11, 12)


def priced_lines(star: Star) -> DataFrame:
    """Discount by precedence clearance > promotion > segment, then net, tax and margin in cents.

    Where the reference draws a random percentage, the line's own keys give a repeatable one.
    """
    mix = (F.col("transaction_id") * 7 + F.col("line_number") * 13) % 100

    def rule(field: str):
        pairs = [F.when(F.col("segment") == seg, F.lit(getattr(r, field))) for seg, r in SEGMENT_RULES.items()]
        return F.coalesce(*pairs, F.lit(getattr(SEGMENT_RULES["HOUSEHOLD"], field)))

    clearance = (F.col("season_code") != F.expr(SEASON_OF_DAY)) & (mix < 20)
    promotion = F.month("day").isin(*SALE_MONTHS) & (mix % 10 < 3)
    by_segment = mix < rule("discount_probability")
    pct = (F.when(clearance, 30 + mix % 21).when(promotion, 10 + mix % 21)
           .when(by_segment, rule("discount_low") + mix % (rule("discount_high") - rule("discount_low") + 1))
           .otherwise(F.lit(0)))
    base = star.sales().select("transaction_id", "line_number", "customer_key", "product_key", "location_key", "day",
                               "quantity", "is_return")
    joined = (base.join(star.product().select("product_key", "price_cents", "unit_cost_cents", "season_code"), "product_key")
              .join(star.customer().select("customer_key", "segment"), "customer_key")
              .join(star.location().select("location_key", "tax_rate_e5"), "location_key"))
    return (joined.withColumn("is_clearance", clearance).withColumn("is_promotional", promotion)
            .withColumn("discount_pct", pct.cast("int"))
            .withColumn("discount_cents", F.expr("price_cents * discount_pct div 100"))
            .withColumn("net_cents", F.expr("(price_cents - discount_cents) * quantity"))
            .withColumn("tax_cents", F.expr("net_cents * tax_rate_e5 div 100000"))
            .withColumn("margin_cents", F.expr("net_cents - quantity * unit_cost_cents"))
            .select("transaction_id", "line_number", "customer_key", "product_key", "location_key", "day", "quantity",
                    "segment", "is_clearance", "is_promotional", "discount_pct", "discount_cents", "net_cents",
                    "tax_cents", "margin_cents", "is_return"))


def season_multiplier(days: DataFrame) -> DataFrame:
    """Product of the calendar multipliers for a date dimension."""
    month = F.coalesce(*[F.when(F.col("month") == m, F.lit(f)) for m, f in MONTH_FACTOR.items()], F.lit(1.0))

    def on(flag: str, factor: float):
        return F.when(F.col(flag), F.lit(factor)).otherwise(F.lit(1.0))

    value = (on("is_peak_season", 1.5) * on("is_sale_period", 1.3) * on("is_holiday", 1.8) * on("is_weekend", 1.2) * month)
    return days.withColumn("multiplier", value)


def return_rate(star: Star) -> DataFrame:
    """C11: expected return rate per segment and channel."""
    digital = F.when(F.col("is_digital"), F.lit(DIGITAL_RETURN_FACTOR)).otherwise(F.lit(STORE_RETURN_FACTOR))
    base = F.coalesce(*[F.when(F.col("segment") == s, F.lit(r.return_probability / 100)) for s, r in SEGMENT_RULES.items()])
    seen = (star.sales().join(star.customer().select("customer_key", "segment"), "customer_key")
            .groupBy("segment", "channel_key").agg(F.count("*").alias("lines"),
                                                   F.sum(F.col("is_return").cast("long")).alias("returns")))
    return seen.join(star.channel().select("channel_key", "channel_code", "is_digital"), "channel_key").select(
        "segment", "channel_code", "is_digital", (base * digital).alias("expected_return_rate"),
        "lines", "returns", (F.col("returns") / F.col("lines")).alias("observed_return_rate"))


def preferred_channel_match(star: Star) -> DataFrame:
    """First channel whose code contains the preference, else one chosen by the key."""
    match = F.coalesce(*[F.when(F.lit(c[1].lower()).contains(F.col("preferred_channel")), F.lit(c[0])) for c in CHANNELS])
    return star.customer().select("customer_key", "preferred_channel", match.alias("m")).select(
        "customer_key", "preferred_channel", F.coalesce("m", (F.col("customer_key") % 8 + 1).cast("int")).alias("channel_key"),
        F.col("m").isNull().alias("is_fallback"))


@stored
def affinity(star: Star, customer_key: int | None = None) -> DataFrame:
    """A01 without the rank: purchases full-outer-joined with views and cart adds on one key.

    With ``customer_key`` both sides are cut to that customer before the join.
    """
    mine = F.lit(True) if customer_key is None else F.col("customer_key") == customer_key
    if star.has("affinity"):
        return star.written("affinity").where(mine)
    bought = (star.sales().where(~F.col("is_return") & mine).groupBy("customer_key", "product_key")
              .agg(F.countDistinct("transaction_id").alias("p"), F.sum("net_cents").alias("spent"), F.max("day").alias("sd")))
    seen = (star.events().where(mine).groupBy("customer_key", "product_key")
            .agg(F.count(F.when(F.col("event_type") == "product_view", 1)).alias("v"),
                 F.count(F.when(F.col("event_type") == "add_to_cart", 1)).alias("c"), F.max("day").alias("ed")))
    zero = F.lit(0).cast("long")
    p, v, c = (F.coalesce(x, zero) for x in ("p", "v", "c"))
    both = bought.join(seen, ["customer_key", "product_key"], "full").select(
        "customer_key", "product_key", p.alias("purchase_count"), v.alias("view_count"), c.alias("cart_add_count"),
        F.coalesce("spent", zero).alias("spent"), F.greatest("sd", "ed").alias("last_day"))
    p, v, c = F.col("purchase_count"), F.col("view_count"), F.col("cart_add_count")
    return both.where((p > 0) | (v > 5) | (c > 0)).select(
        "customer_key", "product_key", p, v, c,
        F.least(F.lit(100), 5 * p + 3 * c + 2 * v).alias("score_pct"),
        F.datediff(F.lit(star.as_of), "last_day").alias("days_since_last_interaction"),
        F.when(v > 0, p / F.nullif(v, zero)).otherwise(F.lit(0.0)).alias("view_to_purchase_ratio"),
        F.when(c > 0, p / F.nullif(c, zero)).otherwise(F.lit(0.0)).alias("cart_to_purchase_ratio"),
        F.expr("(spent * (10 + least(10, purchase_count)) + 5) div 10").alias("predicted_cents"))


def ranked_affinity(star: Star) -> DataFrame:
    """Rank per customer by score; ties by product key.

    The rank is built per (customer, score, product range), so a customer with very many
    products is ranked by many tasks.
    """
    a = star.cut("affinity", lambda: affinity(star))
    blocked = a.withColumn("_s", -F.col("score_pct")).withColumn("_t", F.shiftright("product_key", 16))  # at most 65,536 products
    ranked = row_number_in_blocks(blocked, ["customer_key"], ["_s", "_t"], [F.col("_s"), F.col("product_key")],
                                  "recommendation_rank")
    return ranked.drop("_s", "_t")


def channel_performance(star: Star) -> DataFrame:
    """Sales and traffic per channel and day."""
    keys = ["channel_key", "day"]
    by = {k: F.col(k) for k in keys}
    s = grouped(star.sales(), by, {"uc": "count(distinct customer_key)", "tc": "count(distinct transaction_id)", "rev": "sum(net_cents)",
                                   "n": "count(*)", "ret": "sum(cast(is_return as bigint))"})
    t = grouped(star.events(), by, {"sc": "count(distinct session_id)", "vc": "count(distinct customer_key)"})
    z = F.lit(0).cast("long")

    def share(a: str, b: str):
        return F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), z)).when(F.lit(True), F.lit(0.0))

    return s.join(t, keys, "full").select(
        "channel_key", date_key(F.col("day")).alias("date_key"),
        F.coalesce("uc", z).alias("unique_customers"), F.coalesce("tc", z).alias("transaction_count"),
        (F.coalesce("rev", z) / F.lit(100.0)).alias("total_revenue"),
        F.coalesce(F.col("rev") / F.col("n") / 100.0, F.lit(0.0)).alias("avg_order_value"),
        F.coalesce("sc", z).alias("session_count"), F.coalesce("vc", z).alias("visitor_count"),
        share("tc", "sc").alias("conversion_rate"), share("ret", "tc").alias("return_rate"))


def cart_item_stock(star: Star) -> DataFrame:
    """Each item put into a cart with the stock of the customer's nearest store that day."""
    items = star.events().where(F.col("event_type") == "add_to_cart").select(
        "customer_key", "product_key", "day", (F.col("customer_key") % 10).alias("location_key"), "event_id")
    return ledger.stock_as_of(star, items)


@stored
def carts(star: Star) -> DataFrame:
    """Sessions with a cart and no purchase, the low-stock trigger and the recovery funnel."""
    add, u = F.col("event_type") == "add_to_cart", F.col("customer_key")
    by = star.events().groupBy("customer_key", "day").agg(
        F.min("channel_key").alias("channel_key"), F.sum(F.when(add, F.col("event_cents"))).alias("cart_cents"),
        F.count(F.when(add, 1)).alias("items_count"), F.max("ts").alias("last_ts"), F.min(F.when(add, F.col("ts"))).alias("add_ts"),
        F.max(F.col("event_type") == "checkout_start").alias("started"), F.max(F.col("event_type") == "error").alias("failed"),
        F.max("conversion_flag").alias("bought")).where((F.col("items_count") > 0) & ~F.col("bought"))
    low = (cart_item_stock(star).groupBy("customer_key", "day")
           .agg(F.count(F.when(F.col("stock") <= star.config.low_stock_threshold, 1)).alias("low_items")))
    n = F.datediff("day", F.lit("1970-01-01").cast("date"))
    sent = (u * 7 + n * 13) % 10 < 8
    opened = sent & ((u * 11 + n * 17) % 10 < 4)
    clicked = opened & ((u * 19 + n * 23) % 10 < 3)
    back = clicked & ((u + n) % 4 == 0)
    pct = 70 + (u * 3 + n) % 31
    minutes = F.floor((F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("add_ts").cast("timestamp")))
                      / 60000000)
    key = date_key(F.col("day"))
    return by.join(low, ["customer_key", "day"], "left").select(
        F.concat(F.lit("CART_"), u.cast("string"), F.lit("_"), key.cast("string")).alias("cart_id"),
        "customer_key", "day", key.alias("date_key"), "channel_key", "cart_cents", "items_count",
        minutes.alias("minutes_in_cart"),
        F.when(F.col("started"), "payment").when(F.col("failed"), "shipping").otherwise("cart").alias("abandonment_stage"),
        F.col("low_items").alias("inventory_constrained_items"), (F.col("low_items") > 0).alias("low_inventory_trigger"),
        sent.alias("recovery_email_sent"), opened.alias("recovery_email_opened"), clicked.alias("recovery_email_clicked"),
        back.alias("is_recovered"),
        F.when(back, F.date_add("day", (1 + (u + n) % 7).cast("int"))).alias("recovery_day"),
        F.when(back, F.floor(F.col("cart_cents") * pct / 100)).otherwise(F.lit(0)).cast("long").alias("recovered_cents"),
        F.when((F.col("low_items") > 0) & ((u + n) % 10 < 7), "low_inventory")
        .otherwise(nth(REASONS, (u + n) % 5)).alias("suspected_reason"))


@stored
def forecast(star: Star) -> DataFrame:
    """Trailing mean of the position as forecast, with accuracy once the day has been sold.

    The trailing mean runs over days (one row per position and day), and one open forecast
    per position is added for the day after ``as_of``.
    """
    pos = ledger.POSITION
    daily = star.lines().groupBy(*pos, "day").agg(F.sum("quantity").alias("actual_quantity"),
                                                  F.sum("net_cents").alias("actual_cents"))
    past = Window.partitionBy(*pos).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    mean = F.floor(F.sum("actual_quantity").over(past) / F.count("*").over(past))
    known = daily.withColumn("forecast_quantity", F.coalesce(mean, F.lit(star.config.default_forecast_units)).cast("long"))
    none = F.lit(None).cast("long")
    ahead = daily.groupBy(*pos).agg(F.floor(F.sum("actual_quantity") / F.count("*")).alias("forecast_quantity")).select(
        *pos, F.date_add(F.lit(star.as_of), 1).alias("day"), none.alias("actual_quantity"), none.alias("actual_cents"),
        "forecast_quantity")
    return accuracy_columns(known.unionByName(ahead)).withColumn("date_key", date_key(F.col("day")))


def accuracy_columns(df: DataFrame) -> DataFrame:
    """Bounds, mape, accuracy and bias from forecast_quantity and actual_quantity (null without actual)."""
    f, a = F.col("forecast_quantity"), F.col("actual_quantity")
    safe = F.nullif(a, F.lit(0))
    pct = F.abs(f - a) / safe * 100.0
    known = a.isNotNull()
    return (df.withColumn("confidence_lower", F.expr("forecast_quantity * 4 div 5"))
            .withColumn("confidence_upper", F.expr("forecast_quantity * 6 div 5"))
            .withColumn("mape", F.when(known, F.when(a == 0, F.lit(0.0)).otherwise(pct)))
            .withColumn("forecast_accuracy", F.when(known, F.when(a == 0, F.when(f == 0, F.lit(100.0)).otherwise(F.lit(0.0)))
                                                    .otherwise(F.greatest(F.lit(0.0), 100.0 - pct))))
            .withColumn("bias", F.when(known, F.when(a == 0, F.lit(0.0)).otherwise((f - a) / safe * 100.0))))


@stored
def size_fit(star: Star) -> DataFrame:
    """Ordered, kept and recommended size; one size up or down, clamped to the range."""
    part = star.raw("part").select(F.col("p_partkey").alias("product_key"), (F.col("p_size") % 6).alias("ix"))
    s = star.sales().join(part, "product_key")
    fit = (F.when(F.col("line_number") % 7 == 0, "too_small").when(F.col("line_number") % 7 == 1, "too_large")
           .otherwise("perfect"))
    ordered = nth(TOP_SIZES, F.col("ix"))
    step = F.when(fit == "too_small", 1).when(fit == "too_large", -1).otherwise(0)
    advised = nth(TOP_SIZES, F.greatest(F.lit(0), F.least(F.lit(len(TOP_SIZES) - 1), F.col("ix") + step)))
    score = F.when(fit == "perfect", 4).when(fit == "too_small", 1).otherwise(2) + F.col("transaction_id") % 2
    returned = F.col("is_return")
    return s.select(
        "customer_key", "product_key", ordered.alias("ordered_size"),
        F.when((fit == "perfect") | ~returned, ordered).alias("kept_size"),
        advised.alias("recommended_size"), score.cast("long").alias("fit_score"), fit.alias("fit_description"),
        returned.alias("is_returned"),
        F.when(returned & (fit != "perfect"), F.concat(F.lit("fit_issue_"), fit))
        .when(returned, nth(KEPT_REASONS, F.col("transaction_id") % 3)).alias("return_reason"))


def bottoms_as_letters(size):
    """Waist sizes as letter sizes; anything unlisted is M. Fixed values."""
    pairs = {"28": "XS", "30": "S", "32": "M", "34": "L", "36": "XL"}
    return F.coalesce(*[F.when(size == k, v) for k, v in pairs.items()], F.lit("M"))
