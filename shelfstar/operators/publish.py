"""The four contract tables, in their published column names and types."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfstar.functions.exprs import date_key
from shelfstar.operators import facts, ledger
from shelfstar.star import SEASON_OF_DAY, Star, nth

SOURCES = {"sales": "OMS_POS", "inventory": "WMS_ERP", "carts": "WEB_ANALYTICS", "stockouts": "INVENTORY_LEDGER"}


def _str(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _stamp(star: Star, source: str) -> list[Column]:
    return [F.lit(SOURCES[source]).alias("source_system"), F.lit(str(star.as_of) + " 00:00:00").cast("timestamp").alias("etl_timestamp")]


def _int(x, name: str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("int").alias(name)


def _money(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x) / 100.0


def sales_fact(star: Star) -> DataFrame:
    """Allocated lines; lines that got nothing are not sales. Amounts follow the allocated share."""
    o = star.raw("orders").select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_key"))
    season = star.product().select("product_key", "season_code")
    sold = (ledger.allocations(star).where("allocated > 0").join(o, "transaction_id").join(season, "product_key"))
    txn, got = F.col("transaction_id"), F.col("allocated")
    part = lambda c: F.floor(F.col(c) * got / F.col("quantity"))
    store = F.col("channel_key") == 5
    due = F.date_add("day", ledger.return_delay(txn, star.config.return_delay_days))
    mix = (txn * 7 + F.col("line_number") * 13) % 100
    item = F.concat_ws("_", F.lit("LINE"), _str(txn), _str("line_number"), _str("product_key"), _str("location_key"),
                       _str(date_key(F.col("day"))), _str("quantity"), _str("net_cents"), _str("discount_cents"), _str("is_return"))
    unit = F.floor((F.col("net_cents") + F.col("discount_cents")) / F.col("quantity"))
    return sold.select(
        F.concat(F.lit("TXN_"), _str(txn)).alias("transaction_id"), item.alias("line_item_id"), _int("customer_key", "customer_key"),
        _int("product_key", "product_key"), date_key(F.col("day")).alias("date_key"),
        F.element_at(F.array(*[F.lit(t) for t in (900, 1200, 1500, 1800, 2000)]), (txn % 5 + 1).cast("int")).alias("time_key"),
        _int("location_key", "location_key"), _int("channel_key", "channel_key"), F.concat(F.lit("ORD_"), _str(txn)).alias("order_number"),
        F.when(store, F.concat(F.lit("POS_"), _str("location_key"))).alias("pos_terminal_id"),
        F.when(store, F.concat(F.lit("SA_"), _str(txn % 100 + 1))).alias("sales_associate_id"),
        _int(got, "quantity_sold"), _int("quantity", "quantity_requested"), F.col("is_constrained").alias("is_inventory_constrained"),
        _int("stock_before", "inventory_at_purchase"), _money(unit).alias("unit_price"),
        _money(F.floor(F.col("discount_cents") / F.col("quantity"))).alias("discount_amount"), _money(part("tax_cents")).alias("tax_amount"),
        _money(part("net_cents")).alias("net_sales_amount"), _money(part("margin_cents")).alias("gross_margin_amount"), "is_return",
        F.when(F.col("is_return"), date_key(due)).alias("return_restocked_date_key"),
        (F.col("is_return") & (txn % 10 < 3)).alias("is_exchange"),
        (F.month("day").isin(*facts.SALE_MONTHS) & (mix % 10 < 3)).alias("is_promotional"),
        ((F.col("season_code") != F.expr(SEASON_OF_DAY)) & (mix < 20)).alias("is_clearance"),
        F.when(store, "in_store").otherwise(nth(["ship", "pickup", "same_day"], txn % 3)).alias("fulfillment_type"),
        nth(["credit_card", "debit_card", "paypal", "apple_pay"], txn % 4).alias("payment_method"), *_stamp(star, "sales"))


def inventory_fact(star: Star) -> DataFrame:
    """Positions on the latest day."""
    p = star.product().select("product_key", "price_cents", "unit_cost_cents", "end_of_life_date")
    pos = ledger.positions(star).join(p, "product_key")
    q = F.col("quantity_on_hand")
    ints = ["product_key", "location_key", "date_key", "quantity_on_hand", "quantity_available", "quantity_reserved", "quantity_in_transit",
            "quantity_damaged"]
    return pos.select(
        *[_int(c, c) for c in ints], "is_stockout", _int("stockout_days", "stockout_duration_days"), "last_replenishment_date",
        "next_replenishment_date", _money(q * F.col("unit_cost_cents")).alias("inventory_value_cost"),
        _money(q * F.col("price_cents")).alias("inventory_value_retail"),
        *[_int(c, c) for c in ("days_of_supply", "stock_cover_days", "reorder_point", "reorder_quantity")], "is_overstock",
        F.coalesce(F.col("end_of_life_date") < F.lit(star.as_of), F.lit(False)).alias("is_discontinued"), *_stamp(star, "inventory"))


def cart_abandonment_fact(star: Star) -> DataFrame:
    c = facts.carts(star)
    number = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 10_000_000_000 + F.col("customer_key")
    return c.select(
        number.alias("abandonment_id"), "cart_id", _int("customer_key", "customer_key"), "date_key",
        F.element_at(F.array(*[F.lit(t) for t in (900, 1200, 1500, 1800, 2000)]), (F.col("customer_key") % 5 + 1).cast("int")).alias("time_key"),
        "channel_key", _money("cart_cents").alias("cart_value"), _int("items_count", "items_count"), "low_inventory_trigger",
        _int("inventory_constrained_items", "inventory_constrained_items"), _int("minutes_in_cart", "minutes_in_cart"),
        "recovery_email_sent", "recovery_email_opened", "recovery_email_clicked", "is_recovered",
        date_key(F.col("recovery_day")).alias("recovery_date_key"), _money("recovered_cents").alias("recovery_revenue"), "abandonment_stage",
        "suspected_reason", *_stamp(star, "carts"))


def stockout_fact(star: Star) -> DataFrame:
    e = ledger.stockout_events(star)
    number = (F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 100_000 + F.col("location_key")) * 10_000_000 + F.col("product_key")
    return e.select(
        number.alias("stockout_id"), _int("product_key", "product_key"), _int("location_key", "location_key"),
        F.col("start_date_key").alias("stockout_start_date_key"), F.col("end_date_key").alias("stockout_end_date_key"),
        _int("duration_days", "stockout_duration_days"), _int("lost_attempts", "lost_sales_attempts"), _int("lost_units", "lost_sales_quantity"),
        _money("lost_cents").alias("lost_sales_revenue"), "peak_season_flag", *_stamp(star, "stockouts"))


TABLES = {"gold_sales_fact": sales_fact, "gold_inventory_fact": inventory_fact, "gold_cart_abandonment_fact": cart_abandonment_fact,
          "gold_stockout_events": stockout_fact}


def dimension_keys(star: Star) -> dict[str, DataFrame]:
    from shelfstar.operators.calendar import date_dimension
    days = date_dimension(star.spark, star.first_day, star.as_of + dt.timedelta(days=365))
    return {"customer": star.customer().select(F.col("customer_key").alias("k")), "product": star.product().select(F.col("product_key").alias("k")),
            "location": star.location().select(F.col("location_key").alias("k")), "channel": star.channel().select(F.col("channel_key").alias("k")),
            "date": days.select(F.col("date_key").alias("k"))}
