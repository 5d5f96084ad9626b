"""Date and time dimensions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstar.functions.exprs import date_key

# Retail calendar.
HOLIDAYS = {"New Year": (1, 1), "Valentine's Day": (2, 14), "Easter": (4, 15), "Memorial Day": (5, 30), "Independence Day": (7, 4),
            "Labor Day": (9, 5), "Halloween": (10, 31), "Black Friday": (11, 25), "Thanksgiving": (11, 24), "Christmas": (12, 25),
            "Boxing Day": (12, 26)}
SALE_EVENTS = {1: "Winter Clearance", 2: "President's Day Sale", 3: "Spring Sale", 5: "Memorial Day Sale", 7: "Summer Sale",
               9: "Back to School", 11: "Black Friday", 12: "Holiday Sale"}
PEAK_MONTHS = (11, 12, 3, 4)
PEAK_HOURS = (12, 13, 17, 18, 19, 20)


def date_dimension(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per day; the fiscal year starts in February."""
    d = F.col("calendar_date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("calendar_date"))
    month, dom = F.month(d), F.dayofmonth(d)
    holiday = F.coalesce(*[F.when((month == m) & (dom == x), F.lit(name)) for name, (m, x) in HOLIDAYS.items()])
    sale = F.coalesce(*[F.when(month == m, F.lit(name)) for m, name in SALE_EVENTS.items()])
    fiscal = F.pmod(month - 2, F.lit(12))
    season = (F.when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").when(month.isin(9, 10, 11), "Fall")
              .otherwise("Winter"))
    return days.select(
        date_key(d).alias("date_key"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), month.alias("month"),
        F.date_format(d, "MMMM").alias("month_name"), F.weekofyear(d).alias("week_of_year"), dom.alias("day_of_month"),
        (F.weekday(d) + 1).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), (F.weekday(d) >= 5).alias("is_weekend"),
        holiday.isNotNull().alias("is_holiday"), holiday.alias("holiday_name"),
        F.when(month >= 2, F.year(d)).otherwise(F.year(d) - 1).alias("fiscal_year"),
        (F.floor(fiscal / 3) + 1).cast("int").alias("fiscal_quarter"), (fiscal + 1).cast("int").alias("fiscal_month"),
        season.alias("season"), month.isin(*PEAK_MONTHS).alias("is_peak_season"), sale.isNotNull().alias("is_sale_period"),
        sale.alias("sale_event_name"))


def time_dimension(spark: SparkSession) -> DataFrame:
    """96 quarter hours of a day."""
    q = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(95))).alias("q"))
    h, m = F.floor(F.col("q") / 4).cast("int"), (F.col("q") % 4 * 15).cast("int")
    period = (F.when((h >= 6) & (h < 12), "Morning").when((h >= 12) & (h < 17), "Afternoon").when((h >= 17) & (h < 21), "Evening")
              .otherwise("Night"))
    return q.select((h * 100 + m).alias("time_key"), h.alias("hour"), m.alias("minute"), F.format_string("%02d:%02d", h, m).alias("hour_minute"),
                    F.when(h < 12, "AM").otherwise("PM").alias("am_pm"), F.when(h <= 12, h).otherwise(h - 12).alias("hour_12"),
                    period.alias("period_of_day"), ((h >= 9) & (h < 21)).alias("is_business_hours"), h.isin(*PEAK_HOURS).alias("is_peak_hours"))
