"""The star schema over the raw tables, one lazily built DataFrame per table.

Every table is a deterministic expression of the raw columns, so nothing has to be
collected and any lost task can be recomputed. Only tables with a fixed number of rows
(region, nation, channel) carry a broadcast hint; all other joins are left to Catalyst and
adaptive execution, which decide from measured sizes.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstar.config import Config
from shelfstar.functions.exprs import date_key, truncated_cents
from shelfstar.sources.tables import StageLog, cut, read

# The eight sales channels.
CHANNELS = [
    (1, "WEB_DESKTOP", "Website - Desktop", "online", "web", "desktop", True, True, 0.0),
    (2, "WEB_MOBILE", "Website - Mobile", "online", "web", "mobile", True, True, 0.0),
    (3, "APP_IOS", "iOS Mobile App", "online", "mobile_app", "mobile", True, True, 0.0),
    (4, "APP_ANDROID", "Android Mobile App", "online", "mobile_app", "mobile", True, True, 0.0),
    (5, "STORE_POS", "Physical Store - POS", "offline", "store", "pos", False, True, 0.0),
    (6, "STORE_KIOSK", "In-Store Kiosk", "hybrid", "store", "kiosk", True, True, 0.0),
    (7, "SOCIAL_FB", "Facebook Shop", "online", "social", "mobile", True, False, 5.0),
    (8, "MARKETPLACE_AMAZON", "Amazon Marketplace", "online", "marketplace", "all", True, False, 15.0),
]
CHANNEL_SCHEMA = ("channel_key int, channel_code string, channel_name string, channel_type string, "
                  "channel_category string, device_category string, is_digital boolean, is_owned boolean, "
                  "commission_rate double")

# State tax rates in 1/100000, and the states given to nations in turn.
STATE_TAX = {"NY": 8875, "CA": 7250, "IL": 8250, "FL": 6000, "TX": 6250, "NV": 6850, "MA": 6250,
             "WA": 6500, "GA": 4000, "NJ": 6625, "OH": 5750}
STATES = [*STATE_TAX, "AZ", "OR"]
DEFAULT_TAX = 7000
TIME_ZONE = {"AFRICA": "America/New_York", "AMERICA": "America/Chicago", "ASIA": "America/Denver"}
DEFAULT_ZONE = "America/Los_Angeles"
SEASONS = ["Spring", "Summer", "Fall", "Winter"]
TOP_SIZES = ["XS", "S", "M", "L", "XL", "XXL"]
BOTTOM_SIZES = ["26", "28", "30", "32", "34", "36", "38", "40"]
ACQUISITION = ["web", "store", "social", "email", "referral", "search", "paid"]
PREFERRED = ["web", "app", "store", "social"]
CATEGORIES = ["bolt", "gear", "gizmo", "plate", "ring", "rod", "widget", "anvil"]

# Opening stock of a position: a share is set low, the rest follows the location type.
OPENING = ("cast(case when (31 * product_key + 17 * location_key) % 100 < 10 "
           "then (31 * product_key + 17 * location_key) % 100 "
           "when location_key % 13 < 10 then 20 + (31 * product_key + 17 * location_key) % 100 % 81 "
           "when location_key % 13 < 12 then 100 + (31 * product_key + 17 * location_key) % 100 * 4 "
           "else 10 + (31 * product_key + 17 * location_key) % 100 % 41 end as bigint)")

SEASON_OF_DAY = ("case when month(day) in (3, 4, 5) then 'Spring' when month(day) in (6, 7, 8) then 'Summer' "
                 "when month(day) in (9, 10, 11) then 'Fall' else 'Winter' end")


def nth(values: list, index):
    """values[index] as a column, for a non-negative index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def midnight(df: DataFrame, column: str, day: dt.date):
    """Start of a day as a literal of the column's own timestamp type, so the bound is pushed to the scan."""
    return F.lit(day.isoformat() + " 00:00:00").cast(df.schema[column].dataType)


#: Folder of the stage log beside the written tables.
LOG = "_stages"


def stored(fn):
    """Reads the table of this name if the star was built with it and no further arguments are given."""
    @wraps(fn)
    def run(star: Star, *args, **kwargs) -> DataFrame:
        plain = not args and not any(v is not None and v != () for v in kwargs.values())
        return star.written(fn.__name__) if plain and star.has(fn.__name__) else fn(star, *args, **kwargs)
    return run


class Star:
    """Lazily built star tables over one folder of raw parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: Config | None = None, built: str | None = None):
        """``built`` is the folder that ``shelfstar.build`` filled; tables of its finished stages are read, others derived."""
        self.spark, self.dir, self.config = spark, sf_dir.rstrip("/"), (config or Config()).validate()
        self.built = built
        self._done = set() if built is None else {r.stage for r in StageLog(spark, f"{built}/{LOG}").latest().where("status = 'done'").collect()}
        self._raw: dict[str, DataFrame] = {}
        self._cuts: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._raw[name]

    def path(self, name: str) -> str:
        return f"{self.built}/{self.config.table_prefix}{name}"

    def has(self, name: str) -> bool:
        return name in self._done

    def written(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read(self.spark, self.path(name))
        return self._tables[name]

    def cut(self, name: str, build) -> DataFrame:
        """A table that several parts of a query use: computed once, then read from the shared folder."""
        if self.has(name):
            return self.written(name)
        if name not in self._cuts:
            self._cuts[name] = cut(build(), name)
        return self._cuts[name]

    @cached_property
    def _span(self) -> tuple[dt.date, dt.date]:
        """First and latest sale date: one row, read once, then literals that scans can prune on."""
        if self.has("span"):
            row = self.written("span").first()
            return row.a, row.b
        d = F.col("l_shipdate")
        row = self.raw("lineitem").agg(F.min(d).cast("date").alias("a"), F.max(d).cast("date").alias("b")).first()
        return row.a, row.b

    @property
    def first_day(self) -> dt.date:
        return self._span[0]

    @property
    def as_of(self) -> dt.date:
        return self._span[1]

    @cached_property
    def product_count(self) -> int:
        return self.raw("part").count()

    def days_back(self, n: int) -> dt.date:
        return self.as_of - dt.timedelta(days=n)

    # -- dimensions --------------------------------------------------------------------

    def _geo(self) -> DataFrame:
        nation, region = self.raw("nation"), F.broadcast(self.raw("region"))
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", "n_name", "r_name")

    def customer(self) -> DataFrame:
        c, g, k = self.raw("customer"), F.broadcast(self._geo()), F.col("c_custkey")
        bal = F.col("c_acctbal")
        tier = (F.when(bal >= 7500, "platinum").when(bal >= 5000, "gold")
                .when(bal >= 2500, "silver").otherwise("bronze"))
        since = F.date_add(F.lit("1994-01-01").cast("date"), (k % 365).cast("int"))
        return c.join(g, c.c_nationkey == g.n_nationkey).select(
            k.alias("customer_key"),
            F.concat(F.lit("CUST_"), k.cast("string")).alias("customer_id"),
            F.concat(F.lit("customer"), k.cast("string"), F.lit("@example.com")).alias("email"),
            F.col("c_mktsegment").alias("segment"),
            F.floor(bal * 100 + 0.5).alias("ltv_cents"),
            since.alias("acquisition_date"),
            nth(ACQUISITION, k % 7).alias("acquisition_channel"),
            nth(PREFERRED, k % 4).alias("preferred_channel"),
            nth(CATEGORIES, k % 8).alias("preferred_category"),
            nth(TOP_SIZES, k % 6).alias("size_profile_tops"),
            nth(BOTTOM_SIZES, k % 8).alias("size_profile_bottoms"),
            F.col("r_name").alias("geo_region"), F.col("n_name").alias("geo_city"),
            (k % 10).alias("nearest_store_id"),
            tier.alias("loyalty_tier"),
            (k % 3 != 0).alias("email_subscribe_flag"), (k % 5 == 0).alias("sms_subscribe_flag"),
            since.alias("effective_date"), F.lit("9999-12-31").cast("date").alias("expiration_date"),
            F.lit(True).alias("is_current"))

    def product(self) -> DataFrame:
        p, k = self.raw("part"), F.col("p_partkey")
        price = F.col("p_retailprice")
        cents = F.floor(price * 100 + 0.5)
        lux, prem, mid = self.config.price_cuts
        tier = (F.when(price > lux, "luxury").when(price > prem, "premium")
                .when(price > mid, "mid").otherwise("budget"))
        return p.select(
            k.alias("product_key"),
            F.concat(F.lit("PROD_"), k.cast("string")).alias("product_id"),
            F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category_level_1"),
            F.element_at(F.split("p_name", " "), -1).alias("category_level_2"),
            F.element_at(F.split("p_name", " "), 1).alias("category_level_3"),
            F.when(F.col("p_type").isin("SMALL", "MEDIUM", "LARGE"), "XS-XL").otherwise("ONE SIZE").alias("size_range"),
            nth(SEASONS, k % 4).alias("season_code"),
            F.date_add(F.lit("1995-01-01").cast("date"), (k % 730).cast("int")).alias("launch_date"),
            F.when(k % 5 == 0, F.date_add(F.lit("2001-11-04").cast("date"), (30 + k % 336).cast("int"))).alias("end_of_life_date"),
            cents.alias("price_cents"), F.floor(cents * 2 / 5).alias("unit_cost_cents"),
            tier.alias("price_tier"), (k % 10 != 9).alias("product_active"))

    def location(self) -> DataFrame:
        s, g, k = self.raw("supplier"), F.broadcast(self._geo()), F.col("s_suppkey")
        kind = F.when(k % 13 < 10, "store").when(k % 13 < 12, "warehouse").otherwise("dc")
        state = nth(STATES, F.col("s_nationkey") % len(STATES))
        tax = F.coalesce(*[F.when(state == st, F.lit(rate)) for st, rate in STATE_TAX.items()], F.lit(DEFAULT_TAX))
        zone = F.coalesce(*[F.when(F.col("r_name") == r, z) for r, z in TIME_ZONE.items()], F.lit(DEFAULT_ZONE))
        sqft = 5000 + k * 37 % 100 * 100
        return s.join(g, s.s_nationkey == g.n_nationkey).select(
            k.alias("location_key"),
            F.concat(F.lit("LOC_"), k.cast("string")).alias("location_id"),
            F.col("s_name").alias("location_name"), kind.alias("location_type"),
            F.col("n_name").alias("city"), state.alias("state_province"), F.col("r_name").alias("region"),
            F.when(kind == "store", "physical").otherwise("digital").alias("location_channel"),
            F.concat(F.lit("District_"), F.upper(F.substring("r_name", 1, 2))).alias("district"),
            zone.alias("timezone"), tax.alias("tax_rate_e5"),
            sqft.alias("selling_sqft"), (sqft * 3 / 2).cast("long").alias("total_sqft"),
            (k % 29 != 28).alias("location_active"))

    def channel(self) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(CHANNELS, CHANNEL_SCHEMA))

    # -- facts ---------------------------------------------------------------------------

    def lines(self, since: dt.date | None = None, until: dt.date | None = None, raw: DataFrame | None = None) -> DataFrame:
        """Sale lines without the customer, of the raw table or of ``raw`` (which may be a stream); the date bounds reach the parquet scan."""
        li = self.raw("lineitem") if raw is None else raw
        if since is not None:
            li = li.where(F.col("l_shipdate") >= midnight(li, "l_shipdate", since))
        if until is not None:
            li = li.where(F.col("l_shipdate") < midnight(li, "l_shipdate", until + dt.timedelta(days=1)))
        day, ext = F.to_date("l_shipdate"), F.col("l_extendedprice")
        net = truncated_cents(ext * (1 - F.col("l_discount")))
        cost = truncated_cents(ext * 0.4)
        return li.select(
            F.col("l_orderkey").alias("transaction_id"), F.col("l_linenumber").alias("line_number"),
            F.col("l_partkey").alias("product_key"), F.col("l_suppkey").alias("location_key"),
            day.alias("day"), date_key(day).alias("date_key"),
            (F.col("l_orderkey") % 8 + 1).cast("int").alias("channel_key"),
            F.col("l_quantity").cast("int").alias("quantity"),
            net.alias("net_cents"), truncated_cents(ext * F.col("l_discount")).alias("discount_cents"),
            F.floor(net * F.col("l_tax")).alias("tax_cents"),
            (net - cost).alias("margin_cents"), cost.alias("cost_cents"),
            (F.col("l_returnflag") == "R").alias("is_return"))

    def sales(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        """Sale lines with the customer, by one join with orders."""
        if self.has("sales"):
            s = self.written("sales")
            s = s if since is None else s.where(F.col("day") >= F.lit(since))
            return s if until is None else s.where(F.col("day") <= F.lit(until))
        o = self.raw("orders").select(F.col("o_orderkey").alias("transaction_id"),
                                      F.col("o_custkey").alias("customer_key"))
        return self.lines(since, until).join(o, "transaction_id")

    def events(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        """Web events, moved onto the sales calendar by a fixed number of days."""
        e, shift = self.raw("events"), dt.timedelta(days=self.config.event_shift_days)
        if since is not None:
            e = e.where(F.col("ts") >= midnight(e, "ts", since + shift))
        if until is not None:
            e = e.where(F.col("ts") < midnight(e, "ts", until + shift + dt.timedelta(days=1)))
        day = F.date_sub(F.to_date("ts"), self.config.event_shift_days)
        kind = (F.when(F.col("event_type") == "view", "product_view")
                .when(F.col("event_type") == "click", "add_to_cart")
                .when(F.col("event_type") == "signup", "checkout_start")
                .when(F.col("event_type") == "purchase", "checkout_complete")
                .otherwise(F.col("event_type")))
        category = (F.when(kind.contains("view"), "engagement").when(kind.contains("checkout"), "conversion")
                    .otherwise("interaction"))
        value = F.when(kind.isin("checkout_complete", "add_to_cart"), truncated_cents(F.col("value"))).otherwise(F.lit(0))
        user, n = F.col("user_id"), F.datediff(day, F.lit("1970-01-01").cast("date"))
        return e.select(
            "event_id", "ts",
            F.concat(F.lit("SESSION_"), user.cast("string"), F.lit("_"), date_key(day).cast("string")).alias("session_id"),
            user.alias("customer_key"),
            F.regexp_extract("props", "([0-9]+)", 1).try_cast("long").alias("product_key"),
            day.alias("day"), date_key(day).alias("date_key"),
            (F.hour("ts") * 100 + F.floor(F.minute("ts") / 15) * 15).cast("int").alias("time_key"),
            ((user + n) % 4 + 1).cast("int").alias("channel_key"),
            kind.alias("event_type"), category.alias("event_category"),
            value.alias("event_cents"),
            F.when(category == "engagement", 5 + F.col("event_id") % 296).otherwise(F.lit(0)).alias("time_on_page"),
            (kind == "checkout_complete").alias("conversion_flag"))
