"""Data-contract checks (D01-D10): each returns (table, rule, violations, passed)."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTRACT_DIR = Path(__file__).resolve().parent.parent / "contracts"
RESULT = "table string, rule string, violations long, passed boolean"


def load_contract(name: str) -> dict:
    return json.loads((CONTRACT_DIR / f"{name}.json").read_text())


def row_rules(df: DataFrame, table: str, rules: dict[str, Column | str], limits: dict[str, float] | None = None) -> DataFrame:
    """All row rules of a table in one pass: violations per rule, unpivoted.

    ``limits`` gives rules that tolerate a share of violating rows.
    """
    limits = limits or {}
    cond = lambda c: F.expr(c) if isinstance(c, str) else c
    one = df.agg(F.count("*").alias("_rows"), *[F.count(F.when(cond(c), 1)).alias(f"_v{i}") for i, c in enumerate(rules.values())])
    items = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_v{i}").alias("violations"), F.lit(float(limits.get(n, 0.0))).alias("share"))
                      for i, n in enumerate(rules)])
    return one.select("_rows", F.inline(items)).select(
        F.lit(table).alias("table"), "rule", "violations", (F.col("violations") <= F.col("share") * F.col("_rows")).alias("passed"))


def check_schema(df: DataFrame, contract: dict) -> DataFrame:
    """Columns present, types equal, declared not-null columns without nulls, nothing extra."""
    spark, have = df.sparkSession, {f.name: f.dataType for f in df.schema.fields}
    want = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in contract["columns"].items()))
    fixed = [(contract["table"], f"column:{f.name}", int(f.name not in have), f.name in have) for f in want.fields]
    fixed += [(contract["table"], f"type:{f.name}", int(have[f.name] != f.dataType), have[f.name] == f.dataType) for f in want.fields if f.name in have]
    fixed += [(contract["table"], f"extra:{n}", 1, False) for n in have if n not in want.names]
    rules = {f"not_null:{f.name}": F.col(f.name).isNull() for f in want.fields if not f.nullable and f.name in have}
    return spark.createDataFrame(fixed, RESULT).unionByName(row_rules(df, contract["table"], rules))


def check_keys(df: DataFrame, contract: dict, dims: dict[str, DataFrame]) -> DataFrame:
    """Duplicate primary keys and orphan foreign keys.

    All foreign keys are read in one pass as (column, value) pairs and counted before the
    shuffle, so a value that fills much of the table meets its dimension as one row.
    """
    spark, table, pk, fks = df.sparkSession, contract["table"], contract["primary_key"], contract["foreign_keys"]
    dup = df.groupBy(*pk).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    pairs = F.array(*[F.struct(F.lit(c).alias("fk"), F.col(c).cast("long").alias("k")) for c in fks])
    used = df.select(F.inline(pairs)).where(F.col("k").isNotNull()).groupBy("fk", "k").agg(F.count("*").alias("n"))
    known = None
    for c, dim in fks.items():
        one = dims[dim].select(F.lit(c).alias("fk"), F.col("k").cast("long").alias("k"))
        known = one if known is None else known.unionByName(one)
    none = spark.createDataFrame([(c, 0) for c in fks], "fk string, n long")
    orphans = used.join(known, ["fk", "k"], "left_anti").select("fk", "n").unionByName(none).groupBy("fk").agg(F.sum("n").alias("violations"))
    out = dup.select(F.lit(table).alias("table"), F.lit("unique:" + ",".join(pk)).alias("rule"), "violations").unionByName(
        orphans.select(F.lit(table).alias("table"), F.concat(F.lit("foreign_key:"), "fk").alias("rule"), "violations"))
    return out.withColumn("passed", F.col("violations") == 0)


def check_range(df: DataFrame, table: str, rule: str, value: Column, low: float, high: float) -> DataFrame:
    """One aggregate inside [low, high]."""
    ok = F.coalesce(value.between(low, high), F.lit(False))
    return df.agg(ok.alias("passed"), value.alias("value")).select(
        F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.when(F.col("passed"), 0).otherwise(1).cast("long").alias("violations"), "passed", "value")


def history_rules(runs: DataFrame, lines: DataFrame, products: DataFrame, locations: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """D02/D03 over product x location x day without that table: ``runs`` (product_key, location_key, first_day, last_day, stock)
    hold each state with its first and last day, ``lines`` what each sale was given (``allocated``).

    Violations are position-days. Runs meet the sales of their first day in one join on position and day, since any sale changes
    the state; one window per position finds days held twice or by no run, and falls of stock that no sale explains.
    """
    pos, zero = ["product_key", "location_key"], F.lit(0).cast("long")
    sold = lines.where("allocated > 0").groupBy(*pos, F.col("day").alias("first_day")).agg(F.sum("allocated").alias("sold"))
    keys = {k: dim.select(k).distinct().withColumn(f"_{k}", F.lit(True)) for k, dim in zip(pos, (products, locations))}
    both = runs.select(*pos, "first_day", "last_day", "stock").join(sold, [*pos, "first_day"], "full")
    for k, known in keys.items():
        both = both.join(known, k, "left")
    here, order = F.col("last_day").isNotNull(), Window.partitionBy(*pos).orderBy("first_day", "last_day")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("last_day").over(before), F.date_sub(F.lit(first), 1))
    ends = F.max("last_day").over(Window.partitionBy(*pos))
    is_last = F.row_number().over(Window.partitionBy(*pos).orderBy(F.col("first_day").desc(), F.col("last_day").desc())) == 1
    held = F.greatest(F.datediff("last_day", "first_day") + 1, F.lit(0))
    shared = F.least(F.greatest(F.datediff("seen", "first_day") + 1, F.lit(0)), "held")
    rows = (both.withColumns({"seen": seen, "prev": F.last(F.when(here, F.col("stock")), True).over(before), "held": held, "ends": ends, "is_last": is_last})
            .withColumns({"shared": F.when(here, shared), "lost": F.when(here, F.greatest(F.datediff("first_day", "seen") - 1, F.lit(0)))}))
    tail = F.when(F.col("is_last"), F.greatest(F.datediff(F.lit(last), F.coalesce("ends", F.date_sub(F.lit(first), 1))), F.lit(0))).otherwise(0)
    days = lambda cond: F.when(here & cond, F.col("held")).otherwise(0)
    rules = {"unique:product_key,location_key,date_key": F.col("shared"), "every_day_present": F.coalesce("lost", zero) + tail,
             "no_negative_stock": days(F.col("stock") < 0),
             "stock_falls_by_sales_only": days(F.col("prev") - F.col("stock") > F.coalesce("sold", zero)),
             "sales_day_has_state": F.when(here, 0).otherwise(1),
             **{f"foreign_key:{k}": days(F.col(f"_{k}").isNull()) for k in pos}}
    one = rows.agg(F.coalesce(F.sum(F.col("held") - F.col("shared")), zero).alias("position_days"),
                   *[F.coalesce(F.sum(c.cast("long")), zero).alias(f"_v{i}") for i, c in enumerate(rules.values())])
    items = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_v{i}").alias("violations")) for i, n in enumerate(rules)])
    return one.select("position_days", F.inline(items)).select(
        F.lit("gold_inventory_fact").alias("table"), "rule", "violations", (F.col("violations") == 0).alias("passed"), "position_days")


ROW_RULES: dict[str, dict[str, str]] = {
    "gold_inventory_fact": {
        "no_negative_stock": "quantity_available < 0 or quantity_on_hand < 0 or quantity_reserved < 0 or quantity_damaged < 0",
        "on_hand_reconciles": "quantity_on_hand <> quantity_available + quantity_reserved + quantity_damaged",
        "stockout_means_empty": "is_stockout <> (quantity_available = 0)"},
    "gold_sales_fact": {
        "no_overselling": "quantity_sold > quantity_requested",
        "constrained_flag_matches": "(quantity_sold < quantity_requested) <> is_inventory_constrained",
        "sold_within_stock": "quantity_sold > inventory_at_purchase", "stock_at_purchase_not_negative": "inventory_at_purchase < 0"},
    "gold_stockout_events": {
        "lost_sales_not_negative": "lost_sales_attempts < 0 or lost_sales_quantity < 0 or lost_sales_revenue < 0",
        "end_not_before_start": "stockout_end_date_key < stockout_start_date_key"},
    "gold_cart_abandonment_fact": {
        "constrained_items_bounds": "inventory_constrained_items < 0 or inventory_constrained_items > items_count",
        "trigger_has_items": "low_inventory_trigger and coalesce(inventory_constrained_items, 0) = 0",
        "trigger_flag_matches": "low_inventory_trigger <> (inventory_constrained_items > 0)"},
}
