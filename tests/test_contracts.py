"""Our own tables keep their contracts; a copy broken in one place reports exactly that."""

import pytest
from pyspark.sql import functions as F

from shelfstar.operators import contracts, publish


@pytest.fixture(scope="module")
def star(spark):
    from shelfstar.star import Star
    return Star(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def published(star):
    return {t: fn(star).cache() for t, fn in publish.TABLES.items()}


def failed(df):
    return {r["rule"]: r["violations"] for r in df.collect() if not r["passed"]}


@pytest.mark.parametrize("table", list(publish.TABLES))
def test_tables_keep_their_contract(star, published, table):
    c = contracts.load_contract(table)
    assert failed(contracts.check_schema(published[table], c)) == {}
    assert published[table].count() > 0
    assert failed(contracts.row_rules(published[table], table, contracts.ROW_RULES[table])) == {}


BREAK = {
    "no_negative_stock": ("gold_inventory_fact", {"quantity_damaged": "-1", "quantity_available": "quantity_available + 1"}),
    "on_hand_reconciles": ("gold_inventory_fact", {"quantity_on_hand": "quantity_on_hand + 1"}),
    "stockout_means_empty": ("gold_inventory_fact", {"is_stockout": "not is_stockout"}),
    "no_overselling": ("gold_sales_fact", {"quantity_sold": "quantity_requested + 1", "inventory_at_purchase": "1000", "is_inventory_constrained": "false"}),
    "constrained_flag_matches": ("gold_sales_fact", {"is_inventory_constrained": "not is_inventory_constrained"}),
    "sold_within_stock": ("gold_sales_fact", {"inventory_at_purchase": "0"}),
    "lost_sales_not_negative": ("gold_stockout_events", {"lost_sales_attempts": "-1"}),
    "end_not_before_start": ("gold_stockout_events", {"stockout_end_date_key": "19000101"}),
    "constrained_items_bounds": ("gold_cart_abandonment_fact", {"inventory_constrained_items": "items_count + 1", "low_inventory_trigger": "true"}),
    "trigger_flag_matches": ("gold_cart_abandonment_fact", {"inventory_constrained_items": "1", "low_inventory_trigger": "false"}),
}


@pytest.mark.parametrize("rule", list(BREAK))
def test_one_broken_row_is_one_violation(published, rule):
    table, change = BREAK[rule]
    df = published[table]
    one = df.limit(1).select(*[F.expr(change[c]).cast(df.schema[c].dataType).alias(c) if c in change else F.col(c) for c in df.columns])
    bad = failed(contracts.row_rules(df.unionByName(one), table, contracts.ROW_RULES[table]))
    assert bad.get(rule) == 1
    assert set(bad) <= {rule, "stockout_means_empty"}


def test_schema_faults_are_named(published):
    c = contracts.load_contract("gold_stockout_events")
    df = published["gold_stockout_events"]
    broken = (df.drop("peak_season_flag").withColumn("lost_sales_quantity", F.col("lost_sales_quantity").cast("string")).withColumn("more", F.lit(1)))
    assert failed(contracts.check_schema(broken, c)) == {"column:peak_season_flag": 1, "type:lost_sales_quantity": 1, "extra:more": 1}
    null = df.withColumn("product_key", F.when(F.col("stockout_id") > 0, F.lit(None).cast("int")))
    assert failed(contracts.check_schema(null, c)) == {"not_null:product_key": df.count()}


def test_duplicate_keys_and_orphans(star, published):
    c, df = contracts.load_contract("gold_stockout_events"), published["gold_stockout_events"]
    dims = publish.dimension_keys(star)
    assert failed(contracts.check_keys(df, c, dims)) == {}
    one = df.limit(1)
    assert failed(contracts.check_keys(df.unionByName(one), c, dims)) == {"unique:stockout_id": 1}
    orphan = one.withColumn("stockout_id", F.lit(-5).cast("long")).withColumn("location_key", F.lit(999999))
    assert failed(contracts.check_keys(df.unionByName(orphan), c, dims)) == {"foreign_key:location_key": 1}


def test_limits_allow_a_share(spark):
    df = spark.range(100)
    assert failed(contracts.row_rules(df, "t", {"r": "id < 5"}, {"r": 0.05})) == {}
    assert failed(contracts.row_rules(df, "t", {"r": "id < 6"}, {"r": 0.05})) == {"r": 6}


RUNS = "product_key long, location_key long, first_day string, last_day string, stock long"
LINES = "product_key long, location_key long, day string, allocated long"


def _history(spark, runs, lines):
    import datetime as dt
    date = lambda df, *cols: df.withColumns({c: F.col(c).cast("date") for c in cols})
    got = contracts.history_rules(
        date(spark.createDataFrame(runs, RUNS), "first_day", "last_day"), date(spark.createDataFrame(lines, LINES), "day"),
        spark.createDataFrame([(1,), (2,)], "product_key long"), spark.createDataFrame([(1,)], "location_key long"), dt.date(2000, 1, 1), dt.date(2000, 1, 31))
    return {r.rule: r.violations for r in got.collect() if r.violations}, got.first().position_days


def d(n):
    return f"2000-01-{n:02d}"


GOOD = [(1, 1, d(1), d(9), 5), (1, 1, d(10), d(19), 2), (1, 1, d(20), d(31), 4), (2, 1, d(1), d(31), 0)]
SOLD = [(1, 1, d(10), 2), (1, 1, d(10), 1), (1, 1, d(15), 0)]


@pytest.mark.parametrize("runs, lines, want", [
    (GOOD, SOLD, {}),
    ([], [], {}),
    (GOOD, SOLD[:1], {"stock_falls_by_sales_only": 10}),                                     # three units went, two were sold
    (GOOD, [*SOLD, (1, 1, d(25), 1)], {"sales_day_has_state": 1}),
    (GOOD[:2] + GOOD[3:], SOLD, {"every_day_present": 12}),                                  # the end is missing
    ([GOOD[0], *GOOD[2:]], SOLD, {"every_day_present": 10, "sales_day_has_state": 1, "stock_falls_by_sales_only": 12}),
    (GOOD[1:], SOLD, {"every_day_present": 9}),                                              # the start is missing
    ([*GOOD, (2, 1, d(5), d(8), 0)], SOLD, {"unique:product_key,location_key,date_key": 4}),
    ([*GOOD, GOOD[3]], SOLD, {"unique:product_key,location_key,date_key": 31}),
    ([*GOOD[:3], (2, 1, d(1), d(31), -1)], SOLD, {"no_negative_stock": 31}),
    ([*GOOD, (3, 1, d(1), d(31), 0), (1, 7, d(1), d(31), 0)], SOLD, {"foreign_key:product_key": 31, "foreign_key:location_key": 31}),
], ids=["good", "empty", "unsold", "no state", "no end", "gap", "no start", "overlap", "copy", "negative", "orphans"])
def test_rules_over_the_whole_history(spark, runs, lines, want):
    got, total = _history(spark, runs, lines)
    assert got == want
    assert total == len({(p, l, x) for p, l, a, b, _ in runs for x in range(int(a[-2:]), int(b[-2:]) + 1)})
