"""Nested grouping equals plain distinct counts and repeats no row."""

import pytest
from pyspark.sql import functions as F

from shelfstar.functions.distinct import calls, grouped, nest_key
from shelfstar.plans.registry import JOBS
from shelfstar.plans import load_all
from shelfstar.star import Star

load_all()
ROWS = "transaction_id long, customer_key long, session_id string, kind string, cents long, g string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def sales(spark):
    rows = [(t, t % 7, f"s{t % 5}", "view" if t % 3 else "buy", t * 10 - 50, "hot" if t % 10 else "cold") for t in range(60)]
    rows += [(3, 3, "s3", "view", 5, "hot")] * 40                                       # repeated rows
    rows += [(None, 2, None, None, None, "hot"), (100, None, "s9", "view", 1, "cold"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ROWS)


MEASURES = {"orders": "count(distinct transaction_id)", "people": "count(distinct customer_key)", "n": "count(*)",
            "kinds": "count(kind)", "total": "cast(sum(cents) as bigint)", "mean": "(avg(cents) / 1e2)", "low": "min(cents)", "top": "max(cents)",
            "rate": "(count(distinct transaction_id) * 1e0 / nullif(count(distinct customer_key), 0))"}
FLAGS = {"sessions": "count(distinct session_id)", "seen": "count(distinct case when kind = 'view' then session_id end)",
         "bought": "count(distinct case when kind = 'buy' then session_id end)"}


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("agg", [MEASURES, FLAGS], ids=["owner", "flags"])
@pytest.mark.parametrize("empty", [False, True])
def test_equals_the_plain_aggregation(sales, by, agg, empty):
    df = sales.where("false") if empty else sales
    keys = {b: F.col(b) for b in by}
    got = grouped(df, keys, agg)
    want = df.groupBy(*by).agg(*[F.expr(x).alias(n) for n, x in agg.items()])
    assert empty or ("Expand" in plan(want) and "Expand" not in plan(got))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_nests_only_where_counts_add_up():
    cols = ["transaction_id", "customer_key", "product_key", "session_id"]
    assert nest_key(list(MEASURES.values()), cols) == "customer_key"
    assert nest_key(list(FLAGS.values()), cols) == "session_id"
    assert nest_key(["count(distinct transaction_id)", "sum(x)"], cols) is None          # one distinct count repeats no row
    assert nest_key(["count(distinct product_key)", "count(distinct customer_key)"], cols) is None  # a product has many customers
    assert nest_key(["count(distinct transaction_id)", "count(distinct session_id)", "count(distinct customer_key)"], cols) is None
    assert nest_key(["count(distinct transaction_id)", "count(distinct (month(day)))"], cols) is None
    assert nest_key([*MEASURES.values(), "median(x)"], cols) is None
    assert nest_key(list(MEASURES.values()), ["transaction_id"]) is None


def test_calls_of_a_measure():
    assert calls("(sum(case when (a) then b end) / nullif(COUNT(*), 0))") == [
        (1, 30, "sum", "case when (a) then b end"), (40, 48, "count", "*")]


@pytest.mark.parametrize("name", ["M01_metric_view", "M15_customer_purchase_summary", "M17_channel_behavior", "M19_engagement_funnel",
                                  "M21_personalization_impact", "M22_segment_trends_daily", "A02_channel_performance", "I05_location_performance"])
def test_no_row_expansion(spark, name):
    assert "Expand" not in plan(JOBS[name](Star(spark, "/root/testdata/sf0.001")))
