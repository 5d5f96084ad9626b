import pytest

from shelfstar.build import STAGES, build
from shelfstar.plans import load_all
from shelfstar.plans.registry import JOBS
from shelfstar.sources import tables
from shelfstar.star import LOG, Star

load_all()
SF = "/root/testdata/sf0.001"
NAMES = ["M09_inventory_stockout_impact", "M28_by_type", "M20_cart_abandonment", "Q04_category_pairs", "A01_customer_product_affinity", "I01_health_dashboard",
         "I16_best_seller_risk", "I21_receipts_last_month", "L03_allocate_in_order", "L07_daily_snapshot_by_location", "L17_forecast_accuracy",
         "X06_omnichannel_fulfilment", "X07_recommendations_for_one_customer", "X10_size_fit_patterns"]


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("star"))
    return build(spark, SF, out), out


@pytest.mark.parametrize("name", NAMES)
def test_queries_agree_over_written_tables(spark, built, name):
    assert rows(JOBS[name](built[0])) == rows(JOBS[name](Star(spark, SF)))


def test_a_finished_build_repeats_nothing_and_an_unfinished_stage_is_not_read(spark, built):
    star, out = built
    log = tables.StageLog(spark, f"{out}/{LOG}")
    before = log._rows().count()
    build(spark, SF, out)
    assert log._rows().count() == before == 2 * len(STAGES)
    log.mark("positions", "started")
    assert star.has("positions") and not Star(spark, SF, built=out).has("positions")


def test_written_tables_are_read_and_pruned(spark, built):
    from shelfstar.operators import ledger
    star = built[0]
    text = ledger.movements(star, star.days_back(30))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day," in text and "lineitem" not in text


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_position_tables_join_and_window_without_an_exchange(spark, built):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from shelfstar.operators import ledger
    star, pos = built[0], ["product_key", "location_key"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        walk, here, runs = star.written("stock_walk"), star.written("positions"), star.written("intervals")
        joined = walk.join(here.select(*pos, "quantity_on_hand"), pos).join(runs.select(*pos, "stock"), pos)
        assert exchanges(joined) == 0
        assert exchanges(walk.withColumn("n", F.row_number().over(Window.partitionBy(*pos).orderBy("day")))) == 0
        assert exchanges(walk.groupBy(*pos).agg(F.max("day"))) == 0
        assert exchanges(ledger.history_check(star)) == 0
        plain = lambda name: spark.read.parquet(star.path(name))
        want = plain("stock_walk").join(plain("positions").select(*pos, "quantity_on_hand"), pos).join(plain("intervals").select(*pos, "stock"), pos)
        assert rows(joined) == rows(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_bucketed_table_tells_its_own_layout(spark, tmp_path):
    """Written anew with another number of buckets, it is read with that number; nulls, repeated rows and an empty table keep their rows."""
    path, shape = str(tmp_path / "t"), "a long, b long, c string"
    data = [(i % 7, None if i % 5 == 0 else i, "x") for i in range(50)] + [(1, 1, None)] * 3
    for n in (4, 3):
        tables.write_bucketed(spark.createDataFrame(data, shape), path, ["a", "b"], n)
        back = tables.read(spark, path)
        assert rows(back) == rows(spark.createDataFrame(data, shape)) and back.columns == ["a", "b", "c"]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        twice = back.groupBy("a", "b").count().join(back, ["a", "b"])
        assert exchanges(twice) == 0 and twice.count() == sum(b is not None for _, b, _ in data)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tables.write_bucketed(spark.createDataFrame([], shape), path, ["a", "b"], 2)
    assert tables.read(spark, path).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("write_")]
