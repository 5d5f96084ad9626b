"""Metric functions in SQL equal the metric queries."""

import datetime as dt

import pytest

from shelfstar.plans import load_all
from shelfstar.star import Star

load_all()
from shelfstar.plans import sql_layer  # noqa: E402
from shelfstar.plans.sql_layer import VIEWS, ask  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return Star(spark, SF)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", list(VIEWS))
def test_every_view_equals_its_metric_query(star, name):
    first = list(VIEWS[name].dimensions)[0]
    got = ask(star, f"select * from {name}(by => '{first}')")
    want = VIEWS[name].query([first]).frame(star)
    assert got.columns == [*VIEWS[name].dimensions, *VIEWS[name].measures]
    assert rows(got.select(want.columns)) == rows(want) and dict(got.dtypes).items() >= dict(want.dtypes).items()


def test_all_dimensions_by_default(star):
    assert rows(ask(star, "select * from channel_behavior()")) == rows(VIEWS["channel_behavior"].query().frame(star))


def test_filters_of_dimensions_days_and_measures(star):
    got = ask(star, "select segment, total_revenue from customer_purchase_summary('segment', keep_channel_name => :c, since => :a, until => :b) "
                    "where total_revenue > :least", c="Website - Mobile", a=dt.date(1996, 1, 1), b=dt.date(1997, 12, 31), least=1.5)
    want = VIEWS["customer_purchase_summary"].query(["segment"], ["total_revenue"], having="total_revenue > 1.5",
                                           where="channel_name = 'Website - Mobile' and year between 1996 and 1997").frame(star)
    assert rows(got) == rows(want) and got.count()


def test_no_dimension_and_spaces(star):
    assert ask(star, "select unique_customers from channel_behavior('')").count() == 1
    assert rows(ask(star, "select * from channel_behavior(' segment , channel_name')")) == rows(ask(star, "select * from channel_behavior('segment,channel_name')"))


def test_unknown_dimension_fails(star):
    with pytest.raises(Exception, match="no such dimension: colour"):
        ask(star, "select * from channel_behavior('segment,colour')").collect()


def test_what_is_not_asked_vanishes_from_the_plan(star):
    text = ask(star, "select segment, total_revenue from channel_behavior('segment')")._jdf.queryExecution().optimizedPlan().toString()
    assert "raise_error" not in text and "Expand" not in text and "is_digital" not in text.split("Aggregate")[1]


def test_tables_with_parameters(star):
    got = ask(star, "select count(*) as n from gold_sales_fact where product_key = :p", p=7)
    assert got.first().n == sql_layer.TABLES["gold_sales_fact"](star).where("product_key = 7").count() > 0
