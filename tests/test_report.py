import pytest

from shelfstar.plans.report import MetricView, Report, for_check, relation_sql

VIEW = MetricView("lines", {"channel": "channel_key", "month": "month(day)"},
                  {"orders": "count(distinct transaction_id)", "units": "cast(sum(quantity) as bigint)"}, "not is_return")


@pytest.fixture
def lines(small_star):
    return [r for r in small_star.lines().collect() if not r.is_return]


def test_measures_are_aggregated_at_the_grain_of_the_query(small_star, lines):
    got = {r.channel: (r.orders, r.units) for r in VIEW.query(["channel"]).frame(small_star).collect()}
    assert got == {c: (len({r.transaction_id for r in lines if r.channel_key == c}), sum(r.quantity for r in lines if r.channel_key == c))
                   for c in {r.channel_key for r in lines}}


def test_no_dimensions_gives_one_row(small_star, lines):
    row = VIEW.query([], {"n": "orders"}).frame(small_star).collect()
    assert [r.asDict() for r in row] == [{"n": len({r.transaction_id for r in lines})}]


def test_all_clauses(small_star, lines):
    r = VIEW.query(["channel"], ["units"], where="month = 1 and channel <> 3", having="units > 50", extra={"months": "count(distinct month)"},
                   post={"double": "units * 2"}, order="units desc, channel", limit=3)
    want = {}
    for x in lines:
        if x.day.month == 1 and x.channel_key != 3:
            want[x.channel_key] = want.get(x.channel_key, 0) + x.quantity
    want = sorted(((u, c) for c, u in want.items() if u > 50), key=lambda t: (-t[0], t[1]))[:3]
    got = r.frame(small_star).collect()
    assert [(x.units, x.channel) for x in got] == want and all(x.double == 2 * x.units and x.months == 1 for x in got)
    assert "order by units desc nulls last, channel asc nulls first limit 3" in r.sql()


def test_where_may_name_a_dimension_inside_a_longer_word(small_star):
    v = MetricView("lines", {"day": "day", "days": "month(day)"}, {"n": "count(*)"})
    assert v.query(["days"], where="days = 2").frame(small_star).count() == 1


def test_text_for_the_check_side():
    assert for_check("DAYS({asof}, day) div 7") == "date_diff('day', day, (select d from horizon)) // 7"
    assert relation_sql("lines product", 30) == ("(select * from lines r where day >= (select d from asof) - 30) r join product_d using (product_key)"
                                                 .replace("asof", "horizon"))
    assert Report("lines", {"a": "day"}, {}).sql() == "select day as a from lines r"
