"""The window forms against a plain loop over the same lines."""

import datetime as dt
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import make_lines, write_star
from shelfstar.operators import ledger

ORDER = ["transaction_id", "line_number", "quantity", "net_cents", "discount_cents", "tax_cents", "is_return"]


def opening(p, s):
    mix = (31 * p + 17 * s) % 100
    if mix < 10:
        return mix
    return 20 + mix % 81 if s % 13 < 10 else 100 + mix * 4 if s % 13 < 12 else 10 + mix % 41


def loop(lines: pd.DataFrame, restock_allocated: bool, delays=(1, 3)):
    """Sequential replay: day rows and line rows per position."""
    days, rows = {}, []
    delay = lambda txn: dt.timedelta(days=delays[0] + txn % (delays[1] - delays[0] + 1))
    for (p, s), g in lines.groupby(["product_key", "location_key"]):
        stock, due = opening(p, s), defaultdict(int)
        if not restock_allocated:
            for r in g.itertuples():
                if r.is_return:
                    due[r.day + delay(r.transaction_id)] += r.quantity
        by_day = {d: x.sort_values(ORDER) for d, x in g.groupby("day")}
        todo = set(by_day) | set(due)
        while todo:
            d = min(todo)
            todo.discard(d)
            stock += due.pop(d, 0)
            start = stock
            for r in by_day.get(d, pd.DataFrame(columns=lines.columns)).itertuples():
                take = min(r.quantity, stock)
                rows.append((p, s, d, r.transaction_id, r.line_number, r.quantity, stock, take))
                stock -= take
                if restock_allocated and r.is_return and take:
                    back = r.day + delay(r.transaction_id)
                    due[back] += take
                    todo.add(back)
            days[(p, s, d)] = (start, stock)
    return days, sorted(rows)


@pytest.fixture
def lines(small_star):
    return pd.DataFrame([r.asDict() for r in small_star.lines().collect()])


def states(walk):
    return {(r.product_key, r.location_key, r.day): (r.stock_start, r.stock_end) for r in walk.collect()}


def same_lines(star, rows):
    got = ledger.allocations(star).collect()
    assert sorted((r.product_key, r.location_key, r.day, r.transaction_id, r.line_number, r.quantity, r.stock_before, r.allocated) for r in got) == rows
    assert any(r.is_constrained for r in got) and all(r.is_constrained == (r.allocated < r.quantity) for r in got)


def test_walk_and_allocations_match_a_loop(small_star, lines):
    days, rows = loop(lines, restock_allocated=True)
    assert states(ledger.stock_walk(small_star)) == days
    same_lines(small_star, rows)


def test_short_form_matches_a_loop(small_star, lines):
    days, _ = loop(lines, restock_allocated=False)
    assert states(ledger.reflected_walk(ledger.requested_ledger(small_star))) == days
    assert days != loop(lines, restock_allocated=True)[0]


def test_no_stock_exceeds_its_opening(small_star):
    assert all(r.stock_start <= r.opening for r in ledger.stock_walk(small_star).collect())


@pytest.mark.parametrize("delays", [(1, 1), (2, 6)])
def test_delays_follow_the_configuration(spark, tmp_path, delays):
    from shelfstar.config import Config
    from shelfstar.star import Star
    star = Star(spark, write_star(tmp_path, make_lines(200, 2, 2, 40, seed=3)), Config(return_delay_days=delays))
    lines = pd.DataFrame([r.asDict() for r in star.lines().collect()])
    assert states(ledger.stock_walk(star)) == loop(lines, True, delays)[0]


def test_a_day_with_most_lines_is_dealt_over_parts(spark, tmp_path, monkeypatch):
    """Half of all lines fall on one position and day; only lines with less than the opening ahead in their part meet."""
    from shelfstar.star import Star
    monkeypatch.setattr(ledger, "PARTS", 4)
    raw = make_lines(600, 3, 2, 30, seed=11)
    hot = raw.index % 2 == 0
    raw.loc[hot, ["l_partkey", "l_suppkey"]] = [2, 1]
    raw.loc[hot, "l_shipdate"] = dt.datetime(1995, 1, 9)
    raw["l_linenumber"] = range(len(raw))
    star = Star(spark, write_star(tmp_path, raw))
    lines = pd.DataFrame([r.asDict() for r in star.lines().collect()])
    days, rows = loop(lines, restock_allocated=True)
    assert states(ledger.stock_walk(star)) == days
    same_lines(star, rows)
    ahead = ledger.units_ahead(star.lines(), ledger.LINE_ORDER, "quantity", F.expr(ledger.OPENING)).where("product_key = 2 and location_key = 1")
    assert ahead.where("ahead is not null").count() < ahead.where("ahead is null").count()
    req = star.lines().select(*ledger.POSITION, "day", F.col("transaction_id").alias("request_id"), F.col("quantity").alias("requested"),
                              F.col("line_number").alias("priority"))
    stock = ledger.stock_walk(star).where("attempts > 0").select(*ledger.POSITION, "day", "stock_start")
    given = ledger.batch_allocation(req, stock, by_priority=True).groupBy(*ledger.POSITION, "day").agg(
        F.sum("allocated").alias("a"), F.sum("requested").alias("q"), F.first("stock_start").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.a == min(r.q, r.s) for r in given) and sum(r.n for r in given) == len(raw)


def test_intervals_cover_each_day_once_and_agree_with_totals(small_star):
    dense = pd.DataFrame([r.asDict() for r in ledger.snapshot(small_star, small_star.first_day, small_star.as_of).collect()])
    n = (small_star.as_of - small_star.first_day).days + 1
    counts = dense.groupby(["product_key", "location_key"])["day"].agg(["count", "nunique"])
    assert (counts["count"] == n).all() and (counts["nunique"] == n).all()
    totals = {r.day: r for r in ledger.daily_totals(small_star).collect()}
    for d, g in dense.groupby("day"):
        assert totals[d].quantity_available == g["quantity_on_hand"].sum()
        assert totals[d].stockouts == g["is_stockout"].sum() and totals[d].positions == len(g)


def test_current_positions_are_the_last_state(small_star):
    last = {(r.product_key, r.location_key): r.quantity_on_hand
            for r in ledger.snapshot(small_star, small_star.as_of, small_star.as_of).collect()}
    pos = ledger.positions(small_star).collect()
    assert {(r.product_key, r.location_key): r.quantity_on_hand for r in pos} == last
    assert all(r.is_stockout == (r.quantity_on_hand == 0) for r in pos)


def test_stockout_periods_are_the_zero_runs(small_star, lines):
    days, rows = loop(lines, restock_allocated=True)
    returned = {(r.product_key, r.location_key, r.transaction_id, r.line_number, r.quantity, r.day) for r in lines[lines.is_return].itertuples()}
    restock = defaultdict(set)
    for p, s, d, txn, line, q, _, take in rows:
        if take and (p, s, txn, line, q, d) in returned:
            restock[(p, s)].add(d + dt.timedelta(days=1 + txn % 3))
    want = set()
    for (p, s, d), (start, end) in days.items():
        if start > 0 and end == 0:
            later = [x for x in restock[(p, s)] if x > d]
            want.add((p, s, d, min(later) if later else None))
    got = {(r.product_key, r.location_key, r.start_day, r.end_day) for r in ledger.stockout_periods(small_star).collect()}
    assert got == want and any(w[3] is None for w in want) and any(w[3] for w in want)


def test_probes_read_stock_and_zero_days(small_star, spark):
    dense = {(r.product_key, r.location_key, r.day): r.quantity_on_hand
             for r in ledger.snapshot(small_star, small_star.first_day, small_star.as_of).collect()}
    ask = [(2, 1, small_star.first_day + dt.timedelta(days=i)) for i in range(0, 55, 9)] + [(0, 0, small_star.as_of)]
    probes = spark.createDataFrame(ask, "product_key long, location_key long, day date")
    for r in ledger.stock_as_of(small_star, probes).collect():
        assert r.stock == dense[(r.product_key, r.location_key, r.day)]
    for r in ledger.zero_days_until(small_star, probes).collect():
        want = sum(v == 0 for (p, s, d), v in dense.items() if (p, s) == (r.product_key, r.location_key) and d <= r.day)
        assert r.zero_days == want


def test_unknown_position_holds_its_opening_stock(small_star, spark):
    probes = spark.createDataFrame([(777, 3, small_star.as_of)], "product_key long, location_key long, day date")
    assert ledger.stock_as_of(small_star, probes).first().stock == opening(777, 3)


@pytest.mark.parametrize("stock,requests,want", [
    (0, [3, 1], [0, 0]), (1, [3, 1], [1, 0]), (5, [3, 1, 4], [3, 1, 1]), (10, [2, 2, 2], [2, 2, 2])])
def test_batch_allocation_by_priority(spark, stock, requests, want):
    d = dt.date(2000, 1, 1)
    req = spark.createDataFrame([(1, 1, d, i, q, 100 - i) for i, q in enumerate(requests)],
                                "product_key long, location_key long, day date, request_id long, requested int, priority int")
    start = spark.createDataFrame([(1, 1, d, stock)], "product_key long, location_key long, day date, stock_start long")
    got = ledger.batch_allocation(req, start, by_priority=True).orderBy("request_id").collect()
    assert [r.allocated for r in got] == want and {r.stock_start for r in got} == {stock}


def test_batch_allocation_order_depends_on_the_seed_only(spark):
    d = dt.date(2000, 1, 1)
    req = spark.createDataFrame([(1, 1, d, i, 1) for i in range(20)], "product_key long, location_key long, day date, request_id long, requested int")
    start = spark.createDataFrame([(1, 1, d, 7)], "product_key long, location_key long, day date, stock_start long")
    pick = lambda seed: {r.request_id for r in ledger.batch_allocation(req, start, seed).where("allocated > 0").collect()}
    assert len(pick(1)) == 7 and pick(1) == pick(1) and pick(1) != pick(2)


def test_peak_month_arithmetic(spark):
    days = [(dt.date(2000, 10, 1), dt.date(2000, 10, 31), False), (dt.date(2000, 10, 31), dt.date(2000, 11, 1), True),
            (dt.date(2000, 12, 31), dt.date(2001, 1, 5), True), (dt.date(2001, 1, 1), dt.date(2001, 10, 31), False),
            (dt.date(2001, 1, 1), dt.date(2001, 11, 1), True), (dt.date(2000, 1, 1), dt.date(2002, 1, 1), True)]
    df = spark.createDataFrame(days, "a date, b date, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", ledger.touches_months(F.col("a"), F.col("b"), (11, 12))).collect())
