import datetime as dt
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfstar.operators import ledger
from shelfstar.streaming import jobs


def write_events(spark, folder, rows, name):
    df = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    df = df.astype({"ts": "datetime64[us]", "event_id": "Int64"})
    folder.mkdir(exist_ok=True)
    df.to_parquet(folder / f"{name}.parquet", index=False)


def test_events_count_late_rows_open_hours_and_repeats_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10, 0)
    e = lambda i, m, kind="view": (i, t + dt.timedelta(minutes=m), 1, kind, 2.5, '{"k": 4}')
    src, layers = tmp_path / "in", jobs.EventLayers(spark, str(tmp_path / "out"))
    write_events(spark, src, [e(1, 1), e(1, 1), e(2, 5), e(3, 50, "click")], "a")
    layers.catch_up(jobs.read_files(spark, str(src)))
    write_events(spark, src, [e(4, 200), e(5, 201), e(8, 3000)], "b")  # two days on
    layers.catch_up(jobs.read_files(spark, str(src)))
    first = {f.name for f in (tmp_path / "out/silver").rglob("*.parquet")}
    write_events(spark, src, [e(6, 2), e(1, 1), (7, None, 1, "view", 2.5, ""), (None, t, 1, "view", 2.5, "")], "c")  # long after its hour, a repeat, no time, no id
    layers.catch_up(jobs.read_files(spark, str(src)))
    got = {(r.hour.day, r.hour.hour, r.event_type): (r.events, r.event_cents) for r in layers.hours().collect()}
    assert got == {(1, 10, "view"): (3, 750), (1, 10, "click"): (1, 250), (1, 13, "view"): (2, 500), (3, 12, "view"): (1, 250)}
    assert sorted((r.event_id for r in spark.read.parquet(layers.rejected).collect()), key=str) == [7, None]
    assert first <= {f.name for f in (tmp_path / "out/silver").rglob("*.parquet")}  # earlier rows were not written again
    layers.catch_up(jobs.read_files(spark, str(src)))  # nothing new
    assert {(r.hour.day, r.hour.hour, r.event_type): (r.events, r.event_cents) for r in layers.hours().collect()} == got


def stock_runs(spark, folder, parts, last):
    """The moves after the parts have come one after the other, each in a run of its own, and a closing tick."""
    src, clock = str(folder / "in"), jobs.Clock(spark, str(folder / "clock"))

    def run():
        stream = spark.readStream.schema(jobs.REQUEST).parquet(src)
        jobs.start_stock(stream, str(folder / "out"), str(folder / "ck"), late_days=5, clock=clock).awaitTermination()

    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        run()
    clock.tick(last)
    run()
    return spark.read.schema(jobs.MOVES).parquet(str(folder / "out"))


SALE = ["product_key", "location_key", "day", "transaction_id", "line_number", "quantity", "allocated", "stock_before"]


@pytest.mark.parametrize("split", ["by_day", "out_of_order"])
def test_running_stock_does_not_depend_on_micro_batches(small_star, spark, tmp_path, split):
    from shelfstar.config import Config
    from shelfstar.star import Star
    star = Star(spark, small_star.dir, Config(return_delay_days=(2, 6)) if split == "out_of_order" else None)
    lines = jobs.requests_from_lines(star.lines(), star.config)
    first = (star.first_day - dt.date(1970, 1, 1)).days
    come = F.col("day") + (F.pmod(F.xxhash64("transaction_id", "quantity"), F.lit(5)) if split == "out_of_order" else F.lit(0))
    edges = [first, first + 17, first + 18, first + 41, first + 99]
    moves = stock_runs(spark, tmp_path, [lines.where((come >= a) & (come < b)) for a, b in zip(edges, edges[1:])], star.as_of + dt.timedelta(days=30))
    got = moves.where("kind = 'sale'").withColumnRenamed("requested", "quantity").select(SALE)
    exact = ledger.allocations(star).select(SALE)
    assert got.count() == lines.count() and got.exceptAll(exact).count() == 0 and moves.where("kind = 'late'").count() == 0
    back = {(r.product_key, r.location_key, r.day): r.n for r in moves.where("kind = 'restock'").groupBy("product_key", "location_key", "day").agg(
        F.sum(F.col("stock_after") - F.col("stock_before")).alias("n")).collect()}
    due = {(r.product_key, r.location_key, r.day): r.restock for r in ledger.daily_ledger(star).where("restock > 0").collect()}
    assert back == due


def test_requests_for_settled_days_are_passed_on(spark, tmp_path):
    def asked(*rows):
        return spark.createDataFrame([(dt.datetime(1970, 1, 1) + dt.timedelta(days=d) if d is not None else None, 1, 2, 10, d, t, 1, q, 0, 0, 0, r, 1)
                                      for d, t, q, r in rows], jobs.REQUEST)

    parts = [asked((100, 1, 7, True), (101, 2, 4, False)), asked((120, 3, 8, False), (100, 4, 1, False)), asked((130, 7, 1, False)),
             asked((101, 5, 1, False), (None, 6, 1, False), (127, 8, 20, False))]
    moves = stock_runs(spark, tmp_path, parts, dt.date(1971, 1, 1))
    got = sorted((r.kind, r.transaction_id or 0, r.allocated, r.stock_before, r.stock_after) for r in moves.collect())
    assert got == [("late", 5, None, None, None), ("late", 6, None, None, None), ("restock", 0, None, 2, 9), ("sale", 1, 7, 10, 3), ("sale", 2, 4, 9, 5),
                   ("sale", 3, 5, 5, 0), ("sale", 4, 1, 3, 2), ("sale", 7, 0, 0, 0), ("sale", 8, 0, 0, 0)]


def test_positions_share_state_rows(spark, tmp_path):
    n = 6000  # positions of one line each; a state row or more for each of them made the store as slow as its calls
    day = F.lit(100) + F.col("id") % 5
    lines = spark.range(n).select(F.timestamp_seconds(day * 86_400).alias("at"), F.col("id").alias("product_key"), F.lit(3).alias("location_key"), F.lit(5).alias("opening"),
                                  day.alias("day"), F.col("id").alias("transaction_id"), F.lit(1).alias("line_number"), F.lit(8).alias("quantity"), F.lit(0).alias("net_cents"),
                                  F.lit(0).alias("discount_cents"), F.lit(0).alias("tax_cents"), F.lit(False).alias("is_return"), F.lit(1).alias("delay"))
    lines.coalesce(1).write.parquet(str(tmp_path / "in"))
    clock = jobs.Clock(spark, str(tmp_path / "clock"))
    clock.tick(dt.date(1971, 1, 1))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = jobs.start_stock(stream, str(tmp_path / "out"), str(tmp_path / "ck"), clock=clock)
    q.awaitTermination()
    moves = spark.read.schema(jobs.MOVES).parquet(str(tmp_path / "out"))
    assert moves.where("kind = 'sale' and allocated = 5 and stock_after = 0").count() == n == moves.count()
    assert max(x["numRowsTotal"] for p in q.recentProgress for x in p["stateOperators"]) < 2 * n


class Kept:
    """The state of one key, in memory."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return type("Value", (), {"get": lambda s: getattr(s, "v", None), "update": lambda s, v: setattr(s, "v", v)})()

    def getMapState(self, *_):
        chunks = {}
        return type("Map", (), {"values": lambda s: iter([*chunks.values()]), "updateValue": lambda s, k, v: chunks.update({k: v}), "clear": lambda s: chunks.clear()})()

    def registerTimer(self, at):
        self.timers.add(at)


def through_shard(batches, schema, end):
    """Moves of batches of requests, each with the watermark in days that holds for it, in one shard."""
    shard, kept, out = jobs.RunningStock(), Kept(), []
    shard.init(kept)
    for mark, rows in [*batches, (end, [])]:
        ms = mark * jobs.DAY_MS
        timer = type("Timer", (), {"getCurrentWatermarkInMs": lambda s: ms})()
        packed = pa.RecordBatch.from_pylist([{**r, "shard": 0} for r in rows], pa.schema([*schema, ("shard", pa.int32())]))
        frames = (pd.DataFrame({"requests": b.column(1).to_pylist()}) for b in jobs.pack(iter([packed])))
        out += [b for f in shard.handleInputRows((0,), frames, timer) for b in f["moves"]]
        for at in sorted(t for t in kept.timers if t <= ms):
            out += [b for f in shard.handleExpiredTimer((0,), timer, None) for b in f["moves"]]
            kept.timers.discard(at)
    return [r for b in jobs.unpack(iter([pa.RecordBatch.from_pydict({"moves": out})])) for r in b.to_pylist()]


ASKED = pa.schema([(c, {"i8": pa.int64(), "i4": pa.int32(), "i1": pa.bool_()}[jobs.ASKED[c].str[1:]]) for c in jobs.ASKED.names[:-1]])
EPOCH = dt.date(1970, 1, 1)


def replayed(rows):
    """Units of each line by the rule of the check SQL: what is due comes back before a line, nulls sort last and a null quantity takes all."""
    left, got = {}, {}
    order = lambda r: [(r[c] is None, r[c] or 0) for c in ("day", *jobs.IN_DAY)]
    for r in sorted(rows, key=order):
        stock, due = left.get(r["product_key"], (r["opening"], []))
        stock += sum(u for d, u in due if d <= r["day"])
        take = stock if r["quantity"] is None else min(stock, r["quantity"])
        got[r["net_cents"]] = (stock, take)
        back = [(r["day"] + r["delay"], take)] if r["is_return"] and r["delay"] is not None else []
        left[r["product_key"]] = (stock - take, [x for x in due if x[0] > r["day"]] + back)
    return got


@pytest.mark.parametrize("block", [3, 1 << 14])
def test_shard_gives_what_a_replay_of_each_line_gives(monkeypatch, block):
    monkeypatch.setattr(jobs, "BLOCK", block)
    monkeypatch.setattr(jobs, "PACK", 40)
    rng = random.Random(3)
    some = lambda x: None if rng.random() < 0.05 else x
    rows = []
    for i in range(900):  # position 0 has a third of all lines; net_cents is unlike in all of them
        p, t = (0 if i % 3 == 0 else rng.choice([-5, 1, 2, 256, 1 << 40])), some(rng.randint(0, 1 << 60))
        rows.append({"product_key": p, "location_key": 7, "opening": 60 + p % 50, "day": rng.randint(100, 180), "transaction_id": t, "line_number": some(rng.randint(1, 7)),
                     "quantity": some(rng.randint(0, 30)), "net_cents": i, "discount_cents": some(3), "tax_cents": 1, "is_return": some(rng.random() < 0.5),
                     "delay": None if t is None else 1 + t % 3})
    parts = [(0, rows[:100]), (0, rows[100:500]), (99, rows[500:600]), (99, rows[600:])]
    moves = through_shard(parts, ASKED, 400)
    want = replayed(rows)
    key = lambda r: (r["product_key"], r["day"], r["transaction_id"] is None, r["transaction_id"] or 0, r["line_number"] is None, r["line_number"] or 0)
    sold = sorted(((*key({**m, "day": (m["day"] - EPOCH).days}), m["requested"], m["stock_before"], m["allocated"], m["stock_after"]) for m in moves if m["kind"] == "sale"), key=str)
    assert sold == sorted(((*key(r), r["quantity"], want[r["net_cents"]][0], want[r["net_cents"]][1], want[r["net_cents"]][0] - want[r["net_cents"]][1]) for r in rows), key=str)
    back = sum(m["stock_after"] - m["stock_before"] for m in moves if m["kind"] == "restock")
    assert back == sum(want[r["net_cents"]][1] for r in rows if r["is_return"] and r["delay"] is not None) > 0
    by_day = sorted(rows, key=lambda r: r["day"])  # day after day gives the same
    cut = [(max(0, d - 1), [r for r in by_day if r["day"] == d]) for d in range(100, 181)]
    assert sorted(map(str, through_shard(cut, ASKED, 400))) == sorted(map(str, moves))


def test_days_are_settled_by_position_and_odd_requests_are_late():
    r = {"product_key": 1, "location_key": 2, "opening": 9, "day": 100, "transaction_id": 1, "line_number": 1, "quantity": 4, "net_cents": 0, "discount_cents": 0, "tax_cents": 0,
         "is_return": False, "delay": 1}
    parts = [(0, [r]), (111, [{**r, "transaction_id": 2}, {**r, "product_key": 3, "transaction_id": 3}, {**r, "product_key": None, "transaction_id": 4},
                              {**r, "location_key": None, "transaction_id": 5}, {**r, "day": None, "transaction_id": None, "quantity": None}, {**r, "product_key": 8, "opening": None, "transaction_id": 6}])]
    parts.insert(1, (111, []))  # position 1 is settled up to day 110, position 3 has not come yet
    moves = through_shard(parts, ASKED, 400)
    got = sorted(((m["kind"], m["product_key"], m["location_key"], m["transaction_id"], m["requested"], m["allocated"], m["stock_before"], m["stock_after"]) for m in moves), key=str)
    assert got == sorted([("sale", 1, 2, 1, 4, 4, 9, 5), ("sale", 3, 2, 3, 4, 4, 9, 5), ("late", 1, 2, 2, 4, None, None, None), ("late", None, 2, 4, 4, None, None, None),
                          ("late", 1, None, 5, 4, None, None, None), ("late", 1, 2, None, None, None, None, None), ("late", 8, 2, 6, 4, None, None, None)], key=str)
    assert [m["day"] for m in moves if m["kind"] == "late"].count(None) == 1


def changes(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, change_type string, version int")


def rows_of(df):
    return {r.k: r.v for r in df.collect()}


def test_sync_upserts_deletes_and_is_idempotent(spark, tmp_path):
    t = jobs.SyncedTable(spark, str(tmp_path / "t"), "k", "version", buckets=3)
    assert t.read() is None
    t.apply(changes(spark, [(i, f"a{i}", "insert", 1) for i in range(7)]), 0)
    second = changes(spark, [(1, "old", "update", 2), (1, "new", "update", 3), (2, "", "delete", 2), (9, "n9", "insert", 2)])
    t.apply(second, 1)
    want = {0: "a0", 1: "new", 3: "a3", 4: "a4", 5: "a5", 6: "a6", 9: "n9"}
    assert rows_of(t.read()) == want
    t.apply(second, 1)  # a batch delivered twice
    assert rows_of(t.read()) == want
    t.apply(changes(spark, [(0, "", "delete", 5), (3, "", "delete", 5), (6, "", "delete", 5), (9, "", "delete", 5)]), 2)
    assert rows_of(t.read()) == {1: "new", 4: "a4", 5: "a5"}  # bucket 0 is empty now


@pytest.mark.parametrize("trigger", [{"availableNow": True}, {"processingTime": "1 second"}])
def test_sync_runs_triggered_and_continuous(spark, tmp_path, trigger):
    feed = changes(spark, [(1, "a", "insert", 1), (2, "b", "insert", 1)])
    feed.write.parquet(str(tmp_path / "f"))
    t = jobs.SyncedTable(spark, str(tmp_path / "t"), "k", "version")
    q = jobs.start_sync(spark.readStream.schema(feed.schema).parquet(str(tmp_path / "f")), t, str(tmp_path / "ck"), trigger)
    q.processAllAvailable()
    q.stop()
    assert rows_of(t.read()) == {1: "a", 2: "b"}
