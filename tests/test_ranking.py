import random

import numpy as np
import pandas as pd
import pytest

from shelfstar.functions import ranking


@pytest.fixture(autouse=True)
def many_blocks(monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BLOCK", 10)


@pytest.fixture
def frame(spark):
    """300 rows, a third of them with one value."""
    rng = random.Random(3)
    rows = [(i, 5 if i % 3 == 0 else rng.randint(-20, 60), rng.choice("ab")) for i in range(300)]
    return spark.createDataFrame(rows, "id long, v long, g string"), pd.DataFrame(rows, columns=["id", "v", "g"])


def test_global_row_number_is_a_total_order(frame):
    df, pdf = frame
    got = {r.id: r.n for r in ranking.global_row_number(df, "v", "id", "n").collect()}
    want = {k: i + 1 for i, k in enumerate(pdf.sort_values(["v", "id"])["id"])}
    assert got == want


@pytest.mark.parametrize("tiles", [1, 5, 7, 400])
def test_ntile(frame, tiles):
    df, pdf = frame
    got = {r.id: r.t for r in ranking.ntile(df, tiles, "v", "id", "t").collect()}
    q, r = divmod(300, tiles)
    sizes = [q + 1] * r + [q] * (tiles - r)
    label = [i + 1 for i, n in enumerate(sizes) for _ in range(n)]
    assert got == dict(zip(pdf.sort_values(["v", "id"])["id"], label))


def test_percentiles_by_group(frame):
    df, pdf = frame
    got = {r.g: (r.a, r.b, r.c) for r in ranking.exact_percentiles(df, "v", {"a": 0.0, "b": 0.37, "c": 1.0}, ["g"]).collect()}
    for g, x in pdf.groupby("g"):
        assert got[g] == pytest.approx(tuple(np.quantile(x["v"], [0, 0.37, 1])))


def test_percentiles_ignore_nulls_and_single_rows(spark):
    df = spark.createDataFrame([(None,), (4,)], "v long")
    assert ranking.exact_percentiles(df, "v", {"m": 0.5}).first().m == 4.0


def test_percent_rank(frame):
    df, pdf = frame
    got = {r.id: r.p for r in ranking.percent_rank(df, "v", "p").collect()}
    want = (pdf["v"].rank(method="min") - 1) / 299
    assert got == pytest.approx(dict(zip(pdf["id"], want)))


def test_as_many_ranges_as_the_rows_need(spark, monkeypatch):
    """No cap: with few rows to a range there are thousands of ranges, also inside one value that all rows share."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(ranking, "ROWS_PER_BLOCK", 2)
    df = spark.range(5000).select("id", F.lit(7).alias("v"))
    ranged = ranking.in_ranges(df, ["v", "id"], 5000)
    assert ranged.groupBy("_b").count().agg(F.max("count"), F.count("*")).first()[1] > 2100
    got = ranking.row_number_in_blocks(ranged, [], ["_b"], [F.col("v"), F.col("id")], "n")
    assert got.where("n <> id + 1").count() == 0 and got.count() == 5000


def test_rank_within_a_key_over_blocks(spark):
    from pyspark.sql import functions as F
    rows = [(1, s, i) for i, s in enumerate([3, 3, 1, 2, 3, 1])] + [(2, 9, 0)]
    df = spark.createDataFrame(rows, "k long, s long, i long").withColumn("_b", F.col("s"))
    got = sorted((r.k, r.s, r.i, r.n) for r in ranking.row_number_in_blocks(df, ["k"], ["_b"], [F.col("s"), F.col("i")], "n").collect())
    assert got == [(1, 1, 2, 1), (1, 1, 5, 2), (1, 2, 3, 3), (1, 3, 0, 4), (1, 3, 1, 5), (1, 3, 4, 6), (2, 9, 0, 1)]


def test_percent_rank_keeps_rows_without_a_value(spark):
    from shelfstar.functions.ranking import percent_rank
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0), (4, 5.0)], "id long, v double")
    assert {r["id"]: r["r"] for r in percent_rank(df, "v", "r").collect()} == {1: 0.0, 2: None, 3: 1.0, 4: 0.0}
