import os
import random
import sys
from datetime import datetime, timedelta

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def make_lines(n, parts, suppliers, days, seed, returned=0.4):
    rng = random.Random(seed)
    day0 = datetime(1995, 1, 2)
    rows = []
    for i in range(n):
        q = rng.randint(1, 50)
        rows.append((rng.randint(0, max(3, n // 3)), rng.randint(0, parts - 1), rng.randint(0, suppliers - 1), rng.randint(1, 7), float(q),
                     round(q * rng.uniform(900, 2100), 2), rng.randint(0, 10) / 100, rng.randint(0, 8) / 100,
                     "R" if rng.random() < returned else rng.choice("AN"), "F", day0 + timedelta(days=rng.randint(0, days - 1))))
    return pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                                       "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])


def write_star(folder, lines, customers=6, events=None):
    """A small set of raw tables around the given lines."""
    def put(name, df):
        df = df.copy()
        for c in df.columns:
            if str(df[c].dtype).startswith("datetime"):
                df[c] = df[c].astype("datetime64[us]")
        df.to_parquet(f"{folder}/{name}.parquet", index=False)

    put("lineitem", lines)
    keys = sorted(set(lines["l_orderkey"]))
    put("orders", pd.DataFrame({"o_orderkey": keys, "o_custkey": [k % customers for k in keys], "o_orderstatus": "F", "o_totalprice": 1.0,
                                "o_orderdate": datetime(1995, 1, 1), "o_orderpriority": "1-URGENT"}))
    put("customer", pd.DataFrame({"c_custkey": range(customers), "c_name": [f"c{i}" for i in range(customers)], "c_nationkey": 0,
                                  "c_acctbal": [100.0 * i for i in range(customers)], "c_mktsegment": ["BUILDING", "HOUSEHOLD"] * (customers // 2)}))
    parts = int(lines["l_partkey"].max()) + 1
    put("part", pd.DataFrame({"p_partkey": range(parts), "p_name": ["red ring"] * parts, "p_brand": "Brand#1", "p_type": "SMALL", "p_size": 3,
                              "p_retailprice": [900.0 + i for i in range(parts)]}))
    sup = int(lines["l_suppkey"].max()) + 1
    put("supplier", pd.DataFrame({"s_suppkey": range(sup), "s_name": [f"s{i}" for i in range(sup)], "s_nationkey": 0, "s_acctbal": 1.0}))
    put("nation", pd.DataFrame({"n_nationkey": [0], "n_name": ["N"], "n_regionkey": [0]}))
    put("region", pd.DataFrame({"r_regionkey": [0], "r_name": ["ASIA"]}))
    if events is not None:
        put("events", events)
    return str(folder)


@pytest.fixture
def small_star(spark, tmp_path):
    """Few positions with long histories; one position holds a third of all lines."""
    from shelfstar.star import Star
    lines = make_lines(600, 6, 5, 60, seed=7)
    hot = lines.index % 3 == 0
    lines.loc[hot, ["l_partkey", "l_suppkey"]] = [2, 1]
    return Star(spark, write_star(tmp_path, lines))
