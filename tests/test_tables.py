import pytest
from pyspark.sql import functions as F

from shelfstar.config import Config
from shelfstar.sources import tables
from shelfstar.sources.tables import change_feed, parts_changed, snapshot_diff


def test_write_load_and_report(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write(spark.range(10).withColumn("g", F.col("id") % 2), path)
    tables.write(spark.range(10, 15).withColumn("g", F.lit(0).cast("long")), path, "append")
    got = tables.load(spark, path, ["id"], F.col("g") == 1)
    assert got.columns == ["id"] and got.count() == 5
    assert "PushedFilters: [IsNotNull(g), EqualTo(g,1)]" in got._jdf.queryExecution().toString()
    r = tables.table_report(spark, {"t": path}).first()
    assert r.row_count == 15 and r.file_count >= 2 and r.total_bytes > 0 and r.last_modified is not None


def test_typed_create_and_schema_merge(spark, tmp_path):
    empty = tables.create(spark, [], "a long, b string")
    assert empty.count() == 0 and empty.schema.simpleString() == "struct<a:bigint,b:string>"
    merged = tables.append_merged(spark.range(2).toDF("a"), spark.createDataFrame([(5, "x")], "a long, b string"))
    assert sorted((r.a, r.b) for r in merged.collect()) == [(0, None), (1, None), (5, "x")]
    p = str(tmp_path / "v")
    spark.range(2).toDF("a").write.parquet(p + "/k=1")
    spark.createDataFrame([(5, "x")], "a long, b string").write.parquet(p + "/k=2")
    assert set(tables.read_merged(spark, p).columns) == {"a", "b", "k"}


def test_backup_and_drop_in_order(spark, tmp_path):
    for n in ("customer_dim", "sales_fact", "affinity_agg"):
        spark.range(3).write.mode("overwrite").option("path", str(tmp_path / n)).saveAsTable(n)
    made = tables.backup(spark, ["sales_fact", "nope"], "_bak")
    assert made == ["sales_fact_bak"] and spark.table("sales_fact_bak").count() == 3
    assert tables.drop_tables(spark, ["customer_dim", "sales_fact", "affinity_agg"]) == ["affinity_agg", "sales_fact", "customer_dim"]
    spark.sql("DROP TABLE sales_fact_bak")


def test_drop_order_puts_dependents_first():
    order = tables.drop_order(list(tables.DEPENDS_ON))
    for name, needs in tables.DEPENDS_ON.items():
        assert all(order.index(name) < order.index(n) for n in needs)


def test_stage_log_resumes(spark, tmp_path):
    log, ran = tables.StageLog(spark, str(tmp_path / "log")), []
    log.run("a", lambda: ran.append("a"))
    with pytest.raises(ZeroDivisionError):
        log.run("b", lambda: 1 / 0)
    log.run("a", lambda: ran.append("a again"))
    log.run("b", lambda: ran.append("b"))
    log.run("a", lambda: ran.append("a forced"), resume=False)
    assert ran == ["a", "b", "a forced"]
    assert {r.stage: r.status for r in log.latest().collect()} == {"a": "done", "b": "done"}


def test_clustered_files_hold_disjoint_ranges(spark, tmp_path):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000)
    tables.clustered(df, ["k"], 4).write.parquet(str(tmp_path / "c"))
    spans = sorted((r.a, r.b) for r in spark.read.parquet(str(tmp_path / "c")).groupBy(F.input_file_name()).agg(
        F.min("k").alias("a"), F.max("k").alias("b")).collect())
    assert len(spans) == 4 and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_optimize_writes_statistics(spark, tmp_path):
    tables.optimize(spark, spark.range(100), "opt_t", ["id"])
    assert "100 rows" in spark.sql("DESCRIBE EXTENDED opt_t").where("col_name = 'Statistics'").first().data_type
    spark.sql("DROP TABLE opt_t")


def test_snapshot_diff_sees_null_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, None), (5, "e")], "k long, v string")
    got = sorted((r.k, r.change_type, r.v) for r in tables.snapshot_diff(old, new, ["k"]).collect())
    assert got == [(2, "update", "b"), (3, "delete", "c"), (5, "insert", "e")]


def test_count_check(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 50), ("c", 200)], "table_name string, record_count long")
    got = {r.table_name: r.status for r in tables.check_counts(counts, spark.createDataFrame([("a", 90), ("b", 100), ("c", 100), ("d", 5)], "table_name string, expected_count long")).collect()}
    assert got == {"a": "OK", "b": "LOW", "c": "HIGH", "d": "EMPTY"}


def test_comments_travel_with_the_schema(spark, tmp_path):
    df = tables.describe(spark.range(3), "numbers", {"id": "the number"})
    df.write.parquet(str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    assert back.schema["id"].metadata["comment"] == "the number" and back.schema["id"].metadata["table_comment"] == "numbers"
    assert tables.comment_report(spark, back).first().comment == "the number"


@pytest.mark.parametrize("bad", [{"historical_days": 0}, {"return_delay_days": [3, 1]}, {"price_cuts": (1.0, 2.0, 3.0)}, {"write_mode": "x"},
                                 {"overstock_days": 0}, {"count_tolerance": 1.0}])
def test_config_rejects(bad):
    with pytest.raises(ValueError):
        Config.from_dict(bad)


def test_config_keeps_unknown_keys():
    c = Config.from_dict({"historical_days": 5, "site": "x"})
    assert c.historical_days == 5 and c.extra == {"site": "x"}


def test_stage_log_keeps_order_and_whole_messages(spark, tmp_path):
    log, text = tables.StageLog(spark, str(tmp_path / "log")), "x" * 2000
    for status in ("started", "failed", "started", "done"):
        log.mark("a", status, text)
    r = log.latest().first()
    assert r["status"] == "done" and r["message"] == text


def _versions(spark):
    old = [(i, i % 4, None if i % 9 == 0 else f"v{i}") for i in range(200)] + [(500, None, "x"), (500, None, "x"), (None, 1, "n")]
    new = [(k, d, v) for k, d, v in old if k != 8] + [(900, 2, "new")]
    new = [(k, d, "changed") if k == 12 else (k, d, v) for k, d, v in new]
    shape = "k long, day int, v string"
    return spark.createDataFrame(old, shape), spark.createDataFrame(new, shape)


@pytest.mark.parametrize("part", [None, "day"])
def test_change_feed_equals_the_whole_comparison(spark, part):
    old, new = (df.where("k is not null and k <> 500") for df in _versions(spark))
    got = change_feed(old, new, ["k"], F.col(part) if part else None, parts=16)
    want = snapshot_diff(old, new, ["k"])
    assert sorted(got.collect()) == sorted(want.collect()) and {r.k: r.change_type for r in got.collect()} == {8: "delete", 12: "update", 900: "insert"}


def test_parts_changed_counts_nulls_copies_and_order(spark):
    old, new = _versions(spark)
    assert sorted(r.part for r in parts_changed(old, new, F.col("day")).collect()) == [0, 2]
    assert parts_changed(old, old.orderBy(F.rand(1)).repartition(5), F.col("day")).count() == 0
    fewer = old.where("k <> 500 or k is null").unionByName(old.where("k = 500").limit(1))
    assert [r.part for r in parts_changed(old, fewer, F.col("day")).collect()] == [None]     # one of two equal rows is gone
    swapped = spark.createDataFrame([(1, None, "a"), (2, 5, None)], "k long, x int, v string")
    other = spark.createDataFrame([(1, 5, "a"), (2, None, None)], "k long, x int, v string")
    assert parts_changed(swapped, other, F.lit(0)).count() == 1
    empty = old.limit(0)
    assert parts_changed(empty, empty, F.col("day")).count() == 0
    assert sorted((r.part for r in parts_changed(empty, new, F.col("day")).collect()), key=repr) == [0, 1, 2, 3, None]


def test_equal_versions_are_not_joined(spark, tmp_path):
    """The list of changed parts is empty, so neither version is read again."""
    _versions(spark)[0].where("k is not null and k <> 500").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    feed = change_feed(df, df, ["k"], F.col("day"))
    assert feed.collect() == []
    final = feed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "FileScan" not in final
