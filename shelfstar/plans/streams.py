"""Streaming jobs Z01-Z03, run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstar.plans.registry import query
from shelfstar.sources.tables import scratch
from shelfstar.star import Star
from shelfstar.streaming import jobs


@query("Z01_hourly_events", """
    select cast(date_trunc('hour', ts) as timestamp) as hour, event_type, count(*) as events, cast(sum(cast(floor(value * 100) as bigint)) as bigint) as event_cents
    from events where event_id is not null and ts is not null group by 1, 2""")
def hourly_events(star: Star) -> DataFrame:
    """Every hour of the backlog, the open ones included."""
    layers = jobs.EventLayers(star.spark, scratch(star.spark, "events"))
    layers.catch_up(jobs.read_files(star.spark, f"{star.dir}/events.parquet"))
    return layers.hours()


@query("Z02_running_stock", """select product_key, location_key, day, transaction_id, line_number, quantity as requested, allocated, stock_before,
    stock_before - allocated as stock_after from alloc""")
def running_stock(star: Star) -> DataFrame:
    """Allocations of all sale lines as a stream of requests, closed by a tick after the last return is due."""
    out = scratch(star.spark, "stock")
    lines = star.lines(raw=jobs.read_files(star.spark, f"{star.dir}/lineitem.parquet"))
    clock, late = jobs.Clock(star.spark, f"{out}/clock"), 7

    def run() -> None:
        jobs.start_stock(jobs.requests_from_lines(lines, star.config), f"{out}/moves", f"{out}/state", late_days=late, clock=clock).awaitTermination()

    run()
    clock.tick(star.days_back(-late - star.config.return_delay_days[1] - 2))
    run()
    sale = F.col("kind") == "sale"
    return star.spark.read.schema(jobs.MOVES).parquet(f"{out}/moves").where(sale).select(
        "product_key", "location_key", "day", "transaction_id", "line_number", "requested", "allocated", "stock_before", "stock_after")


@query("Z03_vector_sync", """
    select vec_id, case when vec_id % 7 = 0 then label + 100 else label end as label, len(embedding) as dims from embeddings where vec_id % 11 <> 0""")
def vector_sync(star: Star) -> DataFrame:
    """The vector table after all inserts, then updates of every 7th and deletes of every 11th row, one file batch at a time."""
    out, e = scratch(star.spark, "sync"), star.raw("embeddings")
    change = F.when(F.col("vec_id") % 11 == 0, "delete").otherwise("update")
    label = F.when(F.col("vec_id") % 7 == 0, F.col("label") + 100).otherwise(F.col("label"))
    e.withColumns({"change_type": F.lit("insert"), "version": F.lit(1)}).write.parquet(f"{out}/feed")
    (e.where("vec_id % 7 = 0 or vec_id % 11 = 0").withColumns({"label": label, "change_type": change, "version": F.lit(2)})
     .write.mode("append").parquet(f"{out}/feed"))
    schema = star.spark.read.parquet(f"{out}/feed").schema
    feed = star.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/feed")
    table = jobs.SyncedTable(star.spark, f"{out}/table", "vec_id", "version")
    jobs.start_sync(feed, table, f"{out}/state").awaitTermination()
    return table.read().select("vec_id", "label", F.size("embedding").alias("dims"))
