"""The build job: fills the star's tables once, stage by stage, so that queries read instead of deriving them.

    build(spark, "/data/retail", "/data/star")
    star = Star(spark, "/data/retail", built="/data/star")

Every stage writes one table and is marked in the log; a run that stops is resumed after its last finished
stage, and later stages read what earlier ones wrote. Facts lie in order of their day, so that a question about
some days opens few files. Position tables lie in buckets of product and location, as many for all of them
(``Config.position_buckets``), so that joins and windows by position need no exchange. The inventory of all days is
its run lengths (``intervals``); ``ledger.snapshot`` expands a period of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstar.config import Config
from shelfstar.operators import facts, ledger
from shelfstar.sources import tables
from shelfstar.star import LOG, Star

POS = ["product_key", "location_key"]


def _span(star: Star) -> DataFrame:
    d = F.col("l_shipdate")
    return star.raw("lineitem").agg(F.min(d).cast("date").alias("a"), F.max(d).cast("date").alias("b"))


def _sale_days(star: Star) -> DataFrame:
    return ledger.sale_days(star)


def _folded_returns(star: Star) -> DataFrame:
    return ledger.folded_returns(star, star.written("sale_days"))


#: Stage, job and layout, in an order in which each stage finds what it reads.
STAGES = [
    ("span", _span, None), ("customer_dim", Star.customer, ["customer_key"]), ("product_dim", Star.product, ["product_key"]),
    ("location_dim", Star.location, ["location_key"]), ("channel_dim", Star.channel, ["channel_key"]),
    ("sales", Star.sales, ["day", "product_key"]), ("sale_days", _sale_days, POS), ("folded_returns", _folded_returns, POS),
    ("stock_walk", ledger.stock_walk, POS), ("allocations", ledger.allocations, ["day", *POS]), ("positions", ledger.positions, POS),
    ("intervals", ledger.intervals, POS),
    ("stockout_events", ledger.stockout_events, ["day", *POS]), ("movements", ledger.movements, ["day", "product_key"]),
    ("carts", facts.carts, ["day", "customer_key"]), ("affinity", facts.affinity, ["customer_key", "product_key"]),
    ("forecast", facts.forecast, ["day", *POS]), ("size_fit", facts.size_fit, None),
]


def build(spark: SparkSession, raw: str, out: str, config: Config | None = None, resume: bool = True) -> Star:
    """Run the stages that are not done and return the star over the written tables."""
    log = tables.StageLog(spark, f"{out}/{LOG}")
    for name, job, keys in STAGES:
        def stage() -> None:
            star = Star(spark, raw, config, built=out)
            star._done.discard(name)
            df = job(star)
            if keys == POS:
                tables.write_bucketed(df, star.path(name), keys, star.config.position_buckets)
            else:
                tables.write(tables.clustered(df, keys) if keys else df, star.path(name), star.config.write_mode)
        log.run(name, stage, resume)
    return Star(spark, raw, config, built=out)
