"""Exact ranks, tiles and percentiles without putting one group into one task.

A plain ``Window.orderBy`` without partitions sorts everything in one task, and the
exact ``percentile`` aggregate merges all distinct values into one buffer. Here the rows
are range-partitioned by their whole order first, as many ranges as the rows need, and the
ranges are written down: rows are counted per range, the counts are prefix-summed (one row
per range), and only the inside of a range is sorted. The tie key is part of the order, so a
value that fills a third of the table is spread over many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstar.sources.tables import cut

ROWS_PER_BLOCK = 200_000


def in_ranges(df: DataFrame, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """``df`` with ``_b``, the number of its range in the order of some columns; written, so that ranges stay as they are.

    There is a range for every ``ROWS_PER_BLOCK`` of ``rows``; where these are not known, as many as the session shuffles into,
    coalesced by adaptive execution.
    """
    n = [] if rows is None else [max(1, -(-rows // ROWS_PER_BLOCK))]
    return cut(df.repartitionByRange(*n, *order).withColumn("_b", F.spark_partition_id()), "ranges")


def row_number_in_blocks(df: DataFrame, keys: Sequence[str], blocks: Sequence[str],
                         order: Sequence[Column], out: str) -> DataFrame:
    """row_number per ``keys`` where ``blocks`` are columns that rise with ``order``."""
    part = [*keys, *blocks]
    counts = df.groupBy(*part).agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    before = before.orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*part).orderBy(*order)
    return (df.join(offsets, part)
            .withColumn(out, F.col("_off") + F.row_number().over(inside))
            .drop("_off"))


def global_row_number(df: DataFrame, value: str, tie: str, out: str, rows: int | None = None) -> DataFrame:
    """1-based position of each row when the whole table, of ``rows`` rows, is ordered by (value, tie)."""
    ranged = in_ranges(df, [value, tie], df.count() if rows is None else rows)
    return row_number_in_blocks(ranged, [], ["_b"], [F.col(value), F.col(tie)], out).drop("_b")


def ntile(df: DataFrame, tiles: int, value: str, tie: str, out: str, rows: int | None = None) -> DataFrame:
    """ntile over the whole table; ``tie`` makes the order total."""
    rows = df.count() if rows is None else rows
    q, r = divmod(rows, tiles)
    ranked = global_row_number(df, value, tie, "_rn", rows)
    zero = F.col("_rn") - 1
    big = r * (q + 1)
    tile = F.when(zero < big, F.floor(zero / (q + 1)) + 1)
    tile = tile.otherwise(F.floor((zero - big) / q) + 1 + r) if q else tile
    return ranked.withColumn(out, tile.cast("int")).drop("_rn")


def value_counts_before(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """One row per distinct value with rows (and weight) that sort strictly before it."""
    sums = [F.count("*").alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    return _prefix(in_ranges(df.groupBy(value).agg(*sums), [value]), [], value, ["_n"] + (["_w"] if weight else []))


def _prefix(hist: DataFrame, keys: Sequence[str], value: str, cols: Sequence[str]) -> DataFrame:
    part = [*keys, "_b"]
    sums = hist.groupBy(*part).agg(*[F.sum(c).alias(c) for c in cols])
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    prev = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(*part, *[F.coalesce(F.sum(c).over(prev), F.lit(0)).alias(f"{c}_off") for c in cols],
                       *[F.sum(c).over(w).alias(f"{c}_all") for c in cols])
    inner = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.join(offs, part)
    for c in cols:
        out = out.withColumn(f"{c}_before", F.col(f"{c}_off") + F.coalesce(F.sum(c).over(inner), F.lit(0)))
    return out.drop(*[f"{c}_off" for c in cols], "_b")


def percent_rank(df: DataFrame, value: str, out: str, base: DataFrame | None = None) -> DataFrame:
    """(rows strictly before) / (rows - 1), ties share a rank; rows without a value stay and have none.

    ``base`` is a table with the same values that is cheaper to read.
    """
    base = df if base is None else base
    before = value_counts_before(base.where(F.col(value).isNotNull()), value)
    rank = F.when(F.col("_n_all") > 1, F.col("_n_before") / (F.col("_n_all") - 1)).otherwise(F.lit(0.0))
    return df.join(before.select(value, rank.alias(out)), value, "left")


def exact_percentiles(df: DataFrame, value: str, points: dict[str, float], keys: Sequence[str] = (),
                      extra: dict[str, Column] | None = None) -> DataFrame:
    """Interpolated percentiles (continuous definition), exact, one row per key.

    ``extra`` are further aggregates over the histogram, with columns ``value`` and ``_n``
    (rows that have the value), so counts, sums and extremes need no second scan.
    """
    keys = list(keys)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = _prefix(in_ranges(hist, [*keys, value]), keys, value, ["_n"])
    picks = []
    for name, p in points.items():
        pos = F.lit(float(p)) * (F.col("_n_all") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        first, last = F.col("_n_before"), F.col("_n_before") + F.col("_n")
        low = F.max(F.when((first <= lo) & (lo < last), F.col(value)))
        high = F.max(F.when((first <= hi) & (hi < last), F.col(value)))
        frac = F.max(pos - lo)
        picks.append((low + (high - low) * frac).cast("double").alias(name))
    return ranked.groupBy(*keys).agg(*picks, *[c.alias(n) for n, c in (extra or {}).items()])
