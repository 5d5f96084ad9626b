"""Stock ledger (L01-L15) without a loop over sales.

For one position with opening stock A and daily net changes x (restocks first, then
requests), partial fills make the stock a walk reflected at zero:

    level_d = A + x_1 + .. + x_d        stock_d = level_d - least(0, min(level_1..level_d))

A return puts back what was allocated to its line, so restocks depend on the walk itself. They
are known without it wherever requests so far do not exceed the opening stock; a position that
has returns beyond that point is folded over such days only, with the days between them
composed into one map each. What comes back never exceeds what went out, so no stock ever
exceeds its opening: in a day, only lines with fewer units than that ahead of them can get anything.

Sale lines are first summed per position and day (partial sums happen before the shuffle),
so a position that holds a third of all lines reaches the window as at most one row per
calendar day. Single lines are then allocated inside their day, from the day's own stock;
a day of very many lines is dealt over parts first.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstar.functions.exprs import date_key, half_up
from shelfstar.star import OPENING, Star, stored

POSITION = ["product_key", "location_key"]
#: The order of lines within a day, and the parts over which the lines of a day are dealt.
LINE_ORDER = ["transaction_id", "line_number", "quantity", "net_cents", "discount_cents", "tax_cents", "is_return"]
PARTS = 256
#: Lines of a position and day that one window takes, and days that are few enough to be broadcast.
ALONE, FEW = 1 << 16, 1 << 16


def opening_positions(star: Star) -> DataFrame:
    """Opening stock of every position that ever trades."""
    return star.lines().select(*POSITION).distinct().withColumn("opening", F.expr(OPENING))


def return_delay(txn: Column, bounds: tuple[int, int]) -> Column:
    lo, hi = bounds
    return (lo + txn % (hi - lo + 1)).cast("int")


def requested_ledger(star: Star) -> DataFrame:
    """L05 short form, per position and day: every return puts back the units requested, whether allocated or not."""
    due = F.date_add("day", return_delay(F.col("transaction_id"), star.config.return_delay_days))
    zero, q = F.lit(0), F.col("quantity")
    sale = F.struct(F.col("day").alias("day"), zero.alias("restock"), q.alias("request"), F.lit(1).alias("attempt"))
    back = F.struct(due.alias("day"), q.alias("restock"), zero.alias("request"), zero.alias("attempt"))
    steps = F.when(F.col("is_return"), F.array(sale, back)).otherwise(F.array(sale))
    return star.lines().select(*POSITION, F.inline(steps)).groupBy(*POSITION, "day").agg(
        F.sum("restock").alias("restock"), F.sum("request").alias("request"), F.sum("attempt").alias("attempts"))


def units_ahead(lines: DataFrame, order: list, quantity: str, limit: Column, counts: DataFrame | None = None) -> DataFrame:
    """Adds ``ahead``: units asked for by earlier lines of the position and day, or null where they reach ``limit``.

    ``counts`` has the ``attempts`` of each position and day, counted here if it is not given. Days of at most ``ALONE`` lines
    are one window each. A larger day is dealt over parts by a hash of the line: a line with ``limit`` units ahead of it in
    its own part is settled there; the others, at most ``limit`` of a part, meet in the window of the day. Lines settled
    before leave the sums of the others as they are, or at ``limit`` or more.
    """
    def before(*keys) -> Column:
        run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(quantity).over(run), F.lit(0))

    day = [*POSITION, "day"]
    counts = lines.groupBy(*day).agg(F.count("*").alias("attempts")) if counts is None else counts
    large = counts.where(F.col("attempts") > ALONE).select(*day)
    n = large.count()
    nearest = F.when(F.col("ahead") < limit, F.col("ahead"))
    if not n:
        return lines.withColumn("ahead", before(*day)).withColumn("ahead", nearest)
    large = F.broadcast(large) if n <= FEW else large
    alone = lines.join(large, day, "left_anti").withColumn("ahead", before(*day))
    part = F.pmod(F.xxhash64(*[c for c in lines.columns if c not in day]), F.lit(PARTS))
    dealt = lines.join(large, day, "left_semi").withColumn("part", part).repartition(*day, "part").withColumn("ahead", before(*day, "part"))
    near = dealt.where(F.col("ahead") < limit).withColumn("ahead", before(*day))
    far = dealt.where(F.col("ahead") >= limit).withColumn("ahead", F.lit(None).cast("long"))
    return alone.unionByName(near.drop("part")).withColumn("ahead", nearest).unionByName(far.drop("part"))


def sale_days(star: Star, *keys: DataFrame) -> DataFrame:
    """Requests per position and day, returned units by delay, and where the returns depend on the walk.

    ``keys`` are tables of product or location keys; only positions found in all of them are computed.

    ``is_short``: the day has returns and requests so far exceed the opening stock. ``is_open``: the position has such a day.
    """
    lo, hi = star.config.return_delay_days
    delay = return_delay(F.col("transaction_id"), (lo, hi))
    back = [F.sum(F.when(F.col("is_return") & (delay == k), F.col("quantity")).otherwise(0)) for k in range(lo, hi + 1)]
    p = Window.partitionBy(*POSITION)
    run = p.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = star.lines()
    for k in keys:
        lines = lines.join(k, k.columns, "left_semi")
    days = lines.groupBy(*POSITION, "day").agg(F.sum("quantity").alias("request"), F.count("*").alias("attempts"),
                                               F.array(*back).alias("back"))
    short = (F.sum("request").over(run) > F.expr(OPENING)) & (F.array_max("back") > 0)
    return days.withColumn("is_short", short).withColumn("is_open", F.max("is_short").over(p))


def stretches(star: Star, days: DataFrame) -> DataFrame:
    """The histories of open positions as few records: a short day each, and the days between them as composed maps.

    A day takes the stock x to max(0, x + restock - request). Such maps compose: days in a row take x to max(floor, x + net), with
    net the sum of their changes and floor = net - the least running sum (at most 0). What a short day's returns give back
    is not known before the walk and falls due up to the longest delay later, so days that near are records of their own; all later
    ones up to the next short day are one. Days that are not short give back all that their returns asked for.

    Columns: position, ``first`` (day), ``is_short``, ``restock`` (known) and ``request`` of a short day, ``net``, ``floor``, and
    ``asked``: a short day's return lines with the units ahead of them; lines with the whole opening stock ahead get nothing.
    """
    lo, hi = star.config.return_delay_days
    zero, none, day = F.lit(0).cast("long"), F.lit(None), [*POSITION, "day"]
    short = days.where("is_short").select(*day, "attempts")
    lines = star.lines().select(*day, *LINE_ORDER).join(short.drop("attempts"), day, "left_semi")
    line = F.struct("ahead", F.col("quantity").cast("long").alias("quantity"), return_delay(F.col("transaction_id"), (lo, hi)).alias("delay"))
    asked = (units_ahead(lines, LINE_ORDER, "quantity", F.expr(OPENING), short).where("is_return and ahead is not null and quantity > 0")
             .select(*day, zero.alias("restock"), zero.alias("request"), F.lit(False).alias("is_short"), line.alias("line")))
    no_line = none.cast(asked.schema["line"].dataType)
    own = F.struct("day", zero.alias("restock"), "request", "is_short")
    backs = [F.struct(F.date_add("day", k).alias("day"), F.col("back")[k - lo].alias("restock"), zero.alias("request"), F.lit(False).alias("is_short"))
             for k in range(lo, hi + 1)]
    full = F.filter(F.array(*backs), lambda x: ~F.col("is_short") & (x["restock"] > 0))
    known = days.where("is_open").select(*POSITION, F.inline(F.concat(F.array(own), full))).withColumn("line", no_line)
    per_day = (known.unionByName(asked).repartition(*POSITION).groupBy(*day)  # at most a few rows per position and day, and the lines asked
               .agg(F.sum("restock").alias("restock"), F.sum("request").alias("request"), F.max("is_short").alias("is_short"), F.collect_list("line").alias("asked")))
    run = Window.partitionBy(*POSITION).orderBy("day")
    last = F.max(F.when(F.col("is_short"), F.col("day"))).over(run.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("is_short") | (F.datediff("day", last) <= hi)  # null before the first short day
    marked = per_day.withColumn("apart", F.coalesce(apart, F.lit(False)))
    begins = F.col("apart") | F.coalesce(F.lag("apart").over(run), F.lit(True))
    rows = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (marked.withColumn("stretch", F.sum(F.when(begins, 1).otherwise(0)).over(rows))
              .withColumn("level", F.sum(F.col("restock") - F.col("request")).over(rows)))
    net = F.sum(F.col("restock") - F.col("request"))
    return marked.groupBy(*POSITION, "stretch").agg(
        F.min("day").alias("first"), F.max("is_short").alias("is_short"), F.sum("restock").alias("restock"), F.sum("request").alias("request"),
        net.alias("net"), (F.max_by("level", "day") - F.min("level")).alias("floor"), F.flatten(F.collect_list("asked")).alias("asked"))


def folded_returns(star: Star, days: DataFrame) -> DataFrame:
    """Restocks of the open positions by their short days, from one fold per position over its ``stretches``."""
    lo, hi = star.config.return_delay_days
    zero = F.lit(0).cast("long")
    record = F.struct("first", "is_short", "restock", "request", "net", "floor", "asked")
    histories = stretches(star, days).groupBy(*POSITION).agg(F.sort_array(F.collect_list(record)).alias("records"))

    def total(steps: Column, units) -> Column:
        return F.coalesce(F.aggregate(steps, zero, lambda a, x: a + units(x)), zero)

    def one(state: Column, r: Column) -> Column:
        start = state["stock"] + total(F.filter(state["due"], lambda x: x["day"] <= r["first"]), lambda x: x["restock"])

        def back(k: int) -> Column:
            units = total(F.filter(r["asked"], lambda x: x["delay"] == k),
                          lambda x: F.least(x["quantity"], F.greatest(zero, start + r["restock"] - x["ahead"])))
            return F.struct(F.date_add(r["first"], k).alias("day"), units.alias("restock"))

        new = F.when(r["is_short"], F.filter(F.array(*[back(k) for k in range(lo, hi + 1)]), lambda x: x["restock"] > 0)).otherwise(none)
        later = F.filter(state["due"], lambda x: x["day"] > r["first"])
        return F.struct(F.greatest(r["floor"], start + r["net"]).alias("stock"), F.concat(later, new).alias("due"), F.concat(state["all"], new).alias("all"))

    none = F.array().cast("array<struct<day:date,restock:bigint>>")
    begin = F.struct(F.expr(OPENING).alias("stock"), none.alias("due"), none.alias("all"))
    back = histories.select(*POSITION, F.inline(F.aggregate("records", begin, one, lambda state: state["all"])))
    full = F.filter(F.array(*[F.struct(F.date_add("day", k).alias("day"), F.col("back")[k - lo].alias("restock")) for k in range(lo, hi + 1)]),
                    lambda x: x["restock"] > 0)
    return back.unionByName(days.where("is_open and not is_short").select(*POSITION, F.inline(full)))


def daily_ledger(star: Star, probes: DataFrame | None = None, keys: Sequence[DataFrame] = ()) -> DataFrame:
    """Restocked and requested units per position and day; a return puts back the units allocated to it.

    ``probes`` are extra (product, location, day) points at which the stock is wanted; they
    join the ledger as days without change, and only their positions are computed. ``keys`` as in ``sale_days``.
    """
    lo, hi = star.config.return_delay_days
    zero = F.lit(0).cast("long")
    wanted = None if probes is None else probes.select(*POSITION, "day").distinct()
    if wanted is None and not keys:
        days = star.cut("sale_days", lambda: sale_days(star))
        returns = star.cut("folded_returns", lambda: folded_returns(star, days))
    else:
        days = sale_days(star, *keys, *([] if wanted is None else [wanted.select(*POSITION).distinct()]))
        returns = folded_returns(star, days)
    request = F.struct("day", zero.alias("restock"), "request", "attempts")
    backs = F.array(*[F.struct(F.date_add("day", k).alias("day"), F.col("back")[k - lo].alias("restock"), zero.alias("request"),
                               zero.alias("attempts")) for k in range(lo, hi + 1)])
    full = F.filter(backs, lambda x: ~F.col("is_open") & (x["restock"] > 0))
    ledger = days.select(*POSITION, F.inline(F.concat(F.array(request), full)))
    none = [zero.alias("request"), zero.alias("attempts")]
    ledger = ledger.unionByName(returns.select(*POSITION, "day", "restock", *none))
    if wanted is not None:
        ledger = ledger.unionByName(wanted.select(*POSITION, "day", zero.alias("restock"), *none))
    # A few rows per position and day are left, so one exchange by position serves the sums and all windows over positions.
    return ledger.repartition(*POSITION).groupBy(*POSITION, "day").agg(
        F.sum("restock").alias("restock"), F.sum("request").alias("request"), F.sum("attempts").alias("attempts"))


def reflected_walk(ledger: DataFrame) -> DataFrame:
    """Start and end stock per position and day, by the closed form above."""
    p = Window.partitionBy(*POSITION)
    run = p.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = (ledger.withColumn("opening", F.expr(OPENING))
         .withColumn("level", F.col("opening") + F.sum(F.col("restock") - F.col("request")).over(run))
         .withColumn("stock_end", F.col("level") - F.least(F.lit(0), F.min("level").over(run)))
         .withColumn("stock_prev", F.coalesce(F.lag("stock_end").over(p.orderBy("day")), F.col("opening")))
         .withColumn("stock_start", F.col("stock_prev") + F.col("restock"))
         .withColumn("next_day", F.lead("day").over(p.orderBy("day")))
         .withColumn("attempts_total", F.sum("attempts").over(p))
         .withColumn("units_total", F.sum("request").over(p))
         .withColumn("selling_days", F.count(F.when(F.col("request") > 0, 1)).over(p)))
    return w.drop("level")


@stored
def stock_walk(star: Star, probes: DataFrame | None = None, keys: Sequence[DataFrame] = ()) -> DataFrame:
    return reflected_walk(daily_ledger(star, probes, keys))


def stock_as_of(star: Star, probes: DataFrame) -> DataFrame:
    """Stock at the end of each probed (product, location, day); unknown positions hold their opening stock."""
    walk = stock_walk(star, probes).select(*POSITION, "day", F.col("stock_end").alias("stock"))
    return probes.join(walk, [*POSITION, "day"])


@stored
def allocations(star: Star) -> DataFrame:
    """Units given to each line, in order of (transaction, line) within its day."""
    days = stock_walk(star).where(F.col("attempts") > 0).select(*POSITION, "day", "stock_start")
    lines = units_ahead(star.lines(), LINE_ORDER, "quantity", F.expr(OPENING), star.cut("sale_days", lambda: sale_days(star)))
    left = F.greatest(F.lit(0).cast("long"), F.col("stock_start") - F.col("ahead"))
    near = lines.where("ahead is not null").join(days, [*POSITION, "day"]).withColumn("stock_before", left).drop("stock_start")
    far = lines.where("ahead is null").withColumn("stock_before", F.lit(0).cast("long"))
    return (near.unionByName(far).withColumn("allocated", F.least(F.col("quantity"), F.col("stock_before")))
            .withColumn("is_constrained", F.col("allocated") < F.col("quantity")).drop("ahead"))


def batch_allocation(requests: DataFrame, stock: DataFrame, seed: int = 42, by_priority: bool = False) -> DataFrame:
    """Competing requests on one start stock, in a repeatable random or priority order.

    ``requests``: product, location, day, request_id, requested[, priority]; ``stock``: the
    start stock per product, location and day.
    """
    m = (F.col("request_id") * 7919 + seed * 104729) % 1000003
    mix = m * m % 1000003  # squaring, or the seed would only shift the order
    order = ([F.col("priority").desc()] if by_priority else []) + [mix, F.col("request_id"), F.col("requested")]
    asked = units_ahead(requests.join(stock, [*POSITION, "day"]), order, "requested", F.col("stock_start"))
    left = F.coalesce(F.greatest(F.lit(0), F.col("stock_start") - F.col("ahead")), F.lit(0))
    return (asked.withColumn("allocated", F.least(F.col("requested"), left))
            .withColumn("is_constrained", F.col("allocated") < F.col("requested")).drop("ahead"))


@stored
def positions(star: Star, *keys: DataFrame) -> DataFrame:
    """One row per position at ``as_of``: stock, supply, reorder fields, replenishment dates (L07, L11); ``keys`` as in ``sale_days``."""
    if star.has("positions"):
        found = star.written("positions")
        for k in keys:
            found = found.join(k, k.columns, "left_semi")
        return found
    d = F.lit(star.as_of)
    seen, stock0 = F.col("day") <= d, F.col("stock_end")
    fell = seen & (F.col("stock_start") > 0) & (stock0 == 0) & (F.col("request") > 0)
    flat = stock_walk(star, keys=keys).groupBy(*POSITION).agg(
        F.max_by("stock_end", F.when(seen, F.col("day"))).alias("stock"),
        F.coalesce(F.sum(F.when(~seen, F.col("restock"))), F.lit(0)).alias("in_transit"),
        F.max(F.when(fell, F.col("day"))).alias("since"),
        F.max(F.when(seen & (F.col("restock") > 0), F.col("day"))).alias("last_restock"),
        F.min(F.when(~seen & (F.col("restock") > 0), F.col("day"))).alias("next_restock"),
        F.max("units_total").alias("units_total"), F.max("selling_days").alias("selling_days"))
    supply = F.expr("stock * selling_days div units_total")
    out = F.col("stock") == 0
    planned = F.date_add(d, (1 + (F.col("product_key") + F.col("location_key")) % 10).cast("int"))
    return flat.select(
        *POSITION, d.alias("day"), date_key(d).alias("date_key"),
        F.col("stock").alias("quantity_on_hand"), F.col("stock").alias("quantity_available"),
        F.lit(0).cast("long").alias("quantity_reserved"), F.lit(0).cast("long").alias("quantity_damaged"),
        F.col("in_transit").alias("quantity_in_transit"), out.alias("is_stockout"),
        F.when(out & F.col("since").isNotNull(), F.datediff(d, "since")).otherwise(F.lit(0)).alias("stockout_days"),
        supply.alias("days_of_supply"),
        F.expr("(stock + in_transit) * selling_days div units_total").alias("stock_cover_days"),
        F.expr("units_total * 2 div selling_days").alias("reorder_point"),
        F.expr("units_total * 5 div selling_days").alias("reorder_quantity"),
        (supply > star.config.overstock_days).alias("is_overstock"),
        F.col("last_restock").alias("last_replenishment_date"),
        F.coalesce(F.col("next_restock"), F.when(out, planned)).alias("next_replenishment_date"),
        "units_total", "selling_days")


@stored
def intervals(star: Star) -> DataFrame:
    """L07 in run-length form: each state of a position with its first and last day, whole history.

    ``since`` is the day on which a sale emptied a position that still has no stock.
    """
    run = Window.partitionBy(*POSITION).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fell = (F.col("stock_start") > 0) & (F.col("stock_end") == 0) & (F.col("request") > 0)
    since = F.when(F.col("stock_end") == 0, F.max(F.when(fell, F.col("day"))).over(run))
    walk = stock_walk(star).withColumn("since", since).where(F.col("day") <= F.lit(star.as_of))
    end = F.coalesce(F.date_sub("next_day", 1), F.lit(star.as_of))
    changed = walk.select(*POSITION, F.col("day").alias("first_day"),
                          F.least(end, F.lit(star.as_of)).alias("last_day"), F.col("stock_end").alias("stock"),
                          "since", "units_total", "selling_days")
    opening = walk.groupBy(*POSITION).agg(
        F.lit(star.first_day).alias("first_day"), F.date_sub(F.min("day"), 1).alias("last_day"),
        F.max("opening").alias("stock"), F.lit(None).cast("date").alias("since"), F.max("units_total").alias("units_total"),
        F.max("selling_days").alias("selling_days")).where(F.col("first_day") <= F.col("last_day"))
    return changed.unionByName(opening)


def snapshot(star: Star, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """L07 in dense form: position x day for a reporting period, by default the whole history."""
    first, last = first or star.first_day, last or star.as_of
    lo, hi = F.greatest("first_day", F.lit(first)), F.least("last_day", F.lit(last))
    held = intervals(star).where((F.col("first_day") <= F.lit(last)) & (F.col("last_day") >= F.lit(first)))
    zero = F.lit(0).cast("long")
    return (held.select(*POSITION, "stock", "since", F.explode(F.sequence(lo, hi)).alias("day"))
            .select(*POSITION, "day", F.col("stock").alias("quantity_on_hand"), F.col("stock").alias("quantity_available"),
                    zero.alias("quantity_reserved"), zero.alias("quantity_damaged"), (F.col("stock") == 0).alias("is_stockout"),
                    F.coalesce(F.datediff("day", "since"), F.lit(0)).alias("stockout_days")))


def location_days(star: Star) -> DataFrame:
    """L07 per location and day over the whole history, from the changes of state and without position x day."""
    def at(day: Column, sign: int) -> Column:
        n = F.lit(sign).cast("long")
        return F.struct(day.alias("day"), n.alias("positions"), (n * F.col("stock")).alias("quantity_on_hand"),
                        F.when(F.col("stock") == 0, n).otherwise(0).alias("stockouts"))

    steps = F.array(at(F.col("first_day"), 1), at(F.date_add("last_day", 1), -1))
    names = ["positions", "quantity_on_hand", "stockouts"]
    per_day = intervals(star).select("location_key", F.inline(steps)).groupBy("location_key", "day").agg(*[F.sum(c).alias(c) for c in names])
    at_location = Window.partitionBy("location_key").orderBy("day")
    run = at_location.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = per_day.select("location_key", "day", F.lead("day").over(at_location).alias("until"), *[F.sum(c).over(run).alias(c) for c in names])
    return levels.where("until is not null and positions > 0").select(
        "location_key", F.explode(F.sequence("day", F.date_sub("until", 1))).alias("day"), *names)


def history_check(star: Star) -> DataFrame:
    """The snapshot over the whole history as a contract: every position has each day once, and never less than no stock."""
    at_position = Window.partitionBy(*POSITION).orderBy("first_day")
    gap = F.datediff("first_day", F.lag("last_day").over(at_position)) - 1
    days = F.datediff("last_day", "first_day") + 1
    s = intervals(star).withColumns({"days": days.cast("long"), "gap": gap})
    none = F.lit(0).cast("long")
    return s.agg(F.coalesce(F.sum("days"), none).alias("position_days"),
                 F.coalesce(F.sum(F.when(F.col("stock") < 0, F.col("days"))), none).alias("negative_days"),
                 F.coalesce(F.sum(F.when(F.col("gap") != 0, F.abs("gap").cast("long"))), none).alias("missing_or_double_days"))


def daily_totals(star: Star) -> DataFrame:
    """Network totals for every day of the history, without building position x day.

    Each ledger row contributes the change it makes to the totals; opening stocks enter on
    the first day; a running sum over the calendar (one row per day) gives the levels.
    """
    over = star.config.overstock_days

    def measures(stock: str, prefix: str) -> list[Column]:
        supply = f"{stock} * selling_days div units_total"
        return [F.expr(stock).alias(f"{prefix}q"), F.expr(f"{stock} * unit_cost_cents").alias(f"{prefix}c"),
                F.expr(f"cast({stock} = 0 as long)").alias(f"{prefix}z"),
                F.expr(f"cast({supply} > {over} as long)").alias(f"{prefix}o"), F.expr(supply).alias(f"{prefix}s")]

    first = F.row_number().over(Window.partitionBy(*POSITION).orderBy("day")) == 1
    walk = (stock_walk(star).withColumn("is_first", first).where(F.col("day") <= F.lit(star.as_of))
            .join(star.product().select("product_key", "unit_cost_cents"), "product_key")
            .select("product_key", "day", "is_first", *measures("stock_end", "n"), *measures("stock_prev", "p")))
    names = ["q", "c", "z", "o", "s"]
    step = F.struct(F.col("day").alias("day"), F.lit(0).alias("pos"),
                    *[(F.col(f"n{c}") - F.col(f"p{c}")).alias(c) for c in names])
    start = F.struct(F.lit(star.first_day).alias("day"), F.lit(1).alias("pos"), *[F.col(f"p{c}").alias(c) for c in names])
    deltas = walk.select(F.inline(F.when(F.col("is_first"), F.array(step, start)).otherwise(F.array(step))))
    days = star.spark.range(1).select(F.explode(F.sequence(F.lit(star.first_day), F.lit(star.as_of))).alias("day"))
    per_day = deltas.groupBy("day").agg(*[F.sum(c).alias(c) for c in ["pos", *names]])
    run = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = {c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(run) for c in ["pos", *names]}
    products = star.lines().agg(F.countDistinct("product_key").alias("product_count"))
    return (days.join(per_day, "day", "left")
            .select("day", total["pos"].alias("positions"), total["q"].alias("quantity_available"),
                    total["c"].alias("cost_cents"), total["z"].alias("stockouts"), total["o"].alias("overstocks"),
                    total["s"].alias("supply_days"))
            .withColumn("product_count", F.lit(products.first()[0])))


def stockout_periods(star: Star) -> DataFrame:
    """From the day a sale empties a position to the next restock (which may still be due)."""
    after = Window.partitionBy(*POSITION).orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    next_restock = F.min(F.when(F.col("restock") > 0, F.col("day"))).over(after)
    return (stock_walk(star).withColumn("end_day", next_restock)
            .where((F.col("stock_start") > 0) & (F.col("stock_end") == 0) & (F.col("request") > 0))
            .select(*POSITION, F.col("day").alias("start_day"), "end_day", "attempts_total", "units_total", "selling_days"))


def zero_days_until(star: Star, probes: DataFrame) -> DataFrame:
    """For (position, day) probes: how many days up to and including that day had no stock.

    States and probes are merged in one window per position (bounded by the calendar); each
    probe reads the running total of the states before it and its share of the current one.
    """
    length = F.when(F.col("stock") == 0, F.datediff("last_day", "first_day") + 1).otherwise(F.lit(0))
    none = F.lit(None)
    extra = [c for c in probes.columns if c not in (*POSITION, "day")]
    states = intervals(star).select(*POSITION, F.col("first_day").alias("day"), F.lit(0).alias("kind"), "first_day",
                                    length.alias("zeros"), *[none.cast(probes.schema[c].dataType).alias(c) for c in extra])
    asked = probes.select(*POSITION, "day", F.lit(1).alias("kind"), none.cast("date").alias("first_day"),
                          none.cast("int").alias("zeros"), *extra)
    w = Window.partitionBy(*POSITION).orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.coalesce(F.sum("zeros").over(w), F.lit(0))
    current = F.coalesce(F.last("zeros", ignorenulls=True).over(w), F.lit(0))
    since = F.last("first_day", ignorenulls=True).over(w)
    partial = F.when(current > 0, F.datediff("day", since) + 1).otherwise(F.lit(0))
    return (states.unionByName(asked).withColumn("zero_days", total - current + partial)
            .where("kind = 1").select(*POSITION, "day", *extra, "zero_days"))


def average_daily_sales(star: Star) -> DataFrame:
    """Lines and units per selling day of a position."""
    daily = star.lines().groupBy(*POSITION, "day").agg(F.count("*").alias("n"), F.sum("quantity").alias("q"))
    return daily.groupBy(*POSITION).agg(F.sum("n").alias("attempts_total"), F.sum("q").alias("units_total"),
                                        F.count("*").alias("selling_days"))


def touches_months(start: Column, end: Column, months: tuple[int, ...]) -> Column:
    """Does [start, end] contain a day of one of these months (month arithmetic, no join)?"""
    span = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    hit = F.lit(False)
    for m in months:
        hit = hit | ((F.lit(m) - F.month(start) + 12) % 12 <= span)
    return hit


@stored
def stockout_events(star: Star) -> DataFrame:
    """Closed periods with the sales they lost; half as much again in peak months."""
    from shelfstar.config import PEAK_STOCKOUT_MONTHS
    closed = stockout_periods(star).where(F.col("end_day") <= F.lit(star.as_of))
    days = F.datediff("end_day", "start_day") + 1
    e = (closed.join(star.product().select("product_key", "price_cents"), "product_key", "left")
         .withColumn("days", days)
         .withColumn("peak", touches_months(F.col("start_day"), F.col("end_day"), PEAK_STOCKOUT_MONTHS))
         .withColumn("a", F.expr("attempts_total * days div selling_days"))
         .withColumn("u", F.expr("units_total * days div selling_days"))
         .withColumn("c", F.col("u") * F.coalesce("price_cents", F.lit(int(star.config.default_price * 100)))))

    def boosted(x: str) -> Column:
        return F.when(F.col("peak"), F.expr(f"{x} * 3 div 2")).otherwise(F.col(x))

    return e.select(*POSITION, F.col("start_day").alias("day"), "end_day",
                    date_key(F.col("start_day")).alias("start_date_key"), date_key(F.col("end_day")).alias("end_date_key"),
                    F.col("days").alias("duration_days"), F.col("peak").alias("peak_season_flag"),
                    boosted("a").alias("lost_attempts"), boosted("u").alias("lost_units"), boosted("c").alias("lost_cents"))


@stored
def movements(star: Star, since: dt.date | None = None) -> DataFrame:
    """Typed stock movements: sales, returns, the transfers that restock them, counts, receipts.

    With ``since`` the scan is bounded by that day less the longest delay of a return. Receipts are all of the first
    day, so they are left out where ``since`` lies behind it.
    """
    unit = F.expr("cost_cents div quantity")
    loc, none, txn = F.col("location_key"), F.lit(None).cast("long"), F.col("transaction_id")
    due = F.date_add("day", return_delay(txn, star.config.return_delay_days))

    def step(kind: str, src: Column, dst: Column, day: Column, qty: Column) -> Column:
        return F.struct(F.lit(kind).alias("movement_type"), src.alias("from_location_key"), dst.alias("to_location_key"),
                        day.alias("day"), qty.cast("long").alias("quantity"))

    steps = F.array(
        step("sale", loc, none, F.col("day"), F.col("quantity")),
        F.when(F.col("is_return"), step("return", none, loc, F.col("day"), F.col("quantity"))),
        F.when(F.col("is_return"), step("transfer", 10 + F.col("product_key") % 2, loc, due, F.col("quantity"))),
        F.when(txn % 50 == 0, step("adjustment", loc, loc, F.col("day"), F.lit(1))))
    if since is not None and star.has("movements"):
        return star.written("movements").where(F.col("day") >= F.lit(since))
    lines = star.lines(None if since is None else since - dt.timedelta(days=star.config.return_delay_days[1]))
    moved = lines.select("product_key", unit.alias("unit_cents"), "transaction_id", F.inline(F.filter(steps, lambda s: s.isNotNull())))
    if since is not None:
        moved = moved.where(F.col("day") >= F.lit(since))
        if since > star.first_day:
            return _described(moved)
    first = star.lines().groupBy(*POSITION).agg(F.min(unit).alias("unit_cents"), F.min(txn).alias("transaction_id"))
    receipts = first.select("product_key", "unit_cents", "transaction_id", F.lit("receipt").alias("movement_type"),
                            none.alias("from_location_key"), loc.alias("to_location_key"),
                            F.lit(star.first_day).alias("day"), F.expr(OPENING).alias("quantity"))
    return _described(moved.unionByName(receipts))


def _described(moved: DataFrame) -> DataFrame:
    txn = F.col("transaction_id")
    return (moved.withColumn("total_cents", F.col("unit_cents") * F.col("quantity"))
            .withColumn("movement_reason", F.concat("movement_type", F.lit("_reason_"), (txn % 5 + 1).cast("string")))
            .withColumn("reference_type", F.when(F.col("movement_type") == "sale", "order")
                        .when(F.col("movement_type") == "transfer", "transfer").otherwise("adjustment")))


def allocation_statistics(alloc: DataFrame) -> DataFrame:
    """Totals, and shares of constrained lines (filled in part) and failed ones (not filled)."""
    n = F.count("*")
    part = (F.col("allocated") > 0) & (F.col("allocated") < F.col("quantity"))
    bad, failed = F.sum(part.cast("long")), F.sum((F.col("allocated") == 0).cast("long"))
    return alloc.agg(n.alias("total_allocations"), bad.alias("constrained_allocations"), failed.alias("failed_allocations"),
                     half_up(bad * 100.0 / F.nullif(n, F.lit(0)), 2).alias("constrained_pct"),
                     half_up(failed * 100.0 / F.nullif(n, F.lit(0)), 2).alias("failed_pct"),
                     F.sum("quantity").alias("units_requested"), F.sum("allocated").alias("units_allocated"))
