"""Three streaming jobs: event layers (Z01), running stock (Z02) and vector-table sync.

Each ``start`` takes a source, a sink and a checkpoint folder and returns the running query.
``trigger`` is ``{"availableNow": True}`` for triggered runs or ``{"processingTime": ".."}``
for continuous ones; the same code serves both.
"""

from __future__ import annotations

import datetime as dt
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from shelfstar.config import Config
from shelfstar.operators.ledger import return_delay
from shelfstar.star import OPENING

ONCE = {"availableNow": True}


# -- Z01: bronze -> silver -> gold ------------------------------------------------------------

def read_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Raw files as a stream; the schema is that of the files, read once."""
    files = spark.read.parquet(path)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", max_files)
    folder, name = path.rstrip("/").rsplit("/", 1)
    if not all(f.rstrip("/").endswith("/" + name) for f in files.inputFiles()):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", name).parquet(folder)  # a single file: the source watches its folder


def typed(bronze: DataFrame) -> DataFrame:
    """Raw events with their types, and the day they belong to."""
    return bronze.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("customer_key"), "event_type",
                         F.floor(F.col("value") * 100).alias("event_cents"),
                         F.regexp_extract("props", "([0-9]+)", 1).try_cast("long").alias("product_key"),
                         F.to_date("ts").alias("day"))


class EventLayers:
    """Silver (events without duplicates), gold (hourly counts and value by type) and rejected rows (without id or time).

    Each layer is the sink of a stream of its own, and each batch reads only its own rows. An event that is sent again within
    ``remember`` of its first arrival is dropped by the state store, which keeps ids that long. The watermark is that of
    arrival, so an event may be as old as it likes: no row is late, and open hours show what has come so far. Gold is a
    running aggregation whose state has one row per hour and type.
    """

    def __init__(self, spark: SparkSession, path: str, remember: str = "30 days"):
        self.spark, self.path, self.remember = spark, path, remember
        self.silver, self.gold, self.rejected = f"{path}/silver", f"{path}/gold", f"{path}/rejected"

    def start_rejected(self, events: DataFrame, trigger: dict = ONCE) -> StreamingQuery:
        return self._sink(typed(events).where("event_id is null or ts is null"), self.rejected, "rejected", trigger)

    def start_silver(self, events: DataFrame, trigger: dict = ONCE) -> StreamingQuery:
        seen = typed(events).where("event_id is not null and ts is not null").withColumn("seen_at", F.current_timestamp())
        once = seen.withWatermark("seen_at", self.remember).dropDuplicatesWithinWatermark(["event_id"]).drop("seen_at")
        return self._sink(once, self.silver, "silver", trigger, "day")

    def start_gold(self, trigger: dict = ONCE) -> StreamingQuery:
        silver = self.spark.readStream.schema(self.spark.read.parquet(self.silver).schema).parquet(self.silver)
        hours = silver.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(
            F.count("*").alias("events"), F.sum("event_cents").alias("event_cents"))

        def put(all_hours: DataFrame, batch: int) -> None:  # one row per hour and type; a repeated batch overwrites itself
            all_hours.withColumn("day", F.to_date("hour")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.gold)

        return hours.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{self.path}/state/gold").trigger(**trigger).start()

    def _sink(self, rows: DataFrame, path: str, name: str, trigger: dict, *by: str) -> StreamingQuery:
        out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{self.path}/state/{name}")
        return (out.partitionBy(*by) if by else out).trigger(**trigger).start()

    def catch_up(self, events: DataFrame) -> None:
        """Bring all layers up to date with what has come."""
        both = [self.start_rejected(events), self.start_silver(events)]
        for q in both:
            q.awaitTermination()
        self.start_gold().awaitTermination()

    def hours(self) -> DataFrame:
        return self.spark.read.parquet(self.gold).select("hour", "event_type", "events", "event_cents")


# -- Z02: running stock position ----------------------------------------------------------------

REQUEST = ("at timestamp, product_key long, location_key long, opening long, day int, transaction_id long, line_number int, quantity long, net_cents long, "
           "discount_cents long, tax_cents long, is_return boolean, delay int")
MOVES = ("kind string, product_key long, location_key long, day date, transaction_id long, line_number int, requested long, allocated long, "
         "stock_before long, stock_after long")
DAY_MS = 86_400_000

#: Positions are dealt over so many shards, each one key of the state; fixed for a checkpoint.
SHARDS = 1024
#: Requests, positions and due returns are kept as records of fixed size, so that a call to the state store moves many of them.
ASKED = np.dtype([("product_key", "i8"), ("location_key", "i8"), ("opening", "i8"), ("day", "i4"), ("transaction_id", "i8"), ("line_number", "i4"),
                  ("quantity", "i8"), ("net_cents", "i8"), ("discount_cents", "i8"), ("tax_cents", "i8"), ("is_return", "i1"), ("delay", "i4"), ("nulls", "u2")])
HELD = np.dtype([("product_key", "i8"), ("location_key", "i8"), ("stock", "i8"), ("settled", "i4")])
DUE = np.dtype([("product_key", "i8"), ("location_key", "i8"), ("day", "i4"), ("units", "i8")])
MOVED = np.dtype([("kind", "i1"), ("product_key", "i8"), ("location_key", "i8"), ("day", "i4"), ("transaction_id", "i8"), ("line_number", "i4"), ("requested", "i8"),
                  ("allocated", "i8"), ("stock_before", "i8"), ("stock_after", "i8"), ("nulls", "u2")])
KINDS = ["late", "restock", "sale"]
#: A null of a request is the largest value, so that it sorts last; ``nulls`` has a bit for each column that is null.
ASKED_COLUMNS = ASKED.names[:-1]
NULL_BIT = {c: 1 << i for i, c in enumerate(ASKED_COLUMNS)}
NULL_MOVE = {c: 1 << i for i, c in enumerate(MOVED.names)}
IN_DAY = ["transaction_id", "line_number", "quantity", "net_cents", "discount_cents", "tax_cents", "is_return"]
#: Requests that are packed together, rows that become Python values at a time, and days outside the calendar.
PACK, BLOCK = 1 << 17, 1 << 14
NO_DAY, NEVER = -(1 << 31), (1 << 31) - 1


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests as records, those of a shard together in one row."""
    def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        shard, asked = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(shard, kind="stable")
        keys, first = np.unique(shard[order], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([_kept(x) for x in np.split(asked[order], first[1:])], pa.binary())],
                                          ["shard", "requests"])

    parts, n = [], 0
    for batch in batches:
        asked = np.zeros(batch.num_rows, ASKED)
        for c in ASKED_COLUMNS:
            col = batch.column(batch.schema.get_field_index(c))
            col = col.cast(pa.int8()) if pa.types.is_boolean(col.type) else col
            if col.null_count:
                asked["nulls"] |= np.where(col.is_null().to_numpy(zero_copy_only=False), NULL_BIT[c], 0).astype("u2")
                col = col.fill_null(int(np.iinfo(ASKED[c]).max))
            asked[c] = col.to_numpy(zero_copy_only=False)
        if len(asked):
            parts.append((batch.column(batch.schema.get_field_index("shard")).to_numpy(zero_copy_only=False), asked))
            n += len(asked)
        if n >= PACK:
            yield rows(parts)
            parts, n = [], 0
    if parts:
        yield rows(parts)


def _kept(rows: np.ndarray) -> bytes:
    """Records for the exchange and the store: equal bytes of all records side by side, compressed."""
    return zlib.compress(np.frombuffer(rows.tobytes(), "u1").reshape(-1, rows.itemsize).T.tobytes(), 1) if len(rows) else b""


def _records(blobs: Iterable[bytes], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(np.frombuffer(zlib.decompress(b), "u1").reshape(kind.itemsize, -1).T.tobytes() for b in blobs if b), kind)


def _position(rows: np.ndarray) -> np.ndarray:
    """Position of each record as 16 bytes that compare in the order of the unsigned keys."""
    both = np.empty(len(rows), [("product_key", ">i8"), ("location_key", ">i8")])
    both["product_key"], both["location_key"] = rows["product_key"], rows["location_key"]
    return both.view("S16")


def _find(among: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key lies among sorted ones, and whether it is there."""
    at = np.searchsorted(among, wanted)
    return at, (among[np.minimum(at, len(among) - 1)] == wanted) if len(among) else np.zeros(len(wanted), bool)


def _moves(kind: str, rows: np.ndarray, **values: np.ndarray | None) -> Iterator[pd.DataFrame]:
    """Moves of requests or due returns as records, some thousands in one row; values that are None are null."""
    for a in range(0, len(rows), BLOCK):
        part = rows[a:a + BLOCK]
        moved = np.zeros(len(part), MOVED)
        moved["kind"] = KINDS.index(kind)
        for c in ("product_key", "location_key", "day", "transaction_id", "line_number"):
            if c in part.dtype.names:
                moved[c] = part[c]
        for c in ("transaction_id", "line_number", "requested", "allocated", "stock_before", "stock_after"):
            if values.get(c) is not None:
                moved[c] = values[c][a:a + BLOCK]
            elif c not in part.dtype.names:
                moved["nulls"] |= NULL_MOVE[c]
        if "nulls" in part.dtype.names and part["nulls"].any():
            for c in ("product_key", "location_key", "day", "transaction_id", "line_number", "quantity"):
                moved["nulls"] |= np.where(part["nulls"] & NULL_BIT[c] != 0, NULL_MOVE["requested" if c == "quantity" else c], 0).astype("u2")
        yield pd.DataFrame({"moves": [moved.tobytes()]})


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of ``MOVES`` from records."""
    def rows(blobs: list[bytes]) -> pa.RecordBatch:
        moved = np.frombuffer(b"".join(blobs), MOVED)
        null = {c: moved["nulls"] & NULL_MOVE[c] != 0 for c in MOVED.names[1:-1]}
        kinds = pa.DictionaryArray.from_arrays(pa.array(moved["kind"]), KINDS).cast(pa.string())
        days = pa.array(moved["day"], mask=null["day"]).cast(pa.date32())
        return pa.RecordBatch.from_arrays([kinds, *(days if c == "day" else pa.array(np.ascontiguousarray(moved[c]), mask=null[c]) for c in MOVED.names[1:-1])], list(MOVED.names[:-1]))

    for batch in batches:
        blobs, n = [], 0
        for blob in batch.column(0):
            blobs.append(blob.as_py())
            n += len(blobs[-1]) // MOVED.itemsize
            if n >= BLOCK:
                yield rows(blobs)
                blobs, n = [], 0
        if blobs:
            yield rows(blobs)


class RunningStock(StatefulProcessor):
    """Stock of the positions of one shard from requests in any order of arrival.

    Requests wait in state until the watermark has passed their day. Then a timer settles the days that are over: returned units that
    are due come back first (kind ``restock``), then a day's requests are filled in their fixed order (``sale``); a return of a line
    restocks what was allocated to it, after its delay. A request for a day that is already settled for its position, or without a day, a whole
    position or its opening stock, changes nothing and is passed on as ``late``. So the result does not depend on how the rows were cut into micro-batches.

    ``days``: the earliest day that waits or falls due, which has a timer, the latest day settled for any position, and the chunks that wait.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.days = handle.getValueState("days", "pending int, settled int, chunks int")
        self.waiting = handle.getMapState("waiting", "chunk int", "requests binary")
        self.held = handle.getValueState("held", "positions binary, due binary")

    def _state(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions settled before, in order, and their due returns."""
        positions, due = self.held.get() or (b"", b"")
        return _records([positions], HELD), _records([due], DUE)

    def _wait(self, asked: np.ndarray, chunks: int) -> int:
        """Adds requests as chunks of some thousands, so that no value of the store grows with its shard."""
        for a in range(0, len(asked), BLOCK):
            self.waiting.updateValue((chunks,), (_kept(asked[a:a + BLOCK]),))
            chunks += 1
        return chunks

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waits_for, settled, chunks = self.days.get() or (NEVER, NO_DAY, 0)
        pending, held = waits_for, None
        for frame in rows:
            asked = _records(frame["requests"], ASKED)
            late = asked["nulls"] & (NULL_BIT["product_key"] | NULL_BIT["location_key"] | NULL_BIT["opening"] | NULL_BIT["day"]) != 0
            if (asked["day"] <= settled).any():
                held = self._state()[0] if held is None else held
                at, found = _find(_position(held), _position(asked))
                late[found] |= asked["day"][found] <= held["settled"][at[found]]
            if late.any():
                yield from _moves("late", asked[late], requested=asked["quantity"][late])
                asked = asked[~late]
            if len(asked):
                chunks = self._wait(asked, chunks)
                pending = min(pending, int(asked["day"].min()))
        if pending < waits_for:
            self.handle.registerTimer((pending + 1) * DAY_MS)
        self.days.update((pending, settled, chunks))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = timerValues.getCurrentWatermarkInMs() // DAY_MS - 1  # the latest day that is over
        pending, settled, _ = self.days.get()
        if pending > last:
            return
        waiting = _records((r[0] for r in self.waiting.values()), ASKED)
        over = waiting["day"] <= last
        later, asked = waiting[~over], waiting[over]
        del waiting
        asked = asked[np.lexsort([asked[c] for c in (*reversed(IN_DAY), "day")] + [asked[c].view("u8") for c in ("location_key", "product_key")])]
        held, due = self._state()
        of_asked, of_due = _position(asked), _position(due)
        touched = np.unique(np.concatenate([of_asked, of_due[due["day"] <= last]]))
        at, found = _find(_position(held), touched)
        first, end = np.searchsorted(of_asked, touched), np.searchsorted(of_asked, touched, "right")
        stock = np.empty(len(touched), "i8")
        stock[found], stock[~found] = held["stock"][at[found]], asked["opening"][first[~found]]
        owed: dict[int, dict[int, int]] = {}
        theirs = np.isin(of_due, touched)
        for i, day, units in zip(np.searchsorted(touched, of_due[theirs]).tolist(), due["day"][theirs].tolist(), due["units"][theirs].tolist()):
            owed.setdefault(i, {})[day] = units
        due, backs, before, allocated = due[~theirs], [], array("q"), array("q")
        steps, ends = _steps(asked), array("q")
        for i, (has, n) in enumerate(zip(stock.tolist(), (end - first).tolist())):
            mine = owed.pop(i, {})
            for day, quantity, is_return, delay in islice(steps, n):
                while mine and (back := min(mine)) <= day:
                    backs.append((i, back, has, has + mine[back]))
                    has += mine.pop(back)
                take = quantity if quantity < has else has
                before.append(has)
                allocated.append(take)
                has -= take
                if is_return == 1 and take and delay < NEVER:
                    mine[day + delay] = mine.get(day + delay, 0) + take
            while mine and (back := min(mine)) <= last:
                backs.append((i, back, has, has + mine[back]))
                has += mine.pop(back)
            ends.append(has)
            if mine:
                owed[i] = mine
        before, allocated = np.frombuffer(before, "i8"), np.frombuffer(allocated, "i8")
        yield from _moves("sale", asked, requested=asked["quantity"], allocated=allocated, stock_before=before, stock_after=before - allocated)
        keys = np.empty(len(touched), HELD)
        if len(touched):
            both = touched.view([("product_key", ">i8"), ("location_key", ">i8")])
            keys["product_key"], keys["location_key"] = both["product_key"], both["location_key"]
        keys["stock"], keys["settled"] = np.frombuffer(ends, "i8"), last
        if backs := [x for x in backs if x[2] != x[3]]:
            i, day, had, has = (np.array(x) for x in zip(*backs))
            back = np.zeros(len(i), DUE)
            back["product_key"], back["location_key"], back["day"] = keys["product_key"][i], keys["location_key"][i], day
            yield from _moves("restock", back, stock_before=had, stock_after=has)
        new = np.array([(keys["product_key"][i], keys["location_key"][i], day, units) for i, x in owed.items() for day, units in x.items()], DUE)
        due, held = np.concatenate([due, new]), held.copy()
        held[at[found]] = keys[found]
        self.held.update((_kept(np.insert(held, at[~found], keys[~found])), _kept(due)))
        self.waiting.clear()
        chunks = self._wait(later, 0)
        pending = min([NEVER, *([int(later["day"].min())] if len(later) else []), *([int(due["day"].min())] if len(due) else [])])
        if pending < NEVER:
            self.handle.registerTimer((pending + 1) * DAY_MS)
        self.days.update((pending, max(settled, last), chunks))

    def close(self) -> None:
        pass


def _steps(asked: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Day, quantity, return flag and delay of each request."""
    for a in range(0, len(asked), BLOCK):
        yield from zip(*(asked[c][a:a + BLOCK].tolist() for c in ("day", "quantity", "is_return", "delay")))


def requests_from_lines(lines: DataFrame, config: Config | None = None) -> DataFrame:
    """Sale lines (batch or stream) as stock requests, with the delay after which a returned line comes back."""
    delay = return_delay(F.col("transaction_id"), (config or Config()).return_delay_days)
    made = lines.withColumns({"delay": delay, "opening": F.expr(OPENING), "day": F.unix_date("day")})
    made = made.withColumn("at", F.timestamp_seconds(F.col("day").cast("long") * 86_400))
    return made.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in T._parse_datatype_string(REQUEST).fields])


class Clock:
    """A folder of ticks that is read beside the requests: a tick moves the watermark on when no requests come."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], "at timestamp").write.mode("append").parquet(path)

    def tick(self, day: dt.date) -> None:
        at = F.lit(day.isoformat()).cast("timestamp")
        self.spark.range(1).select(at.alias("at")).write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema("at timestamp").parquet(self.path)


def start_stock(requests: DataFrame, sink: str, checkpoint: str, trigger: dict = ONCE, late_days: int = 7, clock: Clock | None = None,
                shards: int = SHARDS) -> StreamingQuery:
    """Append what happens to each position to a parquet table, partitioned by kind; state lives in RocksDB.

    A request may come up to ``late_days`` after the latest day seen so far; later ones are of kind ``late``. A shard's positions are read and
    written together: raise ``shards`` beyond some 100 million positions. A checkpoint keeps the number it was begun with.
    """
    if clock is not None:
        requests = requests.unionByName(clock.stream(), allowMissingColumns=True)
    # The condition names the event time, or it would be pushed below the watermark and ticks would not count.
    timed = requests.withWatermark("at", f"{late_days} days").where("at is null or product_key is not null or location_key is not null")
    shard = F.pmod(F.xxhash64("product_key", "location_key"), F.lit(shards)).cast("int").alias("shard")
    packed = timed.select(shard, *ASKED_COLUMNS).mapInArrow(pack, "shard int, requests binary")  # without its event time no row is dropped as late
    moves = (packed.groupBy("shard").transformWithStateInPandas(RunningStock(), "moves binary", "append", "EventTime")
             .mapInArrow(unpack, MOVES))
    out = moves.writeStream.format("parquet").outputMode("append").partitionBy("kind").option("path", sink).option("checkpointLocation", checkpoint)
    return _with_rocksdb(requests.sparkSession, out.trigger(**trigger).start)


#: Settings of a query with state in RocksDB; a fetch of state is one message, so it takes few chunks of records.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.execution.arrow.transformWithStateInPySpark.maxStateRecordsPerBatch": "64"}


def _with_rocksdb(spark: SparkSession, start) -> StreamingQuery:
    """Start a query whose state needs RocksDB; a query keeps the settings it was started with, and the caller's stay as they were."""
    old = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        return start()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# -- Z03: incremental sync of changed rows --------------------------------------------------------

class SyncedTable:
    """Keyed table kept by change batches.

    Rows live in hash buckets. A batch rewrites only the buckets it touches, into a folder of its own
    batch id, so a repeated batch overwrites itself and readers never see half a batch: of each bucket
    the newest folder counts. Keys deleted by a batch stay in its folder as marked rows, so that a bucket
    that has become empty still has a newest folder.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, version: str, buckets: int = 16):
        self.spark, self.path, self.key, self.version, self.buckets = spark, path, key, version, buckets

    def _bucket(self):
        return F.pmod(F.col(self.key), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None) -> DataFrame | None:
        """Current rows; the newest folder per bucket is found from the folder names alone."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(conf)
        if not files.exists(root):
            return None
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(self.path + "/batch=*/bucket=*"))
        newest: dict[int, tuple[int, str]] = {}
        for f in found:
            p = f.getPath()
            batch, bucket = int(p.getParent().getName().split("=")[1]), int(p.getName().split("=")[1])
            done = files.exists(jvm.org.apache.hadoop.fs.Path(p.getParent(), "_SUCCESS"))
            if done and (before is None or batch < before) and batch >= newest.get(bucket, (-1, ""))[0]:
                newest[bucket] = (batch, p.toString())
        if not newest:
            return None
        return self.spark.read.parquet(*[p for _, p in newest.values()]).where(~F.col("_gone")).drop("_gone")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Upsert inserts and updates, drop deletes; the newest version of a key wins, of equal versions the largest row."""
        rest = [c for c in changes.columns if c != self.key]
        latest = changes.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(self.version, F.struct(*rest))).alias("r")).select(self.key, "r.*")
        old = self.read(before=batch)
        live = latest.withColumn("_gone", F.col("change_type") == "delete").drop("change_type")
        if old is not None:
            touched = [r[0] for r in latest.select(self._bucket()).distinct().collect()]  # at most one per bucket
            kept = old.where(self._bucket().isin(touched)).join(latest.select(self.key), self.key, "left_anti")
            live = kept.withColumn("_gone", F.lit(False)).unionByName(live)
        (live.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.path}/batch={batch}"))


def start_sync(feed: DataFrame, table: SyncedTable, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Keep ``table`` equal to its source from a feed of (key, columns, change_type, version)."""
    return (feed.writeStream.foreachBatch(lambda df, batch: table.apply(df, batch)).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())
