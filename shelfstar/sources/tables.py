"""Table sources, sinks and upkeep."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Which tables are built from which (dependents are dropped first).
DEPENDS_ON = {
    "sales_fact": ["customer_dim", "product_dim", "location_dim", "channel_dim", "date_dim"],
    "inventory_fact": ["product_dim", "location_dim", "date_dim", "sales_fact"],
    "event_fact": ["customer_dim", "product_dim", "channel_dim", "date_dim"],
    "cart_abandonment_fact": ["customer_dim", "channel_dim", "event_fact", "inventory_fact"],
    "demand_forecast_fact": ["product_dim", "location_dim", "sales_fact"],
    "stockout_events": ["product_dim", "location_dim", "inventory_fact", "sales_fact"],
    "affinity_agg": ["sales_fact", "event_fact"],
    "size_fit_bridge": ["customer_dim", "product_dim", "sales_fact"],
    "inventory_movement_fact": ["product_dim", "location_dim", "sales_fact"],
    "customer_dim": [], "product_dim": [], "location_dim": [], "date_dim": [], "time_dim": [], "channel_dim": [],
}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return shared or tempfile.mkdtemp(prefix="run-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables and stream state."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder, which survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again: later readers take only the columns they need, and know its size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, path: str, cols: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Scan with the filter and the projection inside the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*cols) if cols else df


def write(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """One distributed write."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Files dealt by a hash of ``keys``, one per bucket, each in their order. Tables with equal keys and buckets join, and group or
    window by the keys, without an exchange. The table is written whole, so that each bucket stays one sorted file; its layout is kept
    in the files' own schema, so any session can read it."""
    name = f"write_{uuid.uuid4().hex}"
    layout = {"buckets": buckets, "bucket_keys": keys}
    noted = df.withMetadata(keys[0], {**dict(df.schema[keys[0]].metadata), **layout})
    (noted.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name))
    df.sparkSession.sql(f"drop table {name}")     # the name alone: the files lie outside the warehouse
    try:
        df.sparkSession.read.parquet(path)
    except AnalysisException as e:                # no row, no bucket, no file: an empty file holds the schema
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        create(df.sparkSession, [], df.schema).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A written table; one with buckets is named in the session's catalogue, so that plans know its layout."""
    df = spark.read.parquet(path)
    layout = next((f.metadata for f in df.schema.fields if "buckets" in f.metadata), None)
    if layout is None:
        return df
    name = "bucketed_" + hashlib.md5(path.encode()).hexdigest()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    keys, where = ", ".join(layout["bucket_keys"]), path.replace("'", "\\'")
    spark.sql(f"drop table if exists {name}")
    spark.sql(f"create table {name} ({columns}) using parquet options (path '{where}') "
              f"clustered by ({keys}) sorted by ({keys}) into {layout['buckets']} buckets")
    return spark.table(name)


def create(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """Typed table from (possibly no) rows."""
    return spark.createDataFrame(rows, schema)


def append_merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append with schema merge; columns missing on one side become null."""
    return old.unionByName(new, allowMissingColumns=True)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Read parquet files of different schema versions as one table."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def backup(spark: SparkSession, names: list[str], suffix: str) -> list[str]:
    """Copy named tables."""
    done = []
    for name in names:
        if spark.catalog.tableExists(name):
            spark.table(name).write.mode("overwrite").saveAsTable(f"{name}{suffix}")
            done.append(f"{name}{suffix}")
    return done


def drop_order(names: list[str], depends_on: dict[str, list[str]] | None = None) -> list[str]:
    """Names ordered so that dependents come before what they are built from."""
    graph, out = depends_on or DEPENDS_ON, []

    def visit(name: str) -> None:
        if name in out:
            return
        for other, needs in graph.items():
            if name in needs and other in names:
                visit(other)
        out.append(name)

    for n in names:
        visit(n)
    return out


def drop_tables(spark: SparkSession, names: list[str], depends_on: dict[str, list[str]] | None = None) -> list[str]:
    order = [n for n in drop_order(names, depends_on) if spark.catalog.tableExists(n)]
    for name in order:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return order


def table_report(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows, bytes, files and last change per table, from file metadata columns."""
    parts = [spark.read.parquet(p).select(
        F.lit(n).alias("table_name"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"),
        F.col("_metadata.file_modification_time").alias("m")).groupBy("table_name", "f", "b", "m").agg(
            F.count("*").alias("r")) for n, p in paths.items()]
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    return files.groupBy("table_name").agg(F.sum("r").alias("row_count"), F.sum("b").alias("total_bytes"),
                                           F.count("*").alias("file_count"), F.max("m").alias("last_modified"))


def load_summary(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Record count and last load time per table, as one union."""
    out = None
    for name, (df, ts) in tables.items():
        one = df.agg(F.count("*").alias("record_count"), F.max(ts).cast("timestamp").alias("last_loaded")).select(
            F.lit(name).alias("table_name"), "record_count", "last_loaded")
        out = one if out is None else out.unionByName(one)
    return out


class StageLog:
    """Append-only log of pipeline stages; a resumed run skips stages that are done."""

    SCHEMA = "stage string, status string, message string, at timestamp, number long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def mark(self, stage: str, status: str, message: str = "") -> None:
        row = self.spark.range(1).select(F.lit(stage).alias("stage"), F.lit(status).alias("status"),
                                         F.lit(message).alias("message"), F.current_timestamp().alias("at"),
                                         F.lit(self._rows().count()).cast("long").alias("number"))
        row.write.mode("append").parquet(self.path)

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def latest(self) -> DataFrame:
        """The last entry of each stage by its number in the log; clocks may be equal or askew."""
        log, order = self._rows(), F.struct("number", "at")
        return log.groupBy("stage").agg(F.max_by("status", order).alias("status"), F.max_by("message", order).alias("message"),
                                        F.max("at").alias("at"))

    def run(self, stage: str, fn, resume: bool = True):
        if resume and not self.latest().where((F.col("stage") == stage) & (F.col("status") == "done")).isEmpty():
            return None
        self.mark(stage, "started")
        try:
            out = fn()
        except Exception as e:
            self.mark(stage, "failed", str(e))
            raise
        self.mark(stage, "done")
        return out


def clustered(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows laid out by ``keys``, so row-group statistics can skip data."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def optimize(spark: SparkSession, df: DataFrame, table: str, keys: list[str]) -> None:
    """Write a clustered table and collect its statistics."""
    clustered(df, keys).write.mode("overwrite").saveAsTable(table)
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Change feed between two versions of a table: insert, update, delete."""
    rest = [c for c in old.columns if c not in key]

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(*rest).alias(name))

    both = packed(old, "_old").join(packed(new, "_new"), key, "full")
    kind = (F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete")
            .when(~F.col("_old").eqNullSafe(F.col("_new")), "update"))
    row = F.coalesce("_new", "_old")
    return (both.withColumn("change_type", kind).where(F.col("change_type").isNotNull())
            .select(*key, "change_type", *[row[c].alias(c) for c in rest]))


def parts_changed(old: DataFrame, new: DataFrame, part: Column | None = None, key: list[str] | None = None, parts: int = 4096) -> DataFrame:
    """Parts of a table whose rows differ between two versions: one aggregate a side, one row per part.

    ``part`` is the part of a row, such as the month of its date; by default rows are dealt over ``parts`` by their key.
    A part is its row count and the sums of two independent 64-bit hashes over all columns and their nulls, so repeated
    rows count and order does not. Rows without a part form one.
    """
    columns = list(old.columns)
    part = F.pmod(F.xxhash64(*key), F.lit(parts)) if part is None else part

    def summary(df: DataFrame, suffix: str) -> DataFrame:
        nulls = [F.col(c).isNull() for c in columns]
        one = F.xxhash64(*columns, *nulls)
        two = F.xxhash64(F.lit(1), *nulls, *reversed(columns))
        return df.groupBy(part.alias("_part")).agg(F.struct(
            F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("a"), F.sum(two.cast("decimal(38,0)")).alias("b")).alias(f"_{suffix}"))

    a, b = summary(old, "old"), summary(new, "new").withColumnRenamed("_part", "_new_part")
    both = a.join(b, F.col("_part").eqNullSafe(F.col("_new_part")), "full")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(
        F.when(F.col("_old").isNull(), F.col("_new_part")).otherwise(F.col("_part")).alias("part"))


def change_feed(old: DataFrame, new: DataFrame, key: list[str], part: Column | None = None, parts: int = 4096) -> DataFrame:
    """T11 over large tables: ``snapshot_diff`` of the parts that differ, the others are compared by their sums alone.

    A part must follow from the key, or rows that move between parts would be seen as deleted and inserted. Only
    changed rows leave the map side for the join by key. The list of changed parts has at most ``parts`` rows, or one
    per value of ``part``; it is broadcast where Spark finds it small, and an empty list ends both scans.
    """
    changed = parts_changed(old, new, part, key, parts)
    of = F.pmod(F.xxhash64(*key), F.lit(parts)) if part is None else part

    def touched(df: DataFrame) -> DataFrame:
        return df.withColumn("_part", of).join(changed, F.col("_part").eqNullSafe(F.col("part")), "left_semi").drop("_part")

    return snapshot_diff(touched(old), touched(new), key)


def check_counts(counts: DataFrame, expected: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Actual against expected (table_name, expected_count) row counts; both have one row per table."""
    actual, exp = F.coalesce("record_count", F.lit(0)), F.col("expected_count")
    status = (F.when(actual == 0, "EMPTY").when(actual < exp * (1 - tolerance), "LOW")
              .when(actual > exp * (1 + tolerance), "HIGH").otherwise("OK"))
    return expected.join(counts.select("table_name", "record_count"), "table_name", "left").select(
        "table_name", "expected_count", actual.alias("record_count"), status.alias("status"))


def describe(df: DataFrame, table_comment: str, comments: dict[str, str]) -> DataFrame:
    """Column comments carried in the schema (and kept by writes)."""
    out = df
    for name, text in comments.items():
        out = out.withMetadata(name, {**dict(df.schema[name].metadata), "comment": text})
    out = out.withMetadata(df.columns[0], {**dict(out.schema[df.columns[0]].metadata), "table_comment": table_comment})
    return out


def comment_report(spark: SparkSession, df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("comment")) for f in df.schema.fields]
    return spark.createDataFrame(rows, "column_name string, data_type string, comment string")
