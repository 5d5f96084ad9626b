"""Helpers shared by the operators: reading tables, cutting lineage, free column names, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstar.sources.tables import reliable_checkpoint, scratch

#: The characters between words, and the pattern of a word.
SPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again, so that it is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name close to ``name`` that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def digest(text: Column) -> list[Column]:
    """128 bits that stand for a text, as two longs."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, root) per node, root its smallest node.

    Each round maps every node to its smallest neighbour, follows that map once more and contracts the
    graph, so the number of rounds is logarithmic in practice. Loops and repeated edges do no harm; an
    empty table gives an empty result. Each round ends in a reliable checkpoint.
    """
    edges = reliable_checkpoint(edges.select("a", "b"))
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = reliable_checkpoint(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    now = reliable_checkpoint(both.where("a <> b").distinct())
    while not now.isEmpty():
        up = now.groupBy("a").agg(F.min("b").alias("up")).select(F.col("a").alias("x"), F.least("a", "up").alias("up"))
        up = reliable_checkpoint(up)
        top = up.select(F.col("x").alias("y"), F.col("up").alias("top"))
        up = reliable_checkpoint(up.join(top, F.col("up") == F.col("y")).select("x", F.col("top").alias("to")))
        labels = reliable_checkpoint(labels.join(up, F.col("root") == F.col("x"), "left")
                                     .select("node", F.coalesce("to", "root").alias("root")))
        a, b = up.select(F.col("x").alias("a"), F.col("to").alias("ta")), up.select(F.col("x").alias("b"), F.col("to").alias("tb"))
        now = reliable_checkpoint(now.join(a, "a").join(b, "b").where("ta <> tb")
                                  .select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())
    smallest = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(smallest, "root").select("node", F.col("least").alias("root"))
