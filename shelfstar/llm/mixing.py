"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is wanted f = target / source size times. The whole part of f is taken as it is; the
fraction is rounded in pairs: of two documents, words move at random from one to the other, keeping their
sum and each one's expectation, until one of the two fractions is 0 or 1. What is left of a block of
documents is one undecided document, and these are paired again up a reduction tree, until a source has at
most one, which is rounded by itself. A source's taken words are thus its target, give or take one document.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstar.llm.common import WORD, cut, fresh

#: Documents in a leaf, and undecided documents that one node of the tree gets.
LEAF, FAN = 8192, 64


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: list[float], limit: float) -> DataFrame:
    """Targets of sources (source, source_size): shares by weight of the total, at most ``limit`` times the size.

    Sources by code point, null last, weigh ``weights`` in turn. What a source cannot take is shared again
    by weight until no source is above its limit; only sums travel to the driver, a few per round.
    """
    ordered = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
                  .withColumn("part", F.spark_partition_id().cast("long")).withColumn("at", F.monotonically_increasing_id()), "sources")
    before = {}  # a number per partition, not per source
    seen = 0
    for r in ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").collect():
        before[r["part"]] = r["first"] - seen
        seen += r["n"]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")) if before else F.lit(0)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ordered.withColumn("rank", F.col("at") - start).withColumn("weight", F.get(turn, (F.col("rank") % len(weights)).cast("int")))
    cap = F.col("source_size") * F.lit(float(limit))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, F.lit(False)
    while True:
        left = ranked.agg(F.sum(F.when(full, cap)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        new = (total - (left["taken"] or 0.0)) / left["weight"] if left["weight"] else None
        if new is None or new == level:
            break
        level = new
        full = F.col("weight") * F.lit(level) >= cap
    share = F.least(cap, F.col("weight") * F.lit(level)) if level is not None else cap
    return ranked.select("source", "source_size", "rank", share.cast("double").alias("target"))


def _chance(*key) -> float:
    return xxhash.xxh64_intdigest("\n".join(map(str, key)).encode()) / 2.0**64


def pivot(p: np.ndarray, size: np.ndarray, chances: np.ndarray) -> int:
    """Round ``p`` in place in the order given; returns the place of the one that stays undecided, or -1."""
    open_at = -1
    for i in range(len(p)):
        if p[i] <= 0.0 or p[i] >= 1.0:
            continue
        if open_at < 0:
            open_at = i
            continue
        j, si, sj = open_at, float(size[i]), float(size[open_at])
        a, b = p[i] * si, p[j] * sj
        up_j, up_i = min((1 - p[j]) * sj, a), min(b, (1 - p[i]) * si)
        if chances[i] * (up_i + up_j) < up_i:  # words go to j with probability up_i / (up_i + up_j)
            whole_i = a <= (1 - p[j]) * sj
            p[i], p[j] = (0.0, min(1.0, (b + a) / sj)) if whole_i else ((a - (1 - p[j]) * sj) / si, 1.0)
        else:
            whole_j = b <= (1 - p[i]) * si
            p[i], p[j] = (min(1.0, (a + b) / si), 0.0) if whole_j else (1.0, (b - (1 - p[i]) * si) / sj)
        left = [k for k in (i, j) if 1e-12 < p[k] < 1 - 1e-12]
        for k in (i, j):
            if k not in left:
                p[k] = round(p[k])
        open_at = left[0] if left else -1
    return open_at


_NODE = "rank long, node long, doc_id string, n long, copy long, size long, p double, won long, open boolean"


def _round(level: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A node: rows are documents (``n`` equal ones in a row of a leaf), one at most leaves it undecided."""
        pdf = pdf.loc[pdf.index.repeat(pdf["n"])].reset_index(drop=True)
        pdf["copy"] = pdf.groupby(["doc_id", "size"], dropna=False).cumcount() + pdf["copy"]
        key = [(_chance(seed, d, s, c), str(d), s, c) for d, s, c in zip(pdf["doc_id"], pdf["size"], pdf["copy"])]
        pdf = pdf.loc[sorted(range(len(pdf)), key=key.__getitem__)].reset_index(drop=True)
        p = pdf["p"].to_numpy(np.float64, copy=True)
        chances = np.array([_chance(seed, level, d, s, c) for d, s, c in zip(pdf["doc_id"], pdf["size"], pdf["copy"])])
        left = pivot(p, pdf["size"].to_numpy(), chances)
        pdf["p"], pdf["n"], pdf["open"] = p, 1, False
        pdf["won"] = (p >= 1.0).astype("int64")
        if left >= 0:
            pdf.loc[left, ["open", "won"]] = [True, 0]
        return pdf[["rank", "node", "doc_id", "n", "copy", "size", "p", "won", "open"]]

    return run


def decide(docs: DataFrame, weights: list[float], limit: float = 3.0, seed: int = 0) -> DataFrame:
    """How often each kind of document is taken, from rows (doc_id, source, size).

    One row per distinct (doc_id, source, size): ``n`` (rows of that kind), ``base`` (copies that each of
    them gives), ``won`` (how many of them give one more), source_size and target. Chances come from a hash
    of the document and ``seed``, so reruns agree whatever the partitioning; kinds are dealt to leaves by
    that hash, so a source of any size is spread. Rows that repeat in full meet in one leaf. Documents
    without words are never taken.
    """
    kinds = docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    kinds = cut(kinds, "kinds")
    sums = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    sums = cut(sums, "sums")
    goal = cut(targets(sums.select("source", "source_size"), weights, limit)
               .join(sums.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    f = F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))
    wanted = F.when(F.col("size") > 0, F.coalesce(f, F.lit(0.0))).otherwise(0.0)
    named = goal.withColumnRenamed("source", "s")
    each = (kinds.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("base", F.floor(wanted).cast("long")).withColumn("p", wanted - F.floor(wanted)))
    each = cut(each, "wanted")
    leaves = F.ceil(F.col("rows") / LEAF).cast("long")
    level, now, done = 0, None, []
    now = each.where("p > 0").select(
        "rank", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), leaves).alias("node"), F.col("doc_id").cast("string").alias("doc_id"),
        "n", F.lit(0).cast("long").alias("copy"), "size", "p", F.lit(0).cast("long").alias("won"), F.lit(False).alias("open"))
    while True:
        out = cut(now.groupBy("rank", "node").applyInPandas(_round(level, seed), _NODE), f"level{level}")
        done.append(out.where("not open"))
        last = out.agg(F.coalesce(F.max("node"), F.lit(0)).alias("node")).first()["node"] == 0
        now = out.where("open").withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        if last:
            break
        level += 1
    alone = F.udf(lambda d, s, c, p: int(_chance(seed, "last", d, s, c) < p), "long")
    done.append(now.withColumn("won", alone("doc_id", "size", "copy", "p")))
    won = reduce(DataFrame.unionByName, done).groupBy("rank", F.col("doc_id").alias("d"), F.col("size").alias("z")).agg(F.sum("won").alias("won"))
    won = won.withColumnRenamed("rank", "r")
    return each.join(won, (F.col("rank") == F.col("r")) & F.col("doc_id").cast("string").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z")), "left").select(
        "doc_id", "source", "size", "source_size", "target", "n", "base", F.coalesce("won", F.lit(0).cast("long")).alias("won"))


def plan(docs: DataFrame, weights: list[float], limit: float = 3.0, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, ``copies`` and ``taken`` (words)."""
    kinds = decide(docs.select("doc_id", "source", words(F.col("text")).alias("size")), weights, limit, seed)
    each = kinds.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    copies = F.col("base") + F.when(F.col("i") <= F.col("won"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: list[float], limit: float = 3.0, seed: int = 0) -> DataFrame:
    """The mixed rows, with the columns of ``docs``: each document as often as it is taken.

    Rows that share doc_id, source and size are told apart only by a number in their group, which only
    such rows are shuffled for.
    """
    names = docs.columns
    size = fresh(docs, "size_of_text")
    kinds = decide(docs.select("doc_id", "source", words(F.col("text")).alias("size")), weights, limit, seed)
    kinds = kinds.select(F.struct("doc_id", "source", "size").alias("kind"), F.struct("n", "base", "won").alias("got"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), words(F.col("text")).alias(size))
    on = (F.col("row.doc_id").eqNullSafe(F.col("kind.doc_id")) & F.col("row.source").eqNullSafe(F.col("kind.source"))
          & (F.col(size) == F.col("kind.size")))
    both = left.join(kinds, on)
    one = both.where("got.n = 1").withColumn("i", F.lit(1))
    many = both.where("got.n > 1").withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("row"))))
    copies = (F.col("got.base") + F.when(F.col("i") <= F.col("got.won"), 1).otherwise(0)).cast("int")
    return (one.unionByName(many).withColumn("again", F.explode(F.array_repeat(F.lit(1), copies)))
            .select(*[F.col("row")[c].alias(c) for c in names]))
