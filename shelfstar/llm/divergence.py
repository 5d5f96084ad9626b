"""Audit of how far the sources of a language differ in their words, in exact integer arithmetic.

Terms are runs of letters (``TERM``), lower-cased for A-Z only. Each language keeps the terms found in at least
``min_docs`` of its documents. Every (lang, source) group and every language gives each kept term a share
p = 1 + floor(SCALE * (count + prior) / (N + prior * V)) with N its occurrences of kept terms and V their number.

Count-cell ranking: p depends on a term only through its count, so terms are grouped by their pair of counts and
f = abs(p - q) is evaluated once per cell. For the terms of a group a cell is (group count, language count): equal
values of f are merged, ranked by cumulative multiplicity, and only the cells that reach the wanted ranks are expanded
into terms, in UTF-8 order. For two sources a cell is the pair of their counts; cells with a zero follow from
each source's own cells, so only terms that both sources have are ever paired.

Null text, language or source counts as empty; every row is a document of its own, so repeated rows count each
time. Groups without terms take part, with zero counts; a language without kept terms has distances of 0 and
no ranked terms. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstar.llm.common import cut

#: Runs of letters: A-Z, a-z and everything outside ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text to bytes of its terms, lower-cased for A-Z, with spaces between them; bytes of other characters stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct terms that a task counts before it passes them on, and rows passed on at once.
HELD, ROWS = 1 << 19, 1 << 16
GROUP = ["lang", "source"]


@dataclass(frozen=True)
class Params:
    """``min_docs``: documents of a language that must have a term; ``prior`` is added to every count; ``top``: ranks of terms."""

    min_docs: int = 30
    prior: int = 5
    scale: int = 1_000_000_000
    top: int = 50


def _count(batches):
    """Counts of a task's texts, passed on whenever it holds HELD terms; later steps add them up."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def rows():
        for (lang, source), found in n.items():
            terms, counts, seen = list(found), np.fromiter(found.values(), np.int64, len(found)), docs[lang, source]
            for at in range(0, len(terms), ROWS):
                some = terms[at:at + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()),
                                                  pa.array(counts[at:at + ROWS]), pa.array([seen[t] for t in some], pa.int64())], ["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()

    held = 0
    for b in batches:
        for text, *group in zip(b.column("text"), *(b.column(c).to_pylist() for c in GROUP)):
            words = text.as_py().translate(_TERMS).split()
            mine = n.setdefault(tuple(group), Counter())
            held -= len(mine)
            mine.update(words)
            held += len(mine)
            docs.setdefault(tuple(group), Counter()).update(set(words))
            if held >= HELD:
                yield from rows()
                held = 0
    yield from rows()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and the group's documents that have it."""
    names = [F.coalesce(c, F.lit("")).alias(c) for c in GROUP]
    found = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), *names).mapInArrow(
        _count, "lang string, source string, term binary, n long, docs long")
    return found.groupBy(*GROUP, F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column | int, total: Column, terms: Column, params: Params) -> Column:
    """p of a count; decimals hold the product, so no count is too large."""
    over = F.lit(params.scale).cast("decimal(12,0)") * (F.lit(count) + params.prior).cast("decimal(19,0)")
    return 1 + F.call_function("div", over, (total + params.prior * terms).cast("decimal(19,0)"))


def kept_terms(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(lang, source, term, n, all): the kept terms of each group that has them, with their count in the language."""
    counts = cut(counted(docs), "counts")
    total = (counts.groupBy(F.col("lang").alias("l"), F.col("term").alias("t")).agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"))
             .where(F.col("docs") >= params.min_docs).drop("docs"))
    return counts.drop("docs").join(total, (F.col("lang") == F.col("l")) & (F.col("term") == F.col("t"))).drop("l", "t")


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms) of every group that occurs."""
    own = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang", "term").agg(F.max("all").alias("all")).groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count("*").alias("terms"))
    zero = F.lit(0).cast("long")
    return (docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in GROUP]).distinct()
            .join(own, GROUP, "left").join(of_lang, "lang", "left")
            .select(*GROUP, *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "terms")]))


def ranked_terms(kept: DataFrame, known: DataFrame, params: Params = Params()) -> DataFrame:
    """(lang, source, item, value, rank): per group the terms it has more of than its language, largest excess first."""
    p = share(F.col("n"), F.col("total"), F.col("terms"), params)
    q = share(F.col("all"), F.col("lang_total"), F.col("terms"), params)
    cells = kept.groupBy(*GROUP, "n", "all").agg(F.count("*").alias("many")).join(known, GROUP)
    cells = cut(cells.withColumn("value", p - q).where("value > 0").select(*GROUP, "n", "all", "many", "value"), "cells")
    by_value = Window.partitionBy(*GROUP).orderBy(F.col("value").desc())
    merged = (cells.groupBy(*GROUP, "value").agg(F.sum("many").alias("many"))
              .withColumn("number", F.row_number().over(by_value)).where(F.col("number") <= params.top)
              .withColumn("before", F.coalesce(F.sum("many").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .where(F.col("before") < params.top).select(*GROUP, "value"))
    wanted = cells.join(merged, [*GROUP, "value"]).select(*GROUP, "n", "all", "value")
    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("term"))
    return (kept.join(wanted, [*GROUP, "n", "all"]).select(*GROUP, F.col("term").alias("item"), "value", F.row_number().over(order).alias("rank"))
            .where(F.col("rank") <= params.top))


def distances(kept: DataFrame, known: DataFrame, params: Params = Params()) -> DataFrame:
    """(lang, source, item, value, rank): per group the other sources of its language, the most distant first.

    The sum over all kept terms of abs(p - q) is V * abs(p0 - q0), for counts of zero on both sides, plus what the
    terms of one side change against the other's zero, plus a correction for the terms that both have.
    """
    mine, other = [known.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "total")], *extra) for s, extra in (("a", ["terms"]), ("b", []))]
    pairs = mine.join(other, "lang").where("source_a <> source_b")
    one = kept.groupBy(*GROUP, "n").agg(F.count("*").alias("many"))
    x = kept.select("lang", "term", F.col("source").alias("source_a"), F.col("n").alias("n_a"))
    y = kept.select("lang", "term", F.col("source").alias("source_b"), F.col("n").alias("n_b"))
    two = (x.join(y, ["lang", "term"]).where("source_a < source_b")
           .groupBy("lang", "source_a", "source_b", "n_a", "n_b").agg(F.count("*").alias("many")))

    def p(count: Column | int, side: str) -> Column:
        return share(count, F.col(f"total_{side}"), F.col("terms"), params)

    none = F.abs(p(0, "a") - p(0, "b"))
    a_only, b_only = F.abs(p(F.col("n_a"), "a") - p(0, "b")), F.abs(p(0, "a") - p(F.col("n_b"), "b"))
    both = F.abs(p(F.col("n_a"), "a") - p(F.col("n_b"), "b"))
    key = ["lang", F.least("source_a", "source_b").alias("low"), F.greatest("source_a", "source_b").alias("high")]
    base = pairs.where("source_a < source_b").select(*key, F.when(F.col("terms") > 0, F.col("terms") * none).otherwise(0).alias("value"))
    single = (one.select("lang", F.col("source").alias("source_a"), F.col("n").alias("n_a"), "many").join(pairs, ["lang", "source_a"])
              .select(*key, (F.col("many") * (a_only - none)).alias("value")))
    double = (two.join(pairs, ["lang", "source_a", "source_b"])
              .select(*key, (F.col("many") * (both - a_only - b_only + none)).alias("value")))
    summed = base.unionByName(single).unionByName(double).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item")))
    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item"))
    return summed.select("lang", F.inline(ways), "value").withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` with text, lang and source; part is ``pair`` or ``term``."""
    docs = docs.select("text", *GROUP)
    kept = cut(kept_terms(docs, params), "kept")
    known = cut(groups(docs, kept), "groups")
    parts = [distances(kept, known, params).withColumn("part", F.lit("pair")), ranked_terms(kept, known, params).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select(*GROUP, "part", "item", "value", "rank")
