"""Quality rules as a ledger: every rule is evaluated once, policies and ablations only read its bits.

``ledger`` adds the measurements of each text and one long with a bit for every rule that the text fails.
A policy is a named version with the rules that it enforces; applying one, or asking what each of its
rules does, is bitwise arithmetic on the ledger and never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfstar.llm.common import SPACE, fresh

SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
WINDOW = 5
_CONTINUED = bytes(range(0x80, 0xC0))

#: The rules in the order of their bits: name, and the condition (on the measurements) under which a text fails.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


#: Versions are only ever added.
POLICIES = {p.version: p for p in (
    Policy("base", ("few_words", "repeated_words")),
    Policy("v1", ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines")),
)}


def repeat_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in a window of k words found twice or more in ``words``."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for j in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    order = np.argsort(mixed, kind="stable")
    same = np.diff(mixed[order]) == 0
    if not same.any():
        return 0
    found: dict[tuple, list[int]] = {}  # equal hashes are only a hint
    for i in order[np.r_[same, False] | np.r_[False, same]].tolist():
        found.setdefault(tuple(words[i:i + k]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    starts = [i for at in found.values() if len(at) > 1 for i in at]
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.array(starts, np.int64) + k, -1)
    return int((edge.cumsum() > 0).sum())


def measure(data: bytes | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES; null counts as empty."""
    data = data or b""
    words = data.split()
    inked = data.translate(None, SPACE)
    lines, repeated, seen = 0, 0, set()
    for line in data.split(b"\n"):
        if line.strip(SPACE):
            lines += 1
            repeated += line in seen
            seen.add(line)
    return (len(words), len(inked.translate(None, _CONTINUED)), len(data) - len(data.translate(None, SYMBOLS)),
            lines, repeated, repeat_words(words))


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measures(text: pa.Array) -> pa.Array:
    rows = np.array([measure(x.as_py()) for x in text], np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(MEASURES))], MEASURES)


_measures = _measures.asNondeterministic()  # evaluated once, not again in every filter on it


def failures(measured: str) -> Column:
    """The bits of the rules that fail, from a struct column of measurements."""
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        for m in MEASURES:
            fails = fails.replace(m, f"`{measured}`.{m}")
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with a struct of measurements and a long of failed rules; returns the names of both columns.

    Every row stays, with all its columns; the new names avoid those that are there. Null and empty texts
    measure 0 and fail ``few_words``.
    """
    m = fresh(docs, "measured")
    out = docs.withColumn(m, _measures(F.col(f"`{text}`").cast("binary")))
    b = fresh(out, "failed_rules")
    return out.withColumn(b, failures(m)), m, b


def kept(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``."""
    out, _, b = ledger(docs, text)
    return out.where(kept(F.col(b), policy)).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablation(marked: DataFrame, bits: str, policy: Policy, by: list[str] | None = None) -> DataFrame:
    """What each rule of a policy does: rows failing it, and rows that only it rejects.

    One row per rule and group, from one pass over the ledger's bits: rows are first counted per pattern of
    failed rules (at most 2^rules of them), so a group of any size is summed on the map side.
    """
    by = by or []
    hit = F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long"))
    patterns = marked.groupBy(*by, hit.alias("hit")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]))
    each = patterns.select(*by, "hit", "n", rules.alias("r")).select(*by, "hit", "n", "r.rule", "r.bit")
    return each.groupBy(*by, "rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("hit") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.bit_or(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("hit")).otherwise(0)).alias("seen_with"))
