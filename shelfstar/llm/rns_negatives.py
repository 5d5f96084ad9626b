"""Hard negatives by exact integer inner products in a residue number system.

Integer vectors are reduced modulo several small primes. Modulo each prime a matrix product fits float32 exactly:
residues lie in [-(p - 1) / 2, (p - 1) / 2], and the components are added in runs so short that every partial sum stays
under 2^24. The residues of a score give the exact signed score by Chinese remaindering (mixed radix), as the
product of the primes exceeds twice the largest possible score. Windows then select positives and negatives.

Anchors and candidates are dealt into blocks by hashes of whole rows; each pair of an anchor block and a candidate block is one
group, which returns a bounded number of rows per anchor. There are two passes: the positives, whose scores bound the
negatives, then the negatives.

Rules: a row without id, label or vector, or with a null or non-finite component takes no part. Shorter vectors count as padded
with zeros. Rows equal in id, label and vector are one row; other rows of one id are rows of their own, and a row never
meets rows of its own id. Possible scores of 2^51 or more raise ValueError. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstar.llm.common import cut

#: Exact integers of float32, and the longest run of components that is added before reduction.
EXACT, RUN = 1 << 24, 64
ROW = "id long, label int, vector array<double>"


@dataclass(frozen=True)
class Params:
    """``low`` and ``high``: per cent of a positive's score between which its negatives' scores lie, both included;
    ``anchor_block`` and ``candidate_block``: expected rows of a block; ``tile``: anchors that are scored at once."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    anchor_block: int = 2048
    candidate_block: int = 8192
    tile: int = 128


def primes_for(bound: int, dims: int) -> list[int]:
    """Distinct primes with a product over 2 * bound, the largest whose partial sums of up to RUN products are exact in float32."""
    half = math.isqrt((EXACT - 1) // max(1, min(dims, RUN)))
    p, out = 2 * half + 1, []
    while math.prod(out) <= 2 * bound:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
        p -= 2
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Centred residues of integer-valued doubles."""
    r = np.fmod(x, p)
    r -= p * (r > p // 2)
    r += p * (r < -(p // 2))
    return r.astype(np.float32)


def product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, in 0 .. p - 1, from float32 products of runs of components."""
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], RUN):
        out += (a[:, at:at + RUN] @ b[:, at:at + RUN].T).astype(np.int64)
        out %= p
    return out


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed numbers from their residues: mixed radix digits one prime after the other."""
    value, weight = parts[0].copy(), primes[0]
    for r, p in zip(parts[1:], primes[1:]):
        digit = (r - value) % p * pow(weight, -1, p) % p
        value += weight * digit
        weight *= p
    return np.where(value > weight // 2, value - weight, value)


class Scorer:
    """Exact inner products with a block of vectors, whose residues are kept."""

    def __init__(self, x: np.ndarray, primes: list[int]):
        self.primes, self.parts = primes, [residues(x, p) for p in primes]

    def scores(self, a: np.ndarray) -> np.ndarray:
        return reconstruct([product(residues(a, p), b, p) for b, p in zip(self.parts, self.primes)], self.primes)


def matrix(col: pa.ChunkedArray, dims: int) -> np.ndarray:
    col = col.combine_chunks()
    lengths = col.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(col), dims))
    out[np.arange(dims) < lengths[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, the largest first and ties by place."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.argsort(-scores[near], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def _tiles(anchors: pa.Table, rows: pa.Table, primes: list[int], dims: int, tile: int):
    """(table of some anchors, their scores, ids, labels) with the rows in order of id."""
    rows = rows.sort_by("id")
    ids, labels = _columns(rows, "id", "label")
    scorer = Scorer(matrix(rows.column("vector"), dims), primes)
    for at in range(0, anchors.num_rows, tile):
        some = anchors.slice(at, tile)
        yield some, scorer.scores(matrix(some.column("vector"), dims)), ids, labels


def _positives(primes: list[int], dims: int, params: Params):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for some, scores, ids, labels in _tiles(anchors, rows, primes, dims, params.tile) if anchors.num_rows and rows.num_rows else ():
            for key, own, label, s in zip(some.column("anchor").to_pylist(), *_columns(some, "id", "label"), scores):
                at = np.flatnonzero((labels == label) & (ids != own))
                at = at[first(s[at], params.positives)]
                out += [(key, i, x) for i, x in zip(ids[at].tolist(), s[at].tolist())]
        keys, found, values = zip(*out) if out else ((), (), ())
        return pa.table({"anchor": pa.array(keys, pa.string()), "positive_id": pa.array(found, pa.int64()), "positive_score": pa.array(values, pa.int64())})

    return run


def _negatives(primes: list[int], dims: int, params: Params):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for some, scores, ids, labels in _tiles(anchors, rows, primes, dims, params.tile) if anchors.num_rows and rows.num_rows else ():
            given = some.column("positives").to_pylist()
            for key, own, label, s, positives in zip(some.column("anchor").to_pylist(), *_columns(some, "id", "label"), scores, given):
                other = np.flatnonzero((labels != label) & (ids != own))
                x = 100 * s[other]
                for p in positives:
                    at = other[(params.low * p["positive_score"] <= x) & (x <= params.high * p["positive_score"])]
                    at = at[first(s[at], params.negatives)]
                    out += [(key, p["number"], i, v) for i, v in zip(ids[at].tolist(), s[at].tolist())]
        keys, number, found, values = zip(*out) if out else ((), (), (), ())
        return pa.table({"anchor": pa.array(keys, pa.string()), "number": pa.array(number, pa.int32()), "negative_id": pa.array(found, pa.int64()),
                         "negative_score": pa.array(values, pa.int64())})

    return run


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a double, exact where scale is a power of two; from 2^52 on a double is an integer."""
    def whole(x: Column) -> Column:
        return F.when(F.abs(x) >= float(1 << 52), x).otherwise(F.floor(x).cast("double"))

    return F.transform(vector, lambda x: whole(x.cast("double") * scale))


def usable(id: Column, label: Column, vector: Column) -> Column:
    """Rows that take part: with id, label and a vector of finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return id.isNotNull() & label.isNotNull() & vector.isNotNull() & ~odd


def _paired(left: DataFrame, right: DataFrame, params: Params, sizes: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into blocks, each block once for every block of the other side."""
    anchors, rows = [max(1, -(-n // size)) for n, size in zip(sizes, (params.anchor_block, params.candidate_block))]
    def every(n: int, name: str) -> Column:
        return F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias(name)

    return (left.select("*", F.pmod(F.xxhash64("anchor"), F.lit(anchors)).alias("a"), every(rows, "b")),
            right.select("*", every(anchors, "a"), F.pmod(F.xxhash64("id", "label", "vector"), F.lit(rows)).alias("b")))


def mine(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """Hard negatives for ``rows`` (id: long, label: int, vector: array of integer-valued doubles, is_anchor: boolean).

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose scores lie between ``low`` and
    ``high`` per cent of the positive's. Larger scores come first, ties by smaller id.
    """
    rows = cut(rows.where(usable(F.col("id"), F.col("label"), F.col("vector"))).groupBy(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"),
               F.col("vector").cast("array<double>").alias("vector")).agg(F.max(F.coalesce("is_anchor", F.lit(False))).alias("is_anchor")), "rows")
    square = F.aggregate("vector", F.lit(0.0), lambda n, x: n + x * x)
    seen = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("is_anchor"), 1)).alias("anchors"), F.max(square).alias("square"), F.max(F.size("vector")).alias("dims")).first()
    bound, dims = (seen["square"] or 0.0) * 1.001 + 1, seen["dims"] or 0
    if not bound < 1 << 51:  # or the product of the primes might not fit into a long
        raise ValueError(f"scores up to {bound:.3g} are too large")
    primes, sizes = primes_for(int(bound), dims), (seen["anchors"], seen["n"])
    candidates = rows.select("id", "label", "vector")
    key = F.concat_ws("/", "id", "label", F.hex(F.xxhash64("vector")), F.hex(F.xxhash64(F.lit("second"), F.col("vector"))))
    anchors = cut(rows.where("is_anchor").select(key.alias("anchor"), "id", "label", "vector"), "anchors")
    near, far = _paired(anchors, candidates, params, sizes)
    found = near.groupBy("a", "b").cogroup(far.groupBy("a", "b")).applyInArrow(
        _positives(primes, dims, params), "anchor string, positive_id long, positive_score long")
    best = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), F.col("positive_id"))
    found = found.withColumn("number", F.row_number().over(best)).where(F.col("number") <= params.positives)
    found = cut(found, "positives")
    given = found.groupBy(F.col("anchor").alias("of")).agg(F.sort_array(F.collect_list(F.struct("number", "positive_id", "positive_score"))).alias("positives"))
    near, far = _paired(anchors.join(given, F.col("anchor") == F.col("of")).drop("of"), candidates, params, sizes)
    hard = near.groupBy("a", "b").cogroup(far.groupBy("a", "b")).applyInArrow(
        _negatives(primes, dims, params), "anchor string, number int, negative_id long, negative_score long")
    best = Window.partitionBy("anchor", "number").orderBy(F.col("negative_score").desc(), F.col("negative_id"))
    hard = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= params.negatives)
    return (hard.join(found, ["anchor", "number"])
            .select(F.split("anchor", "/")[0].cast("long").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
