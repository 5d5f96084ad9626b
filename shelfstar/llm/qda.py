"""Document quality by a regularised quadratic discriminant over transformed statistics of whole texts.

Every text becomes a short vector: logarithms of lengths and of smoothed rates (``FEATURES``). Each class is a Gaussian
whose covariance is shrunk twice: towards the pooled covariance by a fixed share, then towards a sphere by the oracle
approximating estimate (which needs the covariance and the number of rows only). A model holds, per class, the mean and the
inverse of the Cholesky factor, computed once. The log-density difference of two Mahalanobis forms, put through a
logistic curve fitted on rows that the densities had not seen, is the score.

Fitting is two aggregations over all labelled rows: sums of features and of their products per class and fold, and a
histogram of differences; the driver sees only those. Labels, ids, languages and sources are never features.

Null texts count as empty; an empty text has a vector like any other. Labels other than 0 and 1 are ignored, and an id
with both teaches nothing. Rows that repeat are scored each, and each learned from. Without labels every score is 0.5, with
one class only it is that class. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfstar.llm.common import cut
from shelfstar.llm.quality_rules import repeat_words

FEATURES = ["words", "word_length", "symbols", "marks", "upper", "digits", "bars", "same_as_before", "distinct", "windows", "lines", "repeated_lines", "capitals", "stops"]
#: Byte classes.
_SYMBOLS, _MARKS = list(b"#*$%&<>@^~=+{}[]\\"), list(b"!?;:\"")


#: Features are kept in units of 2^-12, so that sums of them and of their products are exact whatever the order of rows.
UNIT = 1 << 12


@dataclass(frozen=True)
class Params:
    """``pooled``: share of the pooled covariance in each class's; ``least``: variance added to every feature, in units of its own;
    ``width`` and ``widest``: bins of the histogram of log-density differences, and where it is cut off."""

    pooled: float = 0.05
    least: float = 1e-4
    width: float = 0.25
    widest: float = 60.0


def rate(part: float, whole: float, typical: float) -> float:
    """Logarithm of a rate, smoothed by one occurrence at the ``typical`` rate, so that short texts look typical."""
    return log((part + 1.0) / (whole + 1.0 / typical))


def features(data: bytes | None) -> list[float]:
    """The vector of one text, in the order of FEATURES."""
    data = data or b""
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, distinct = len(words), len(set(words))
    at = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    ascii_letters = int(at[65:91].sum() + at[97:123].sum())
    chars = sum(map(len, words)) - int(at[0x80:0xC0].sum())
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [log(n + 1.0), log((chars + 50.0) / (n + 10.0)), rate(at[_SYMBOLS].sum(), chars, 0.01), rate(at[_MARKS].sum(), chars, 0.01),
            rate(at[65:91].sum(), ascii_letters, 0.03), rate(at[48:58].sum(), chars, 0.01), rate(at[124], n, 0.02), rate(again, n, 0.02),
            log((distinct + 20.0) / (n + 20.0)), rate(repeat_words(words), n, 0.02), rate(len(lines), n, 0.05), rate(len(lines) - len(set(lines)), len(lines), 0.05),
            rate(sum(w[:1].isupper() for w in words), n, 0.05), rate(at[46] + at[44], n, 0.05)]


def measured(text: Column) -> Column:
    """The vectors of whole texts, as multiples of 1 / UNIT."""
    @F.arrow_udf("array<float>")
    def run(col: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in col], np.float64).reshape(len(col), len(FEATURES))
        flat = (np.rint(x * UNIT) / UNIT).astype(np.float32).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(col) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat))

    return run(text.cast("binary"))


@dataclass(frozen=True)
class Gaussian:
    """Mean, inverse Cholesky factor of the covariance, its log-determinant by two, and the log-prior."""

    mean: np.ndarray
    inverse: np.ndarray
    half_log_det: float
    log_prior: float

    def log_density(self, z: np.ndarray) -> np.ndarray:
        return self.log_prior - self.half_log_det - 0.5 * (((z - self.mean) @ self.inverse.T) ** 2).sum(axis=1)


@dataclass(frozen=True)
class Model:
    """Scores vectors; ``classes`` is empty where fewer than two classes were seen, and then ``offset`` alone decides."""

    centre: np.ndarray
    spread: np.ndarray
    classes: tuple[Gaussian, ...] = ()
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.spread
        return self.classes[1].log_density(z) - self.classes[0].log_density(z)

    def score(self, x: np.ndarray) -> np.ndarray:
        t = self.slope * self.difference(x) + self.offset if self.classes else np.full(len(x), self.offset)
        return 1 / (1 + np.exp(-np.clip(t, -700, 700)))


def shrunk(cov: np.ndarray, n: int) -> np.ndarray:
    """The oracle approximating shrinkage of a covariance of n rows towards a sphere."""
    d = len(cov)
    trace, square = np.trace(cov), (cov * cov).sum()
    off = (n + 1 - 2 / d) * (square - trace ** 2 / d)
    rho = 1.0 if off <= 0 else min(1.0, ((1 - 2 / d) * square + trace ** 2) / off)
    return (1 - rho) * cov + rho * trace / d * np.eye(d)


def gaussians(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], params: Params) -> Model:
    """The two densities from count, sums and sums of products of each class."""
    d = len(FEATURES)
    n = sum(c for c, _, _ in sums.values())
    if set(sums) != {0, 1}:
        sure = {frozenset({0}): -700.0, frozenset({1}): 700.0}.get(frozenset(sums), 0.0)
        return Model(np.zeros(d), np.ones(d), offset=sure)
    centre = sum(s for _, s, _ in sums.values()) / n
    spread = np.sqrt(np.maximum(np.diag(sum(q for _, _, q in sums.values())) / n - centre ** 2, 0))
    spread[spread < 1e-6] = 1.0
    means = {k: s / c for k, (c, s, _) in sums.items()}
    covs = {k: (q / c - np.outer(means[k], means[k])) / np.outer(spread, spread) for k, (c, _, q) in sums.items()}
    pooled = sum(covs[k] * sums[k][0] for k in (0, 1)) / n
    made = []
    for k in (0, 1):
        cov = shrunk((1 - params.pooled) * covs[k] + params.pooled * pooled, sums[k][0]) + params.least * np.eye(d)
        factor = np.linalg.cholesky(cov)
        made.append(Gaussian((means[k] - centre) / spread, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), log(sums[k][0] / n)))
    return Model(centre, spread, tuple(made))


def _summed():
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.rint(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64) * UNIT).astype(np.int64)
            y, late = b.column("y").to_numpy(), b.column("late").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                for l in (False, True):
                    some = x[(y == k) & (late == l)]
                    sums = np.r_[len(some), some.sum(axis=0), (some.T @ some).ravel()] if len(some) else np.zeros(0, np.int64)
                    n = len(sums)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array([l] * n, pa.bool_()), pa.array(range(n), pa.int32()), pa.array(sums, pa.int64())],
                                                     ["y", "late", "at", "units"])

    return run


def _binned(model: Model, params: Params):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                at = np.floor(np.clip(model.difference(x), -params.widest, params.widest) / params.width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(at)], ["y", "bin"])

    return run


def calibrated(model: Model, bins: list[tuple[int, int, int]], params: Params) -> tuple[float, float]:
    """Slope and offset of a logistic curve over (label, bin, count) by Newton steps, with smoothed targets; (1, 0) if it would not rise."""
    n = [sum(c for y, _, c in bins if y == k) for k in (0, 1)]
    if not all(n):
        return 1.0, 0.0
    t = np.array([(b + 0.5) * params.width for _, b, _ in bins])
    count = np.array([c for _, _, c in bins], float)
    target = np.array([(n[1] + 1) / (n[1] + 2) if y else 1 / (n[0] + 2) for y, _, _ in bins])
    m, w, ridge = np.c_[t, np.ones(len(t))], np.array([1.0, 0.0]), np.diag([1e-6, 1e-6])

    def loss(w: np.ndarray) -> float:
        return float((count * (np.logaddexp(0, m @ w) - target * (m @ w))).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-m @ w))
        step = np.linalg.solve(m.T @ (m * (count * p * (1 - p))[:, None]) + ridge, m.T @ (count * (p - target)))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def fit(rows: DataFrame, params: Params = Params()) -> Model:
    """The model of ``rows`` (x: vectors, y: 0 or 1, late: boolean). Rows that are not late give the densities whose
    differences are calibrated on the late ones; the final densities come from all rows."""
    d = len(FEATURES)
    units = rows.select("x", "y", "late").mapInArrow(_summed(), "y int, late boolean, at int, units long")
    got: dict[tuple[int, bool], np.ndarray] = {}
    for r in units.groupBy("y", "late", "at").agg(F.sum(F.col("units").cast("decimal(38,0)")).alias("units")).collect():  # 4 x 211 rows at most
        got.setdefault((r["y"], r["late"]), np.zeros(1 + d + d * d, object))[r["at"]] = int(r["units"])

    def sums(*parts: bool) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
        out = {}
        for k in (0, 1):
            v = sum((got[k, late] for late in parts if (k, late) in got), np.zeros(1 + d + d * d, object))
            if v[0]:
                out[k] = (int(v[0]), np.array([int(u) / UNIT for u in v[1:1 + d]]), np.array([int(u) / UNIT ** 2 for u in v[1 + d:]]).reshape(d, d))
        return out

    early, whole = gaussians(sums(False), params), gaussians(sums(False, True), params)
    if not early.classes:
        return whole
    bins = (rows.where("late").select("x", "y").mapInArrow(_binned(early, params), "y int, bin int").groupBy("y", "bin").count().collect())  # at most 962 rows
    slope, offset = calibrated(early, sorted(map(tuple, bins)), params)
    return Model(whole.centre, whole.spread, whole.classes, slope, offset)


def fold(id: Column) -> Column:
    """crc32 of the id as text modulo 4; rows without an id have none."""
    return F.crc32(id.cast("string").cast("binary")) % 4


def score_of(model: Model, x: Column) -> Column:
    @F.arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        flat = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64)
        return pa.array(model.score(flat) if len(col) else np.zeros(0))

    return run(x)


def scores(docs: DataFrame, labels: DataFrame, params: Params = Params(), least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality) teach where the fold of the id is not 2; fold 3 calibrates. ``held_out`` marks fold 2, and
    is false without an id. Labels with one value per id are used, whatever number of times they are given.
    """
    own = cut(docs.select("doc_id", measured(F.col("text")).alias("x")), "vectors")
    known = (labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 2)).groupBy(F.col("doc_id").alias("id"))
             .agg(F.min("quality").cast("int").alias("y"), F.max("quality").alias("other")).where(F.col("y") == F.col("other")).drop("other"))
    taught = own.join(known, F.col("doc_id") == F.col("id")).select("x", "y", (fold(F.col("doc_id")) == 3).alias("late"))
    model = fit(taught, params)
    scored = own.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), score_of(model, F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
