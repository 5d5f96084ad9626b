import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfstar.llm import rns_negatives as rns
from shelfstar.llm.rns_negatives import Params

SCHEMA = "id long, label int, vector array<double>, is_anchor boolean"


def slow(rows, params):
    ok = {(i, y, tuple(v)): False for i, y, v, _ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for i, y, v, a in rows:
        if v is not None and (i, y, tuple(v)) in ok:
            ok[i, y, tuple(v)] |= bool(a)
    out = []
    for (i, y, v), is_anchor in ok.items():
        if not is_anchor:
            continue
        found = sorted(((sum(int(a) * int(b) for a, b in zip(v, w)), j, z) for j, z, w in ok if j != i), key=lambda x: (-x[0], x[1]))
        for ps, p, _ in [x for x in found if x[2] == y][:params.positives]:
            hard = [(ns, n) for ns, n, z in found if z != y and params.low * ps <= 100 * ns <= params.high * ps][:params.negatives]
            out += [(i, p, r + 1, n, ps, ns) for r, (ns, n) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, params=Params()):
    return sorted(map(tuple, rns.mine(spark.createDataFrame(rows, SCHEMA), params).collect()))


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for dims, top in ((1, 3), (64, 256), (200, 300_000), (7, 1 << 22)):
        a, b = (rng.integers(-top, top + 1, (n, dims)).astype(float) for n in (17, 33))
        a[0], b[0], b[1] = top, top, -top
        bound = top * top * dims
        primes = rns.primes_for(bound, dims)
        assert math.prod(primes) > 2 * bound and len(set(primes)) == len(primes)
        assert min(dims, rns.RUN) * (max(primes) // 2) ** 2 < rns.EXACT
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert rns.Scorer(b, primes).scores(a).tolist() == want


def test_first_takes_ties_by_place():
    assert rns.first(np.array([1, 5, 5, 2, 5]), 2).tolist() == [1, 2]
    assert rns.first(np.array([1, 5, 5]), 9).tolist() == [1, 2, 0]
    assert rns.first(np.array([], np.int64), 3).tolist() == []


def test_floor_of_components(spark):
    got = spark.sql("select array(-0.001D, 0.999D, 1e300D, cast('-Infinity' as double), null, 3.5D) as v").select(rns.integers(F.col("v"), 256)).first()[0]
    assert got == [-1.0, 255.0, 256 * 1e300, -math.inf, None, 896.0]


def test_equals_plain_loops(spark, rng):
    def vec():
        return [float(rng.randint(-40, 90)) for _ in range(70)]

    common = vec()
    rows = [(i, rng.choice([0, 0, 1, 2]), common if i % 3 == 0 else vec(), i % 5 == 0) for i in range(120)]
    rows += [(200 + i, None if i == 0 else 1, v, True) for i, v in enumerate([vec(), None, [None] * 70, [math.nan] + [0.0] * 69, [math.inf] * 70, [], [1.0], [0.0] * 70])]
    rows += [(None, 1, vec(), True), (5, 1, rows[5][2], True), (5, 1, rows[5][2], None), (10, 2, vec(), True)] + [(300, 1, common, True)] * 20
    for params in (Params(), Params(anchor_block=7, candidate_block=13, tile=3), Params(positives=2, negatives=40, low=10, high=90, candidate_block=50)):
        assert mined(spark, rows, params) == slow(rows, params)


def test_small_and_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0], True)]) == []
    assert mined(spark, [(100, 1, [2.0], True), (1, 1, [2.0], False), (2, 2, [2.0], False), (3, 2, [1.0], False)]) == [(100, 1, 1, 2, 4, 4)]


def test_too_large_scores_are_refused(spark):
    with pytest.raises(ValueError):
        mined(spark, [(100, 1, [1e9, 2e9], True), (1, 1, [1e9, 3.0], False)])
