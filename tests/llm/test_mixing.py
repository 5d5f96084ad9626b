from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfstar.llm import mixing
from tests.llm.conftest import sentence


def fill(sizes, weights, limit):
    """Plain water filling."""
    order = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > limit * sizes[s]}
        if not over:
            return {s: limit * sizes[s] if s in full else level * w[s] for s in order}
        full |= over


@pytest.fixture
def docs(spark, rng):
    rows = []
    for i in range(400):
        s = rng.choice(["a", "a", "a", "b", "Z", "é", None, "tiny"])
        n = rng.choice([0, 1, 3, 10, 40, 200]) if s != "tiny" else 1
        rows.append((i, rng.choice([None, ""]) if n == 0 else sentence(rng, n), s, "en", i))
    rows += [(1000, "w x y", "b", "en", 0)] * 9 + [(None, "q r", "a", "en", 0)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, target long")


def test_sources_come_near_their_targets_and_reruns_agree(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "FAN", 3)
    got = mixing.plan(docs, [1.0, 2.0, 3.0]).collect()
    assert len(got) == docs.count()
    size, taken, largest = Counter(), Counter(), defaultdict(int)
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and (r["size"] > 0 or r["copies"] == 0)
    want = fill(dict(size), [1.0, 2.0, 3.0], 3.0)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s], s
    again = mixing.plan(docs.repartition(7), [1.0, 2.0, 3.0]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_repeats_rows_as_planned(spark, docs):
    names = docs.columns
    planned = Counter()
    for r in mixing.plan(docs, [1.0, 2.0]).collect():
        planned[r["doc_id"]] += r["copies"]
    out = mixing.mix(docs, [1.0, 2.0])
    assert out.columns == names
    assert Counter(r["doc_id"] for r in out.collect()) == +planned


def test_empty_table_and_no_words(spark, docs):
    assert mixing.plan(docs.limit(0), [1.0]).count() == 0 and mixing.mix(docs.limit(0), [1.0]).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["taken"], r["target"]) for r in mixing.plan(none, [1.0]).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_pivot_keeps_words_and_expectations():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 50, 41)
    p0 = rng.random(41)
    total = np.zeros(41)
    for _ in range(4000):
        p = p0.copy()
        left = mixing.pivot(p, size, rng.random(41))
        assert abs((p * size).sum() - (p0 * size).sum()) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != left)
        total += p
    assert np.abs(total / 4000 - p0).max() < 0.05
