import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfstar.llm import qda
from shelfstar.llm.qda import FEATURES, UNIT, Params

SF = "/root/testdata/sf0.01"


def in_fold(i, n):
    return zlib.crc32(str(i).encode()) % 4 == n


def slow_model(x, y, params):
    """Densities by numpy's own covariances and explicit inverses; (difference of log-densities) of new vectors."""
    centre, spread = x.mean(0), x.std(0)
    spread[spread < 1e-6] = 1
    z = (x - centre) / spread
    cov = {k: np.cov(z[y == k].T, bias=True) for k in (0, 1)}
    pooled = sum(cov[k] * (y == k).mean() for k in (0, 1))
    out = {}
    for k in (0, 1):
        s, n, d = (1 - params.pooled) * cov[k] + params.pooled * pooled, (y == k).sum(), x.shape[1]
        t, t2 = np.trace(s), np.trace(s @ s)
        rho = min(1, ((1 - 2 / d) * t2 + t * t) / ((n + 1 - 2 / d) * (t2 - t * t / d)))
        s = (1 - rho) * s + rho * t / d * np.eye(d) + params.least * np.eye(d)
        m, inv, logdet = z[y == k].mean(0), np.linalg.inv(s), np.linalg.slogdet(s)[1]
        out[k] = lambda v, m=m, inv=inv, logdet=logdet, n=n: -0.5 * np.einsum("ij,jk,ik->i", v - m, inv, v - m) - 0.5 * logdet + np.log(n / len(x))
    return lambda v: out[1]((v - centre) / spread) - out[0]((v - centre) / spread)


def test_model_equals_plain_form(spark):
    rng = np.random.default_rng(5)
    x = np.rint(np.r_[rng.normal(0, 1, (300, len(FEATURES))), rng.normal(0.7, 2, (90, len(FEATURES)))] * UNIT) / UNIT
    y, late = np.r_[np.ones(300, int), np.zeros(90, int)], rng.random(390) < 0.3
    rows = [(r.tolist(), int(k), bool(t)) for r, k, t in zip(x, y, late)]
    df = spark.createDataFrame(rows, "x array<float>, y int, late boolean").repartition(5)
    model, again = qda.fit(df), qda.fit(df.repartition(3))
    assert np.allclose(model.difference(x), slow_model(x, y, Params())(x), rtol=1e-6, atol=1e-6)
    assert np.array_equal(model.score(x), again.score(x))  # exact sums: partitions do not matter
    early = slow_model(x[~late], y[~late], Params())(x[late])
    p, near = model.slope * early + model.offset, y[late]
    target = np.where(near == 1, (near.sum() + 1) / (near.sum() + 2), 1 / ((near == 0).sum() + 2))
    grad = 1 / (1 + np.exp(-p)) - target
    assert abs(grad.mean()) < 0.02 and abs((grad * early).mean()) < 0.2  # near the optimum, but for the bins


def test_features_of_odd_texts():
    empty = qda.features(None)
    assert empty == qda.features(b"") and len(empty) == len(FEATURES) and np.isfinite(empty).all()
    for text in (b" \n\t ", "é".encode() * 500, b"a" * 100_000, b"x " * 50_000, b"\xff\xfe\x00", "###\n###\n".encode() * 9):
        assert np.isfinite(qda.features(text)).all()
    name = dict(zip(FEATURES, qda.features(b"Ab ab ab | c.\nAb ab ab | c.")))
    assert name["words"] == pytest.approx(np.log(11)) and name["distinct"] == pytest.approx(np.log(24 / 30))
    assert name["same_as_before"] == pytest.approx(np.log(3 / 60)) and name["bars"] == pytest.approx(np.log(3 / 60))
    assert name["repeated_lines"] == pytest.approx(np.log(2 / 22)) and name["capitals"] == pytest.approx(np.log(3 / 30))


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r["doc_id"]: r for r in qda.scores(docs, labels).collect()}


def test_held_out_accuracy(scored):
    docs, labels, got = scored
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if in_fold(r["doc_id"], 2)}
    assert len(truth) > 50
    right = {k: [got[i]["predicted"] == y for i, y in truth.items() if y == k] for k in (0, 1)}
    assert np.mean(right[1]) > 0.97 and np.mean(right[0]) > 0.85
    assert all(r["held_out"] == in_fold(i, 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    assert len(got) == docs.count()


def test_held_out_labels_teach_nothing(scored):
    docs, labels, got = scored
    turned = labels.withColumn("quality", F.when(qda.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r for r in qda.scores(docs, turned).collect()} == got


def test_odd_rows(spark, scored):
    docs, labels, got = scored
    extra = spark.createDataFrame([(None, None), (None, "x"), (3, ""), (3, "")], "doc_id long, text string")
    more = docs.select("doc_id", "text").union(extra).withColumn("x", F.lit(1)).withColumn("score", F.lit("s")).withColumn("y", F.lit(2))
    odd = spark.createDataFrame([(None, 1), (None, 0), (5, None), (7, 3), (10 ** 9, 0)], "doc_id long, quality int")
    rows = qda.scores(more, labels.select("doc_id", "quality").union(odd).union(labels.select("doc_id", "quality"))).collect()
    assert len(rows) == docs.count() + 4
    assert sum(r["doc_id"] is None and not r["held_out"] for r in rows) == 2
    near = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] not in (None, 3)}
    if not (labels.where("doc_id = 3").count()):
        assert near == {i: r["score"] for i, r in got.items() if i != 3}


def test_few_labels(spark):
    docs = spark.createDataFrame([(i, "some words here " * i) for i in range(12)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in qda.scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(12)] + [(2, 0)], "doc_id long, quality int")
    assert {r["predicted"] for r in qda.scores(docs, one).collect()} == {1}
    two = spark.createDataFrame([(i, int(i > 6)) for i in range(12)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in qda.scores(docs, two).collect())
    assert qda.scores(docs.limit(0), two).collect() == []
