import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfstar.operators import text as ops


def plain_chunks(text, size, overlap):
    """Character by character, as the rule is stated."""
    out, start, n = [], 0, 0
    while start < len(text):
        end = start + size
        if end < len(text):
            for i in range(end, int(end - size * 0.2), -1):
                if text[i] in ".!?" and (i + 1 >= len(text) or text[i + 1] == " "):
                    end = i + 1
                    break
        piece = text[start:end].strip()
        if piece:
            out.append((n, start, piece))
            n += 1
        start = end - overlap
    return out


def test_chunks_match_the_stated_rule(spark):
    rng = random.Random(5)
    texts = ["", "short.", "x" * 100, "a" * 79 + ". " + "b" * 60, "a. " * 70, "no end " * 40, "é? " * 90, " " * 200, "a" * 100 + "."]
    texts += ["".join(rng.choice("ab .!?\n") for _ in range(rng.randint(0, 900))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in ops.chunks(df, size=100, overlap=10).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.char_start, r.chunk_text))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == (plain_chunks(t, 100, 10) if t else [(0, 0, "")]), i


def test_chunks_cover_the_whole_text():
    text = "".join(f"Sentence {i} goes on. " for i in range(900))
    found = ops.sentence_chunks(text)
    end = 0
    for start, piece in found:
        assert start <= end
        end = max(end, start + len(piece) + 1)
    assert end >= len(text.rstrip())


def test_overlap_must_leave_room(spark):
    with pytest.raises(ValueError):
        ops.chunks(spark.createDataFrame([(1, "a")], "doc_id long, text string"), size=100, overlap=90)


def test_tags_and_normalisation(spark):
    df = ops.topic_tags(spark.createDataFrame([("Runs SMALL but the fabric is soft.\nWould buy again",), ("nothing",)], "text string"))
    a, b = df.collect()
    assert (a.mentions_sizing, a.mentions_quality, a.mentions_comfort, a.has_recommendation, a.mentions_price, a.word_count) == (True, True, True, True, False, 10)
    assert not any(b[n] for n in ops.TOPICS)
    m = spark.createDataFrame([("Organic Cotton",), ("lin",), ("Tencel",), (None,), ("",), ("SILK",)], "m string")
    got = [r[0] for r in m.select(ops.normalise(F.col("m"), ops.MATERIALS, "default", partial=True)).collect()]
    assert got == ["cotton", "linen", "default", "default", "default", "silk"]
    s = spark.createDataFrame([("SS24",), ("x",), ("my-core",), (None,)], "c string")
    assert [r[0] for r in s.select(ops.season_key(F.col("c"))).collect()] == ["SS", "default", "CORE", "default"]


@pytest.mark.parametrize("block", [2, 100])
def test_search_is_exact_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ops, "QUERY_BLOCK", block)
    monkeypatch.setattr(ops, "VECTOR_BLOCK", 30 * block)
    monkeypatch.setattr(ops, "STEP", 7)
    rng = np.random.default_rng(1)
    e = rng.normal(size=(200, 8)).astype("float32")
    e[50] = e[10]  # a tie, settled by the key
    rows = [(i, [float(x) for x in v], i % 4) for i, v in enumerate(e)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    queries = vectors.where("vec_id in (10, 3, 77)").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in ops.search(vectors, queries, 5, "label < 3").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    unit = e.astype("float64") / np.linalg.norm(e.astype("float64"), axis=1, keepdims=True)
    for q in (10, 3, 77):
        score = unit @ unit[q]
        order = sorted((i for i in range(200) if i % 4 < 3), key=lambda i: (-round(score[i], 12), i))[:5]
        assert [v for _, v in sorted(got[q])] == order
