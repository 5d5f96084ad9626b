"""Every window goes through the classifier: words in any order, and other limits than the usual ones."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfstar.llm import licenses
from shelfstar.llm.licenses import NGRAMS, TEMPLATES, Params, plain_words
from tests.llm.conftest import sentence

LOOSE = "License from Apache, without warranty, under no other file"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return licenses.fit(spark, docs.select(F.explode(licenses.paragraphs_of(F.col("text"))).alias("text")))


def slow(text, model, p):
    """(licenses, n_confirmed, n_unconfirmed, best): every window that has an n-gram with a weight is judged."""
    plain = [(f, plain_words(t)) for f, ts in TEMPLATES.items() for t in ts]
    span, gains = max(len(w) for _, w in plain), model.gains()
    families, held, named, best = set(), set(), set(), None
    for b, block in enumerate(re.split(r"\n\s*\n", text)):
        words = [(w, i) for i, line in enumerate(block.split("\n")) for w in plain_words(line)]
        for at in range(0, len(words), span):
            low = max(at - span, 0)
            some = words[low:at + 2 * span]
            grams = [(" ".join(w for w, _ in some[i:i + n]), some[i][1], some[i + n - 1][1], low + i) for n in range(1, 6) for i in range(len(some) - n + 1)]
            seen = {g for g, *_ in grams}
            known = {g for g in seen if g in gains and len(g.split()) in NGRAMS}
            odds = [s + sum(gains[g][c] for g in known) for c, s in enumerate(model.start())]
            chance = dict(zip(model.classes[1:], [1 / (1 + math.exp(-max(-700, x))) for x in odds]))
            if not known or max(chance.values()) < p.sure:
                continue
            best = max(best or 0, *chance.values())
            named |= {(b, a) for g, a, _, i in grams if g in known and at <= i < at + span}
            for f, w in plain:
                n = min(p.shingle, len(w))
                shingles = {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}
                if chance[f] >= p.sure and len(shingles & seen) >= p.share * len(shingles) - 1e-9:
                    families.add(f)
                    held |= {(b, i) for g, first, last, _ in grams if g in shingles for i in range(first, last + 1)}
    return sorted(families), len(held), len(named - held), best


def test_words_out_of_order_are_judged(spark, model):
    """No three of these words follow each other in a template, yet the classifier is sure of a family."""
    want = slow(LOOSE, model, Params())
    assert want[3] > 0.9
    got = licenses.scan(spark.createDataFrame([(1, LOOSE), (2, f"word\n{LOOSE}\nword\n\nReleased under the MIT License.")], "doc_id long, text string"), model)
    got = {r["doc_id"]: r for r in got.collect()}
    assert (got[1]["licenses"], got[1]["n_confirmed"], got[1]["n_unconfirmed"]) == ([], 0, 1) and abs(got[1]["best"] - want[3]) < 1e-9
    assert (got[2]["licenses"], got[2]["n_confirmed"], got[2]["n_unconfirmed"]) == (["MIT"], 1, 1)


def test_a_window_that_ends_within_a_notice_is_judged(spark, model):
    """The first words of a notice stand at the end of one window, the rest in the next; all three windows that propose it count."""
    rng = random.Random(2)
    texts = [f"{sentence(rng, n)}\nlicensed under cc by-nc{end}" for n in range(16, 24) for end in ("", "\n4.0")]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        want = slow(texts[r["doc_id"]], model, Params())
        assert tuple(r)[2:5] == want[:3] and want[3] is not None and abs(r["best"] - want[3]) < 1e-9, (texts[r["doc_id"]], r, want)


def test_shuffled_words_equal_plain_loops(spark, model):
    rng = random.Random(5)
    words = sorted({w for ts in TEMPLATES.values() for t in ts for w in plain_words(t)})
    texts = [LOOSE, "mit", "license", "x", "a copy of", "it under the terms of the gnu"]
    for _ in range(250):
        some = [rng.choice([rng.choice(words), rng.choice(words), sentence(rng, 1)]) for _ in range(rng.randint(1, 60))]
        texts.append("".join(x + rng.choice([" ", " ", " ", ", ", "\n", "\n\n"]) for x in some))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = 0
    for p in (Params(), Params(sure=1e-3), Params(sure=0.999, share=0.2, shingle=2), Params(sure=1.0)):
        got = {r["doc_id"]: tuple(r)[2:] for r in licenses.scan(df, model, p).collect()}
        for i, t in enumerate(texts):
            want = slow(t, model, p)
            assert got[i][:3] == want[:3] and (got[i][3] is None) == (want[3] is None) and abs((got[i][3] or 0) - (want[3] or 0)) < 1e-9, (p, t, got[i], want)
            n += want[3] is not None
    assert n > 100


def test_a_gated_text_cannot_propose(spark, model):
    """The gate's bound is at least what any order of the words gives; a model without weights proposes nothing."""
    most, gains = licenses.reach(model), model.gains()
    for g, gain in gains.items():
        assert all(sum(most.get(w, [0.0] * len(gain))[c] for w in set(g.split())) >= x - 1e-9 for c, x in enumerate(gain)), g
    flat = licenses.Model(model.classes, model.vocabulary, [[0.0] * len(w) for w in model.weights], model.bias, model.temperature)
    got = licenses.scan(spark.createDataFrame([(1, LOOSE), (2, "Released under the MIT License.")], "doc_id long, text string"), flat).collect()
    assert sorted((r["doc_id"], r["licenses"], r["best"]) for r in got) == [(1, [], None), (2, [], None)]
