"""The whole result of the licence scan against plain loops, and what the classifier decides."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfstar.llm import licenses
from shelfstar.llm.licenses import NGRAMS, TEMPLATES, Params, plain_words
from tests.llm.conftest import sentence
from tests.llm.test_license_notices import BSD, GPL, LONG, MIT, SHORT

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return licenses.fit(spark, docs.select(F.explode(licenses.paragraphs_of(F.col("text"))).alias("text")))


def slow(text, model, p=Params()):
    """(n_paragraphs, licenses, n_confirmed, n_unconfirmed, best) with every window read on its own."""
    span = max(len(plain_words(t)) for ts in TEMPLATES.values() for t in ts)
    text, families, held, named, best = text or "", set(), set(), set(), None
    weights = dict(zip(model.vocabulary, model.weights))
    plain = [plain_words(t) for ts in TEMPLATES.values() for t in ts]
    told = {" ".join(w[i:i + 3]) for w in plain for i in range(max(1, len(w) - 2))}
    for b, block in enumerate(re.split(r"\n\s*\n", text)):
        words = [(w, i) for i, line in enumerate(block.split("\n")) for w in plain_words(line)]
        for at in range(0, len(words), span):
            low = max(at - span, 0)
            some = words[low:at + 2 * span]
            grams = [(" ".join(w for w, _ in some[i:i + n]), some[i][1], some[i + n - 1][1], low + i) for n in range(1, 6) for i in range(len(some) - n + 1)]
            seen = {g for g, *_ in grams}
            known = seen & {g for g, w in weights.items() if any(abs(x - w[0]) > 1e-9 * model.temperature for x in w[1:]) and len(g.split()) in NGRAMS}
            if not seen & told:
                continue
            odds = [sum(weights[g][c] - weights[g][0] for g in known) + model.bias[c] - model.bias[0] for c in range(1, len(model.classes))]
            chance = [1 / (1 + math.exp(-max(-700, x / model.temperature))) for x in odds]
            if max(chance) < p.sure:
                continue
            best = max(best or 0, *chance)
            named |= {(b, a) for g, a, _, i in grams if g in known and at <= i < at + span}
            for f, c in zip(model.classes[1:], chance):
                for t in TEMPLATES[f] if c >= p.sure else ():
                    w = plain_words(t)
                    n = min(p.shingle, len(w))
                    shingles = {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}
                    if len(shingles & seen) >= p.share * len(shingles) - 1e-9:
                        families.add(f)
                        held |= {(b, i) for g, first, last, _ in grams if g in shingles for i in range(first, last + 1)}
    return sum(bool(x.strip(" ")) for x in text.split("\n")), sorted(families), len(held), len(named - held), best


def same(got, want):
    return tuple(got[:4]) == want[:4] and (got[4] is None) == (want[4] is None) and abs((got[4] or 0) - (want[4] or 0)) < 1e-9


def test_equals_plain_loops(spark, model):
    rng = random.Random(3)
    parts = [t for t, _ in SHORT + LONG] + [t for ts in TEMPLATES.values() for t in ts] + ["", " ", "under the terms of the", "free software", "license version 2.0", MIT[:70]]
    texts = [None, "", " \n \n", "x " * 500]
    for _ in range(150):
        some = [rng.choice([rng.choice(parts), sentence(rng, rng.randint(0, 40))]) for _ in range(rng.randint(1, 9))]
        texts.append("".join(x + rng.choice(["\n", " ", "\n\n", "\n \t\n"]) for x in some))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for p in (Params(), Params(sure=0.9, share=0.5)):
        got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(df, model, p).collect()}
        wrong = [(t, got[i], slow(t, model, p)) for i, t in enumerate(texts) if not same(got[i], slow(t, model, p))]
        assert not wrong, wrong[0]


def test_documents_equal_plain_loops(spark, model):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(rows, model).collect()}
    wrong = [(r["doc_id"], got[r["doc_id"]], slow(r["text"], model)) for r in rows.collect() if not same(got[r["doc_id"]], slow(r["text"], model))]
    assert not wrong and len(got) == rows.count()


def test_the_classifier_decides(spark, model):
    """Without the weights of a family its notices are not found, though a template would fit."""
    f = model.classes.index("MIT")
    weights = [[x if c != f else min(x, w[0]) for c, x in enumerate(w)] for w in model.weights]
    blind = licenses.Model(model.classes, model.vocabulary, weights, model.bias, model.temperature)
    df = spark.createDataFrame([(1, "Released under the MIT License."), (2, BSD)], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(df, model).collect()} == {1: ["MIT"], 2: ["BSD-3-Clause"]}
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(df, blind).collect()} == {1: [], 2: ["BSD-3-Clause"]}


def test_unknown_is_calibrated(model):
    """On wordings that were not fitted, the probability of the right family against unknown is near the share that is right."""
    rng = random.Random(9)
    said = []
    for f, texts in TEMPLATES.items():
        for t in texts:
            for _ in range(6):
                text = f"{sentence(rng, 20)} by the authors {t} of this {sentence(rng, 20)}"
                said.append((slow(text, model)[4] or 0.0, 1))
    for _ in range(600):
        common = " ".join(rng.choice("the of this under and a in version work license free all terms software".split()) for _ in range(rng.randint(1, 6)))
        said.append((slow(f"{sentence(rng, 20)} {common} {sentence(rng, 20)}", model)[4] or 0.0, 0))
    named = [y for c, y in said if c >= 0.5]
    assert sum(named) / len(named) > 0.8 and sum(c >= 0.5 for c, y in said if y) > 0.98 * sum(y for _, y in said)


def test_cost_is_linear_in_a_line(spark, model):
    import time
    seconds = []
    for n in (3_000, 3_000, 48_000):
        text = " ".join(f"the license of w{i} under" for i in range(n // 5)) + " " + GPL.replace("\n", " ")
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        assert licenses.scan(df, model).collect()[0]["licenses"] == ["GPL-3.0"]
        seconds.append(time.time() - began)
    assert seconds[2] < 8 * seconds[1] + 5  # sixteen times the words
