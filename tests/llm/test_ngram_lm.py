import math
from collections import Counter

import numpy as np
import pytest

from shelfstar.llm import ngram_lm
from tests.llm.conftest import sentence


def slow(texts, alpha=0.4):
    lower = [[bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (t or "").encode().split()] for t in texts]
    uni, bi = Counter(w for x in lower for w in x), Counter(p for x in lower for p in zip(x, x[1:]))
    out = []
    for x in lower:
        own1, own2 = Counter(x), Counter(zip(x, x[1:]))
        rest, total, known = max(1, sum(uni.values()) - len(x)), 0.0, 0
        for i, w in enumerate(x):
            c1 = uni[w] - own1[w]
            c2 = bi[x[i - 1], w] - own2[x[i - 1], w] if i else 0
            if c2:
                total += math.log(c2 / (uni[x[i - 1]] - own1[x[i - 1]]))
                known += 1
            else:
                total += math.log((c1 or alpha) / rest) + (math.log(alpha) if i else 0)
        out.append((len(x), known, total))
    return out


@pytest.mark.parametrize("p", [ngram_lm.Params(), ngram_lm.Params(block_bytes=500, blocks_per_shard=1.5)])
def test_scores_equal_plain_counts(spark, rng, p):
    words = ["a", "b", "the", "The", "of", "é", "x\x1cy", "z"]
    texts = [None, "", " \n", "alone"] + [sentence(rng, rng.randint(1, 40), words) for _ in range(40)] + [" ".join(rng.choice(words) for _ in range(300)) for _ in range(9)]
    texts += [texts[-1], texts[-1]]
    rows = [(i if i % 7 else None, t, i, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, shard string")
    want = Counter((r[0], n, k, round(s, 6)) for r, (n, k, s) in zip(rows, slow(texts)))
    got = ngram_lm.scores(df, p).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_known_pairs"], round(r["log_score"], 6)) for r in got) == want
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in got)


def test_one_document_and_no_document(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ngram_lm.scores(df).first()["log_score"] == pytest.approx(3 * math.log(0.4))
    assert ngram_lm.scores(df.limit(0)).count() == 0


def test_packing_is_exact():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert np.array_equal(ngram_lm.unpack_sorted(ngram_lm.pack_sorted(h)), h) and np.array_equal(ngram_lm.unpack(ngram_lm.pack(h)), h)
