import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfstar.llm import bpe
from tests.llm.conftest import sentence

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def tree(text, leaf):
    return bpe.join_all(PATH, [bpe.encode_piece(PATH, p) for p in bpe.halves(text.encode(), leaf)]).ids.tolist()


PARTS = ["a", "the ", " ", "  ", "\n", "\n\n ", "'s", "'", "''", "'ll", "é", "ß", "日本", "🙂", "123", "4", "!", "...", "<|endoftext|>", "<|endo", "ftext|>", "-", "=", "xyz", "ing", "\t", "\u00a0"]


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(PARTS), st.sampled_from([1, 1, 1, 2, 3, 30, 200])), max_size=60), st.sampled_from([8, 13, 50, 200]))
def test_tree_equals_whole(monkeypatch_window, parts, leaf):
    text = "".join(p * n for p, n in parts)
    assert tree(text, leaf) == WHOLE.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def monkeypatch_window():
    old, bpe.WINDOW = bpe.WINDOW, 16
    yield
    bpe.WINDOW = old


def test_long_words_and_runs(rng):
    for unit in ("ab", "x", " ", "=", "\n", "9", "日", "'", "<|endoftext|>", "aAbB", "thing"):
        text = sentence(rng, 50) + unit * (20_000 // len(unit)) + sentence(rng, 50)
        assert tree(text, 700) == WHOLE.encode(text, add_special_tokens=False).ids, unit
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    assert tree(word, 1000) == WHOLE.encode(word, add_special_tokens=False).ids


def test_window_stays_small(rng, monkeypatch):
    seen = []
    real = bpe.encode_piece
    monkeypatch.setattr(bpe, "encode_piece", lambda p, d: seen.append(len(d)) or real(p, d))
    left, right = real(PATH, sentence(rng, 5000).encode()), real(PATH, sentence(rng, 5000).encode())
    bpe.join(PATH, left, right)
    assert sum(seen) < 2000


def test_encode_and_decode_tables(spark, rng):
    long = sentence(rng, 3000)
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "Hello <|endoftext|> world's", "x", 1), (4, long, "x", 1), (4, long, "x", 1), (None, long, None, None),
            (5, long + " é" * 900, "y", 2), (3, "Hello <|endoftext|> world's", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, IDS2 int")
    got = bpe.encode(docs, PATH, leaf=500).withColumn("back", bpe.decode(PATH, F.col("ids")))
    assert got.columns == ["doc_id", "k1", "IDS2", "ids", "back"]
    want = [(i, k, n, WHOLE.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, k, n in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    both = bpe.encode(docs, PATH, leaf=500, decoded="text")
    assert both.columns == ["doc_id", "k1", "IDS2", "ids", "text"]
    assert sorted(map(repr, map(tuple, both.collect()))) == sorted(map(repr, want))
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_op4_on_small_documents(spark):
    from shelfstar.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = WHOLE.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(WHOLE.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_tree_bpe"](spark, sf).collect()} == want
    assert np.array(list(want.values()), dtype=object).shape[1] == 3
