import re

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfstar.llm import simhash
from tests.llm.conftest import sentence


def slow(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(items, near):
    root = {x: x for x in items}
    for x in sorted(items):
        for y in sorted(items):
            if near(x, y):
                a, b = root[x], root[y]
                if a != b:
                    lo = min(a, b)
                    root = {i: lo if r in (a, b) else r for i, r in root.items()}
    return root


def test_fingerprints_equal_the_plain_form(spark, rng):
    texts = [None, "", "  ", "One", "one TWO three", "Ä É a b c d", "x y z"] + [sentence(rng, n) for n in (4, 5, 9, 300, 2000)] + ["a b " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k in (4, 5):
        got = {r["doc_id"]: r["fp"] for r in df.select("doc_id", simhash.hex_of(simhash.fingerprints(F.col("text"), k)).alias("fp")).collect()}
        assert got == {i: f"{slow(t, k):016x}" for i, t in enumerate(texts)}


@pytest.mark.parametrize("blocks,in_task", [(None, 1000), (5, 3), (6, 1), (7, 1000)])
def test_links_connect_what_all_pairs_connect(spark, rng, blocks, in_task):
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 6])):
            fps.add(x - (1 << 64) if x >> 63 else x)
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5, 6])):
                x ^= 1 << b
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(df, 4, in_task, blocks).collect()]
    far = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert all(far(a, b) <= 64 for a, b in edges)
    linked = set(edges) | {(b, a) for a, b in edges}
    assert groups(fps, lambda x, y: (x, y) in linked) == groups(fps, lambda x, y: far(x, y) <= 4)


def test_components_and_one_row_of_each(spark, rng):
    base = sentence(rng, 400)
    near = " ".join(base.split()[:-1] + ["other"])
    rows = [(5, base, "p"), (3, near, "p"), (9, base, "p"), (3, near, "p"), (7, sentence(rng, 300), "q"), (8, None, None), (2, "", ""),
            (None, base, "r"), (None, "lonely text that nobody has at all", "r"), (None, "lonely text that nobody has at all", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FP string")
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs, 5, 4).collect()]
    want = [(5, 3), (3, 3), (9, 3), (3, 3), (7, 7), (8, 2), (2, 2), (None, 3), (None, None), (None, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 3, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_op5_against_all_pairs(spark):
    from shelfstar.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: slow(t, 4) for i, t in docs.items()}
    want = groups(docs, lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in docs}
