import hashlib
from collections import Counter

import numpy as np
import pytest

from shelfstar.llm import suffix_dedup as sd
from tests.llm.conftest import sentence


def slow(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                hit[i:i + length] = True
        edge = np.flatnonzero(np.diff(np.r_[False, hit[:-1], False].astype(int)))
        out.append([(int(a), int(b)) for a, b in edge.reshape(-1, 2)])
    return out


def make(rng):
    shared = [sentence(rng, 12) for _ in range(6)]
    texts = [None, "", "short", "x" * 19, "x" * 400, "x" * 400 + "y", "ab" * 300, "abc" * 70 + "é" * 100]
    for _ in range(60):
        parts = [rng.choice([sentence(rng, rng.randint(1, 30)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 30):], "\n", " é "]) for _ in range(rng.randint(1, 6))]
        texts.append("".join(parts))
    base = sentence(rng, 80)
    texts += [base, base, base[:200] + "#" + base[201:], base[:-3], base[5:], "z" + base * 2]
    return texts


@pytest.mark.parametrize("p", [sd.Params(length=40, k=8), sd.Params(length=40, k=8, in_task=4), sd.Params(length=40, k=13, chunk=20), sd.Params(length=25, k=25)])
def test_spans_equal_plain_counts(spark, rng, p):
    texts = make(rng)
    rows = [(i if i % 9 else None, t, "c", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SPANS string, row int").repartition(3)
    marked, name = sd.mark(docs, p)
    want = slow([(t or "").encode() for t in texts], p.length)
    got = {r["row"]: [(s["start"], s["stop"]) for s in r[name]] for r in marked.collect()}
    assert got == dict(enumerate(want))
    kept = {r["row"]: r for r in sd.remove(docs, p).collect()}
    assert sd.remove(docs, p).columns == docs.columns and len(kept) == len(texts)
    for i, t in enumerate(texts):
        if t is None:
            assert kept[i]["text"] is None
        else:
            data, at, out = t.encode(), 0, b""
            for a, b in want[i]:
                out, at = out + data[at:a], b
            assert kept[i]["text"] == (out + data[at:]).decode("utf-8", "ignore")


def test_columns_are_sorted_suffixes_with_their_common_prefixes(rng):
    p = sd.Params(length=12, k=4)
    parts, lead, group = [], [], []
    for g in range(4):
        for _ in range(rng.randint(1, 9)):
            left, right = rng.randint(0, p.side), rng.randint(0, p.side)
            parts.append("".join(rng.choice("ab") for _ in range(left)).encode() + b"AAAA" + "".join(rng.choice("ab") for _ in range(right)).encode())
            lead.append(left)
            group.append(g)
    lead, group = np.array(lead), np.array(group, np.uint16)

    def suffix(i, c):
        at = c - (p.side - lead[i])
        return parts[i][at:] if 0 <= at <= len(parts[i]) else None

    before = None
    for c, order, symbols, common in sd.columns(parts, lead, group, p):
        if before is not None:
            assert [suffix(i, c)[0] if suffix(i, c) else -1 for i in before] == symbols.tolist()
        before = order.copy()
        assert sorted(order.tolist()) == list(range(len(parts))) and (np.diff(group[order].astype(int)) >= 0).all()
        for x, y, n in zip(order, order[1:], common[1:]):
            a, b = suffix(x, c), suffix(y, c)
            if group[x] != group[y] or not a or not b:
                assert n == 0
            else:
                want = next((i for i, (s, t) in enumerate(zip(a, b)) if s != t), min(len(a), len(b)))
                assert n == want


def test_anchors_agree_on_equal_windows(rng):
    p = sd.Params(length=40, k=8)
    common = sentence(rng, 30).encode()
    one, two = sentence(rng, 9).encode() + common + b"x", b"yy" + common + sentence(rng, 20).encode()
    a = {(i - one.index(common), h) for i, h in zip(*map(list, sd.anchors(one, p)))}
    b = {(i - two.index(common), h) for i, h in zip(*map(list, sd.anchors(two, p)))}
    for s in range(len(common) - p.length + 1):
        inside = {x for x in a & b if s <= x[0] <= s + p.length - p.k}
        assert inside


def test_empty_table_and_transform(spark, rng):
    docs = spark.createDataFrame([(1, "q" * 30 + sentence(rng, 20))] * 1 + [(2, "r" * 30)], "doc_id long, text string")
    assert sd.remove(docs.limit(0)).count() == 0
    p = sd.Params(length=20, k=5)
    assert sd.transform(docs, p).where("column = 0").count() > 0


def test_op2_on_small_documents(spark):
    from shelfstar.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {}
    for (i, t), runs in zip(docs.items(), slow(list(docs.values()), 200)):
        at, out = 0, b""
        for a, b in runs:
            out, at = out + t[at:a], b
        want[i] = (len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(out + t[at:]).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op2_suffix_dedup"](spark, sf).collect()} == want
    assert any(w[1] for w in want.values())
