"""The pipeline against plain loops, each stage on what its predecessor kept."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from shelfstar.llm import mixing
from shelfstar.llm.queries import LIMIT, WEIGHTS
from tests.llm.test_quality_chat import slow as measured
from tests.llm.test_simhash import groups
from tests.llm.test_simhash import slow as fingerprint
from tests.llm.test_suffix_dedup import slow as runs

SF = "/root/testdata/sf0.001"


def test_every_stage_equals_plain_loops(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, now = docs.columns, {r["doc_id"]: r.asDict() for r in docs.collect()}
    done = {}
    for name, stage in cp.STAGES:
        path = str(tmp_path / name)
        out = stage(spark, docs, SF)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        done[name] = (before, docs)
        if name != "tokens":
            assert docs.columns == names

    def good(t):
        n, chars, symbols, lines, dup, again = measured(t)
        return not (n < 10 or 100 * again > 20 * n or chars < 2 * n or chars > 15 * n or 10 * symbols > n or 2 * dup > lines)

    now = {i: r for i, r in now.items() if good(r["text"])}
    assert {r["doc_id"] for r in done["quality"][1].collect()} == set(now)
    fps = {i: fingerprint(r["text"], 4) for i, r in now.items()}
    root = groups(now, lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 4)
    now = {i: r for i, r in now.items() if root[i] == i}
    assert {r["doc_id"] for r in done["near_dedup"][1].collect()} == set(now)
    for r, found in zip(now.values(), runs([r["text"].encode() for r in now.values()], 200)):
        data = r["text"].encode()
        for a, b in reversed(found):
            data = data[:a] + data[b:]
        r["text"] = data.decode("utf-8", "ignore")
    now = {i: r for i, r in now.items() if r["text"].strip(" ")}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in done["passage_dedup"][1].collect()} == {i: (r["text"], len(r["text"])) for i, r in now.items()}
    planned = mixing.plan(done["source_mix"][0], WEIGHTS, LIMIT).collect()
    taken = Counter()
    for r in planned:
        taken[r["source"]] += r["taken"]
    for r in planned:
        assert abs(taken[r["source"]] - r["target"]) <= max(x["size"] for x in planned if x["source"] == r["source"])
    mixed = Counter(r["doc_id"] for r in done["source_mix"][1].collect())
    assert mixed == +Counter({r["doc_id"]: r["copies"] for r in planned})
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = done["tokens"][1].collect()
    assert Counter(r["doc_id"] for r in rows) == mixed
    for r in rows:
        assert r["text"] == now[r["doc_id"]]["text"] and r["ids"] == whole.encode(r["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run_applies_the_stages(spark):
    assert cp.run(spark, SF).count() > 0


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
