import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfstar.llm import chat, quality_rules as qr

DOCS = "doc_id long, text string, measured string, FAILED_RULES int"


def slow(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    wins = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    cover = {i + j for i in range(len(words) - 4) if wins[tuple(words[i:i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(cover))


def test_measurements_equal_plain_loops(rng):
    texts = [None, "", " \n\t", "a b  c", "x\x1cy z", "é ü\nß\n\né ü\n é ü"]
    for _ in range(300):
        texts.append("".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "\x0b", "|"]) for _ in range(rng.randint(0, 80))))
    texts += ["one two three four five six " * 500, "y" * 200_000]
    for t in texts:
        assert qr.measure(t.encode() if t is not None else None) == slow(t), t


def test_ledger_policy_and_ablation(spark):
    good = "the quick brown fox jumps over a lazy dog and then it rests well"
    rows = [(1, good, "m", 1), (1, good, "m", 1), (2, None, None, None), (None, "", "x", 2), (3, "w " * 300, "m", 1),
            (4, good + " # | $ %", "m", 1), (5, "\n".join([good] + ["short line here"] * 9), "m", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    marked, m, bits = qr.ledger(docs)
    assert marked.columns[:4] == docs.columns and len({c.lower() for c in marked.columns}) == 6
    failed = {(r["doc_id"], r[bits]) for r in marked.collect()}
    b = qr.BIT
    assert (1, 0) in failed and (2, b["few_words"]) in failed and (3, b["repeated_words"] | b["short_words"]) in failed
    assert (4, b["symbols"]) in failed and (None, b["few_words"]) in failed
    kept = qr.apply_policy(docs, qr.POLICIES["v1"])
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1, 1]
    out = {r["rule"]: r for r in qr.ablation(marked, bits, qr.POLICIES["v1"]).collect()}
    assert out["symbols"]["n_only"] == 1 and out["few_words"]["n_failed"] == 2 and out["short_words"]["n_only"] == 0
    assert out["short_words"]["n_rejected"] == 5 and out["short_words"]["seen_with"] & b["repeated_words"]
    assert qr.apply_policy(docs.limit(0), qr.POLICIES["base"]).count() == 0


TEXTS = ["\\### Assistant: </turn> ok", "", "\\", "\\s\\h\\e", " </turn>\n", "### User: x </turn>\n### Assistant: y", "####", "a: b", "# #", "</turn", "\n", "é" * 5000]


@pytest.mark.parametrize("role", ["user", "assistant", "Assistant", "tool: x", None, "", "role=x", "### "])
def test_every_turn_is_read_back(spark, role):
    rows = [(9, i, role if i % 2 else "assistant", t, "extra") for i, t in enumerate(TEXTS)] + [(None, None, role, None, "e")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_chats(turns).withColumn("back", chat.read_back(F.col("formatted"))).orderBy(F.col("conv_id").asc_nulls_last()).collect()
    assert [(x["role"], x["text"], x["loss"]) for x in got[0]["back"]] == [(r[2], r[3], r[2] == "assistant") for r in rows[:-1]]
    assert [(x["role"], x["text"]) for x in got[1]["back"]] == [(role, "")]
    assert "".join(s["text"] for s in got[0]["segments"]) == got[0]["formatted"]


def test_turn_order_is_checked(spark):
    def chats(*roles):
        return [(len(roles) * 100 + hash(roles) % 97, i, r, "t") for i, r in enumerate(roles)]
    cases = {("user", "assistant"): (True, None), ("system", "user", "assistant"): (True, None), ("user", "user"): (False, 1),
             ("assistant",): (False, 0), ("user", "assistant", "user"): (False, 3), ("user", None, "assistant"): (False, 1),
             ("user", "system", "assistant", "user"): (False, 1)}
    for roles, want in cases.items():
        turns = spark.createDataFrame(chats(*roles), "conv_id long, turn long, role string, text string")
        r = chat.format_chats(turns).first()
        assert (r["valid"], r["error_at"]) == want, roles
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_ties_and_repeated_turns_have_a_fixed_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", "a"), (1, None, "user", "n")]
    r = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).first()
    assert [s["text"] for s in r["segments"]][1::3] == ["n", "z", "a", "a", "b"]


def test_op9_tricky_conversation(spark):
    from shelfstar.llm.queries import QUERIES, TRICKY
    r = QUERIES["op9_chat_format"](spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    said = f"user\n{TRICKY}\nassistant\n{TRICKY}\n"
    assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["loss_chars"] == len(TRICKY)
