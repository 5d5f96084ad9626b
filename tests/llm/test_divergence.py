import re
from collections import Counter, defaultdict

from shelfstar.llm import divergence
from shelfstar.llm.divergence import Params

TERM = re.compile(divergence.TERM)


def slow(rows, params):
    """The audit by plain loops over dense counts: (lang, source, part, item, value, rank)."""
    n, total, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sources[lang].add(source)
        n[lang, source].update(words)
        total[lang].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, names in sources.items():
        kept = [t for t in docs[lang] if docs[lang][t] >= params.min_docs]
        v = len(kept)

        def shares(c):
            whole = sum(c[t] for t in kept) + params.prior * v
            return {t: 1 + params.scale * (c[t] + params.prior) // whole for t in kept}

        p, q = {s: shares(n[lang, s]) for s in names}, shares(total[lang])
        for s in names:
            far = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in names if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, top in (("pair", far, len(far)), ("term", more, params.top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def audit(spark, rows, params):
    docs = spark.createDataFrame(rows, "text string, lang string, source string, SCORE int, n int, `all` string") if rows and len(rows[0]) == 6 else \
        spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(map(tuple, divergence.audit(docs, params).collect()))


def test_equals_plain_loops(spark, rng):
    words = ["Ab", "aB", "ÄB", "äb", "日本", "x", "y1z", "é", "🙂q", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "a", "b", "Z", None]))
            for _ in range(300)]
    rows += [(None, "en", "silent"), ("", "fr", "alone"), ("only here", "xx", "a"), ("1 2 3", "xx", None)] + [("ab ab ä", "de", "copies")] * 40
    rows += [("x " * 30_000, "en", "long")]
    for params in (Params(min_docs=30), Params(min_docs=2, top=5), Params(min_docs=1, prior=1, top=3)):
        assert audit(spark, rows, params) == slow(rows, params)


def test_equal_values_are_ranked_by_item(spark):
    rows = [("b a é z Z ü", "en", "s1")] * 3 + [("q", "en", "s2")] * 3
    got = audit(spark, rows, Params(min_docs=3, top=4))
    assert got == slow(rows, Params(min_docs=3, top=4))
    ranked = sorted((r[5], r[3]) for r in got if r[1] == "s1" and r[2] == "term")
    assert ranked == [(1, "z"), (2, "a"), (3, "b"), (4, "é")]  # z occurs twice, then ties in UTF-8 order


def test_empty_table_and_clashing_columns(spark):
    assert audit(spark, [], Params()) == []
    rows = [("a b", "en", "s", 1, 2, "x"), ("a", "en", "t", 1, 2, None), (None, None, None, None, None, None)]
    assert audit(spark, rows, Params(min_docs=2)) == slow([r[:3] for r in rows], Params(min_docs=2))


def test_large_counts_stay_exact(spark):
    known = spark.sql("select 5000000000000L as n, 9000000000000L as total, 3L as terms")
    got = known.select(divergence.share(known["n"], known["total"], known["terms"], Params())).first()[0]
    assert got == 1 + 10**9 * (5 * 10**12 + 5) // (9 * 10**12 + 15)
