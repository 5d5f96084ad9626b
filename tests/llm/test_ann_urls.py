import numpy as np
import pytest

from shelfstar.llm import ann, url_filter
from shelfstar.llm.url_filter import Rule


def exact(rows, k):
    use = {}
    for i, v, _ in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            use[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(use))
    x = np.stack([use[i] for i in ids]) if len(ids) else np.zeros((0, 8))
    out = []
    for i, v, asks in rows:
        if asks and i in use:
            s = (x * use[i]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out += [(i, r, int(ids[j]), float(s[j])) for r, j in enumerate(order, 1)]
    return sorted(set(out))


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], i % 5 == 0) for i in range(120)]
    rows += [(i, rows[0][1], i % 2 == 0) for i in range(200, 260)]  # many copies
    rows += [(300, None, True), (301, [0.0] * 8, True), (302, [None] + [1.0] * 7, True), (303, [float("nan")] * 8, True),
             (304, [float("inf")] + [1.0] * 7, True), (305, [], True), (306, [1.0, 2.0], True), (None, rows[1][1], True), (5, rows[5][1], True), (307, rows[3][1], None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "id long, vector array<double>, asks boolean, score double")
    p = ann.Params(block_members=16, block_queries=3)
    got = sorted(map(tuple, ann.nearest(df, 6, p).collect()))
    want = exact(rows, 6)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)
    assert ann.nearest(df.limit(0), 3).count() == 0
    few = spark.createDataFrame(rows[:3], "id long, vector array<double>, asks boolean")
    assert ann.nearest(few, 20).count() == 2


def test_parts_are_balanced_and_recall_is_high(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16)) * 2
    x = centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16)) * 0.5
    g = ann.neighbour_graph(x.astype(np.float32), 8)
    part = ann.balanced_parts(g, 12)
    sizes = np.bincount(part, minlength=12)
    assert sizes.max() <= 1.06 * 250 + 1 and (part[g] != part[:, None]).mean() < 0.3
    rows = [(i, [float(c) for c in v], i % 20 == 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, asks boolean")
    got = ann.nearest(df, 10, ann.Params(sample=1500, size=250, block_members=100)).collect()
    x = x.astype(np.float32).astype(float)
    hit = 0
    for i in range(0, 3000, 20):
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        hit += len({r["id"] for r in got if r["query_id"] == i} & set(np.argsort(-s)[:10].tolist()))
    assert len(got) == 1500 and hit / 1500 >= 0.9


URLS = {
    "HTTP://Blog.Example.ORG/es/1?x=1#y": ("blog.example.org", "/es/1", "example.org/es/", "block"),
    "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
    "https://example.org/en/27": ("example.org", "/en/27", "org/", "allow"),
    "https://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
    "https://x.com/de/": ("x.com", "/de/", "com/de/", "block"), "https://x.com/fr/a": ("x.com", "/fr/a", "com/fr/", "allow"),
    "https://org": ("org", "", None, "allow"), "no host": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    "a://É.Org?x=://b/c": ("É.org", "", None, "allow"), "x://y://z/w": ("y:", "//z/w", None, "allow"),
}


def test_rules(spark):
    from shelfstar.llm.queries import RULES
    rows = [(i, u, None, "clash") for i, u in enumerate(URLS)] * 2
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, rule string"), RULES).collect()
    assert len(got) == len(rows)
    want = list(URLS.values())
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == want[r["page_id"]][:3]
        if r["rule"]:
            assert r["verdict"] == want[r["page_id"]][3]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_trust_and_distrust_follow_links(spark):
    rules = [Rule("allow", "good.net"), Rule("block", "bad.net")]
    link = '<a HREF = "https://{}/x">'
    pages = [(1, "http://good.net/", link.format("Friend.net")), (2, "http://friend.net/", None), (3, "http://bad.net/", ""),
             (4, "http://spam.net/", link.format("bad.net") * 3), (5, "http://farm.net/", link.format("spam.net") + "<a href='/own'>"), (6, "http://alone.net/", "")]
    got = {r["host"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert {h: r["verdict"] for h, r in got.items()} == {"good.net": "allow", "friend.net": "allow", "bad.net": "block", "spam.net": "block",
                                                         "farm.net": "block", "alone.net": "allow"}
    assert got["friend.net"]["trust"] == pytest.approx(0.15 * 0.85) and got["farm.net"]["distrust"] == pytest.approx(0.15 * 0.85**2)


def test_distrust_reaches_the_end_of_a_long_chain_as_in_the_check(spark, tmp_path):
    """Up to fifteen links from a blocked page, without a limit on rounds."""
    import duckdb

    from shelfstar.llm.queries import CHECKS, RULES
    link = '<a href="https://{}/x">'
    pages = [(0, "http://example.org/es/1", "")] + [(i, f"http://h{i}.net/", link.format(f"h{i - 1}.net" if i > 1 else "example.org")) for i in range(1, 16)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    want = {r[0]: r[4] for r in con.execute(CHECKS["op8_url_trust"]).fetchall()}
    got = {r["page_id"]: r for r in url_filter.judge(df, RULES).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == want and set(want.values()) == {"block"}
    assert got[15]["distrust"] == pytest.approx(0.15 * 0.85 ** 15)


def test_propagation_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    edges = [(f"h{a}", f"h{b}", float(w)) for a, b, w in rng.integers(0, 12, (40, 3)) if a != b]
    seeds = [("h0", 0.5, 0.0), ("h1", 0.5, 0.25), ("h2", 0.0, 0.75)]
    df = url_filter.propagate(spark.createDataFrame(seeds, "host string, s_trust double, s_distrust double"),
                              spark.createDataFrame([(a, b, w + 1) for a, b, w in edges], "src string, dst string, weight double"), 5, 0.85)
    m = np.zeros((12, 12))
    for a, b, w in edges:
        m[int(a[1:]), int(b[1:])] += w + 1
    s = np.zeros((2, 12))
    for h, t, d in seeds:
        s[:, int(h[1:])] = t, d
    t, d = 0.15 * s[0], 0.15 * s[1]
    out, back = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-9), m / np.maximum(m.sum(axis=0, keepdims=True), 1e-9)
    for _ in range(5):
        t, d = 0.15 * s[0] + 0.85 * t @ out, 0.15 * s[1] + 0.85 * back @ d
    for r in df.collect():
        assert r["trust"] == pytest.approx(t[int(r["host"][1:])]) and r["distrust"] == pytest.approx(d[int(r["host"][1:])])
