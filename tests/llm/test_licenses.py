import pytest
from pyspark.sql import functions as F

from shelfstar.llm import licenses
from tests.llm.conftest import sentence


@pytest.fixture(scope="module")
def model(spark):
    import random
    rng = random.Random(1)
    prose = spark.createDataFrame([(f"{sentence(rng, 12)} the terms of the public under a version of this work {i}",) for i in range(300)], "text string")
    return licenses.fit(spark, prose)


def scan(spark, model, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses int, ROW string")
    return licenses.scan(df, model).collect()


def test_held_out_wordings(spark, model, rng):
    """Every template, inside prose it was not fitted on, is named and confirmed; prose alone never is."""
    rows, want = [], {}
    for f, texts in licenses.TEMPLATES.items():
        for t in texts:
            want[len(rows)] = f
            rows.append((len(rows), f"{sentence(rng, 30)}\n{sentence(rng, 4)} {t.upper()} {sentence(rng, 5)}\n\n{sentence(rng, 9)}", 0, ""))
    for _ in range(200):
        rows.append((len(rows), f"{sentence(rng, 20)} under the terms of a version of this {sentence(rng, 3)}\nall of the work is free", 0, ""))
    got = {r["doc_id"]: r for r in scan(spark, model, rows)}
    assert sum(got[i]["licenses"] == [f] for i, f in want.items()) >= 0.95 * len(want)
    assert not any(r["licenses"] for i, r in got.items() if i not in want)
    assert got[0]["n_paragraphs"] == 3 and got[0]["n_confirmed"] == 1


def test_edge_rows(spark, model):
    mit = "Released under the MIT License."
    rows = [(1, None, 1, None), (2, "", 1, "x"), (3, "\n \n", 1, "x"), (4, mit, 1, "x"), (4, mit, 1, "x"), (None, f"{mit}\n{mit}\nLicensed under CC BY-NC 4.0.", 1, "x"),
            (5, "word " * 100_000, 1, "x"), (6, "Released under some other License.", 1, "x")]
    got = sorted(scan(spark, model, rows), key=lambda r: (r["doc_id"] or 0, r["n_paragraphs"]))
    assert [(r["doc_id"], r["n_paragraphs"], r["licenses"], r["n_confirmed"]) for r in got] == [
        (None, 3, ["CC-BY-NC-4.0", "MIT"], 3), (1, 0, [], 0), (2, 0, [], 0), (3, 0, [], 0), (4, 1, ["MIT"], 1), (4, 1, ["MIT"], 1), (5, 1, [], 0), (6, 1, [], 0)]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_every_planted_line_is_found(spark):
    """On the small documents, whole licence lines are found and nothing else is."""
    from shelfstar.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) for r in QUERIES["op6_license_scan"](spark, sf).collect()}
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        want = {f for f, ts in licenses.TEMPLATES.items() for t in ts if any(t.lower() in line.lower() for line in r["text"].split("\n"))}
        assert got[r["doc_id"]] == want, r["doc_id"]


def test_plan_has_no_python(spark, model):
    df = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), model)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
