from pyspark.sql import functions as F

from shelfstar.llm import suffix_dedup
from tests.llm.conftest import sentence


def test_genuine_replacement_characters_stay(spark, rng):
    same = sentence(rng, 60)
    docs = spark.createDataFrame([(1, f"one � é {same} end � 1"), (2, f"two � ñ {same} other")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove(docs, suffix_dedup.Params(length=200)).collect()}
    assert got[1].startswith("one � é") and got[1].endswith("end � 1") and got[2].startswith("two � ñ") and same not in got[1]


def test_spans_grow_to_characters(spark):
    text = "aé漢😀z�"
    size, rows = len(text.encode()), []
    for start in range(size):
        for stop in range(start + 1, size + 1):
            want, at = "", 0
            for c in text:
                n = len(c.encode())
                want += "" if at < stop and at + n > start else c
                at += n
            rows.append((text, start, stop, want))
    data, spans = F.col("text").cast("binary"), F.array(F.struct("start", "stop"))
    df = spark.createDataFrame(rows, "text string, start int, stop int, want string")
    left = suffix_dedup.remaining(data, suffix_dedup.whole_characters(data, spans)).cast("string")
    assert [r["left"] for r in df.select(left.alias("left")).collect()] == [r[3] for r in rows]
