"""Review text: tags, normalised attributes, length profile, chunking, filter advice, vector search."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstar.functions.exprs import half_up
from shelfstar.functions.ranking import exact_percentiles
from shelfstar.star import Star, nth

# Topic words and vocabularies.
TOPICS = {
    "mentions_sizing": ["size", "fit", "tight", "loose", "small", "large", "runs"],
    "mentions_quality": ["quality", "material", "fabric", "cheap", "premium", "well-made", "poorly made"],
    "mentions_delivery": ["shipping", "delivery", "arrived", "package", "tracking"],
    "mentions_price": ["price", "worth", "value", "expensive", "cheap", "cost", "money"],
    "mentions_comfort": ["comfort", "soft", "scratchy", "itchy", "cozy", "breathable"],
    "has_recommendation": ["recommend", "would buy", "will order", "suggest"],
}
MATERIALS = ["cotton", "silk", "leather", "wool", "linen", "synthetic", "denim", "cashmere", "suede", "polyester", "modal"]
CATEGORY_KEYS = ["apparel", "footwear", "accessories"]
PRICE_TIERS = ["luxury", "premium", "mid", "value", "budget"]
SEASON_KEYS = ["SS", "FW", "AW"]
# Raw attribute spellings that the catalogue stands in for.
RAW_MATERIALS = ["cotton", "Organic Cotton", "silk", "Silk Blend", "leather", "Bamboo", "wool", "lin", "denim", "Recycled Polyester", "Tencel"]
RAW_CATEGORIES = ["apparel", "footwear", "accessories", "homeware"]
RAW_SEASONS = ["SS24", "FW24", "AW25", "core-basic", "x", "HOLIDAY"]

REVIEW_TYPES = {"product_review": 0.60, "return_feedback": 0.20, "purchase_experience": 0.20}
RATINGS = {5: 0.45, 4: 0.25, 3: 0.15, 2: 0.10, 1: 0.05}

CHUNK_CHARS, OVERLAP_CHARS, LOOK_BACK = 1600, 200, 0.2
CHARS_PER_TOKEN, MAX_TOKENS, SAFE_TOKENS = 4, 512, 400


def topic_tags(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Topic flags by substring on lower case, and the word count."""
    low = F.lower(F.col(text_col))

    def any_of(words: list[str]) -> Column:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        return hit

    return df.withColumns({**{n: any_of(w) for n, w in TOPICS.items()}, "word_count": F.regexp_count(F.col(text_col), F.lit(r"\S+"))})


def sentiment(rating: Column) -> Column:
    return (rating - 3) / 2.0


def length_bonus(length: Column) -> Column:
    """One helpful vote per 100 characters, at most 10."""
    return F.least(F.lit(10), F.floor(length / 100)).cast("int")


def reviews(star: Star) -> DataFrame:
    """Documents as reviews: rating from the labels, tags from the text, customer and product by key."""
    d, k = star.raw("documents").join(star.raw("labels"), "doc_id", "left"), F.col("doc_id")
    good, toxic = F.col("quality"), F.col("toxic")
    rating = (F.when(good.isNull(), 4).when((good == 1) & (toxic == 0), 5).when(good == 1, 3).when(toxic == 0, 2).otherwise(1))
    kind = F.when(k % 5 == 0, "purchase_experience").when(k % 5 == 1, "return_feedback").otherwise("product_review")
    base = F.when(rating.isin(1, 5), k % 51).otherwise(k % 21)
    r = topic_tags(d).select(
        F.concat(F.lit("REV_"), k.cast("string")).alias("review_id"), k, k.alias("customer_key"),
        F.when(k % 5 != 0, k * 7 % max(1, star.product_count)).alias("product_key"), F.date_sub(F.lit(star.as_of), (k % 365).cast("int")).alias("review_date"),
        rating.alias("rating"), kind.alias("review_type"), "text", (k % 10 != 0).alias("verified_purchase"),
        (base + length_bonus(F.length("text"))).cast("long").alias("helpful_votes"), F.col("source").alias("source_channel"), "lang",
        *TOPICS, "word_count", sentiment(rating).alias("sentiment_score"))
    p = star.product().select("product_key", F.col("category_level_1").alias("product_category"), F.col("brand").alias("product_brand"))
    c = star.customer().select("customer_key", F.col("segment").alias("customer_segment"))
    return r.join(p, "product_key", "left").join(c, "customer_key", "left")


def normalise(value: Column, vocabulary: list[str], default: str, partial: bool = False) -> Column:
    """Exact match on lower case, then the first entry that contains or is contained, else ``default``."""
    low = F.lower(value)
    out = F.coalesce(*[F.when(low == v, v) for v in vocabulary])
    if partial:
        out = F.coalesce(out, *[F.when(low.contains(v) | F.lit(v).contains(low), v) for v in vocabulary])
    return F.coalesce(F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)), out, F.lit(default))


def season_key(code: Column) -> Column:
    up = F.upper(code)
    two = F.when(F.length(code) >= 2, F.substring(up, 1, 2))
    return F.coalesce(*[F.when(two == s, s) for s in SEASON_KEYS], F.when(up.contains("CORE"), "CORE"), F.lit("default"))


def normalised_products(star: Star) -> DataFrame:
    """R02 on the catalogue, with the raw spelling beside each key."""
    k = F.col("product_key")
    p = star.product().select("product_key", "brand", "price_tier", nth(RAW_MATERIALS, k % 11).alias("material_primary"),
                              nth(RAW_CATEGORIES, k % 4).alias("category_raw"), nth(RAW_SEASONS, k % 6).alias("season_raw"))
    return p.select("*", normalise(F.col("material_primary"), MATERIALS, "default", partial=True).alias("material_key"),
                    normalise(F.col("category_raw"), CATEGORY_KEYS, "accessories").alias("category_key"),
                    normalise(F.col("price_tier"), PRICE_TIERS, "default").alias("tier_key"), season_key(F.col("season_raw")).alias("season_key"))


def unexpected_values(normal: DataFrame) -> DataFrame:
    """Values that fell back to a default, with counts."""
    pairs = F.array(
        F.when(F.col("material_key") == "default", F.struct(F.lit("material").alias("field"), F.col("material_primary").alias("value"))),
        F.when(~F.lower("category_raw").isin(*CATEGORY_KEYS), F.struct(F.lit("category").alias("field"), F.col("category_raw").alias("value"))),
        F.when(F.col("season_key") == "default", F.struct(F.lit("season").alias("field"), F.col("season_raw").alias("value"))))
    return normal.select(F.inline(F.filter(pairs, lambda x: x.isNotNull()))).groupBy("field", "value").agg(F.count("*").alias("products"))


def compare_distribution(actual: DataFrame, key: str, expected: dict, tolerance_points: float) -> DataFrame:
    """Share per value against the expected share; values on either side are kept."""
    spark = actual.sparkSession
    kind = "int" if isinstance(next(iter(expected)), int) else "string"
    want = F.broadcast(spark.createDataFrame(list(expected.items()), f"{key} {kind}, expected double"))
    counts = actual.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    both = want.join(counts, key, "full").withColumn("total", F.lit(total.first()[0]))
    share = half_up(F.coalesce("n", F.lit(0)) * 100.0 / F.col("total"), 1)
    exp = F.coalesce("expected", F.lit(0.0)) * 100.0
    return both.select(key, F.coalesce("n", F.lit(0)).alias("count"), share.alias("actual_pct"), exp.alias("expected_pct"),
                       (F.abs(share - exp) < tolerance_points).alias("within_tolerance"),
                       F.when(F.col("expected").isNull(), "UNEXPECTED").when(F.col("n").isNull(), "MISSING").otherwise("PRESENT").alias("status"))


def length_profile(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Character lengths with six exact percentiles."""
    lengths = df.where(F.col(text_col).isNotNull()).select(F.length(text_col).alias("len"))
    points = {"p25_chars": 0.25, "median_chars": 0.5, "p75_chars": 0.75, "p90_chars": 0.9, "p95_chars": 0.95, "p99_chars": 0.99}
    n = F.sum("_n")
    return exact_percentiles(lengths, "len", points, extra={
        "total_documents": n, "min_chars": F.min("len"), "max_chars": F.max("len"),
        "avg_chars": half_up(F.sum(F.col("len") * F.col("_n")) / n, 0)})


def tokens(length: Column) -> Column:
    return F.floor(length / float(CHARS_PER_TOKEN) + 0.5)


def token_profile(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Estimated tokens and how many texts exceed the model's limits."""
    t = df.where(F.col(text_col).isNotNull()).select(tokens(F.length(text_col)).alias("tok"))
    points = {"median_tokens": 0.5, "p90_tokens": 0.9, "p95_tokens": 0.95, "p99_tokens": 0.99}
    n, tok = F.col("_n"), F.col("tok")
    over = lambda limit: F.sum(F.when(tok > limit, n).otherwise(F.lit(0)))
    return exact_percentiles(t, "tok", points, extra={
        "total_docs": F.sum(n), "min_tokens": F.min(tok), "max_tokens": F.max(tok), "avg_tokens": half_up(F.sum(tok * n) / F.sum(n), 0),
        "exceeds_max": over(MAX_TOKENS), "exceeds_safe": over(SAFE_TOKENS)})


DECISION = (f"case when max_tokens <= {MAX_TOKENS} then 'EMBED_FULL_TEXT' when exceeds_max * 1e2 / total_docs < 1 then 'EMBED_FULL_TEXT' "
            "when exceeds_max * 1e2 / total_docs < 5 then 'CONSIDER_CHUNKING' else 'CHUNK_REQUIRED' end")
CONFIDENCE = (f"case when max_tokens <= {SAFE_TOKENS} then 'HIGH' when max_tokens <= {MAX_TOKENS} then 'MEDIUM' "
              "when exceeds_max * 1e2 / total_docs < 5 then 'MEDIUM' else 'HIGH' end")


SENTENCE_END = re.compile(r"[.!?](?= |\Z)")


def sentence_chunks(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, str]]:
    """Start offset and stripped text of overlapping chunks.

    The places where sentences end are listed once. A chunk that cannot hold the rest of the text stops at the last of them that it
    reaches, one character past its size at most, if that lies in its final fifth; else it stops at its size.
    """
    ends = [0, *(m.end() for m in SENTENCE_END.finditer(text))]
    starts, stops = [0], []
    while starts[-1] < len(text):
        full = starts[-1] + size
        nearest = ends[bisect.bisect_right(ends, full + 1) - 1]
        stops.append(nearest if full < len(text) and nearest > full + 1 - math.ceil(size * LOOK_BACK) else full)
        starts.append(stops[-1] - overlap)
    return [(a, piece) for a, b in zip(starts, stops) if (piece := text[a:b].strip())]


def chunks(df: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per chunk of the whole text. Where a chunk starts depends on where the one before it
    ended, so each text is walked once, in Arrow batches; texts are independent rows."""
    if not 0 <= overlap < size * (1 - LOOK_BACK):
        raise ValueError("the overlap must leave room to advance")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, text in zip(pdf[key], pdf[text_col]):
                found = sentence_chunks(text, size, overlap) if text else [(0, "")]
                rows.extend((k, i, s, c) for i, (s, c) in enumerate(found))
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "char_start", "chunk_text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text_col).mapInPandas(run, f"{key} {kind}, chunk_index int, char_start int, chunk_text string")


GRADE = ("case when is_text then 'EMBEDDING' when distinct_count = total_rows then 'AVOID' when distinct_count <= 10 then 'EXCELLENT' "
         "when distinct_count <= 50 then 'GOOD' when distinct_count <= 100 then 'CONSIDER' when distinct_count * 1e0 / total_rows > 0.5e0 then 'AVOID' else 'MAYBE' end")


def cardinality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct values of every column, by 128 bits of hash, graded as filter candidates; an empty table has no columns to grade."""
    def item(c: str) -> Column:
        value = F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b")))
        return F.struct(F.lit(c).alias("column_name"), value.alias("value"))

    seen = df.select(F.inline(F.array(*[item(c) for c in df.columns]))).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    flat = seen.groupBy("column_name").agg(F.count("value").alias("distinct_count"), F.sum("n").alias("total_rows"))
    flat = flat.withColumn("is_text", F.col("column_name") == text_col)
    return flat.select("column_name", "distinct_count", (F.col("distinct_count") / F.col("total_rows")).alias("cardinality_ratio"),
                       F.expr(GRADE).alias("recommendation"))


def filter_columns(df: DataFrame, grades: DataFrame, limit: int = 8) -> list[str]:
    """All excellent columns, then good ones up to ``limit`` (one row per column reaches the driver)."""
    rows = grades.where(F.col("recommendation").isin("EXCELLENT", "GOOD")).orderBy("recommendation", "distinct_count", "column_name").collect()
    best = [r.column_name for r in rows if r.recommendation == "EXCELLENT"]
    return best + [r.column_name for r in rows if r.recommendation == "GOOD"][:max(0, limit - len(best))]


def value_distribution(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """Most frequent values of the candidate columns with their share, in one aggregation."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.count("*").alias("count"))
    w, top = Window.partitionBy("column_name"), Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc_nulls_first("value"))
    return (counts.withColumn("pct", half_up(F.col("count") * 100.0 / F.sum("count").over(w), 1))
            .withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k))


def source_check(df: DataFrame, key: str, text_col: str, filters: list[str]) -> DataFrame:
    """Is the table ready to be indexed?"""
    missing = [c for c in [key, text_col, *filters] if c not in df.columns]
    dup = F.count("*") - F.countDistinct(key) if key in df.columns else F.lit(0)
    return df.agg(F.count("*").alias("row_count"), dup.alias("duplicate_keys")).select(
        "row_count", "duplicate_keys", F.lit(",".join(missing)).alias("missing_columns"),
        ((F.col("row_count") > 0) & F.lit(not missing)).alias("is_ready"))


QUERY_BLOCK, VECTOR_BLOCK, STEP = 1024, 65_536, 8192


def search(vectors: DataFrame, queries: DataFrame, k: int, where: Column | str | None = None, key: str = "vec_id",
           column: str = "embedding") -> DataFrame:
    """K nearest vectors by cosine for each query, exact.

    Queries (query_id, embedding) and vectors are dealt over blocks by hash, of about QUERY_BLOCK and VECTOR_BLOCK
    rows, and every pair of blocks meets in one task: matrix products over STEP vectors at a time, k rows kept per
    query and block. Both tables are scanned once however many queries there are. Filters run before scoring.
    """
    pool = (vectors.where(where) if where is not None else vectors).select(key, column)
    asked = queries.select("query_id", F.col(column).alias("q"))
    nq, nv = -(-max(1, asked.count()) // QUERY_BLOCK), -(-max(1, pool.count()) // VECTOR_BLOCK)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("vb", every(nv))
    right = pool.withColumn("vb", F.pmod(F.xxhash64(key), F.lit(nv)).cast("int")).withColumn("qb", every(nq))
    schema = f"query_id long, {key} long, score double"

    def nearest(ask: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(block):
            return pd.DataFrame({"query_id": [], key: [], "score": []}).astype({"query_id": "int64", key: "int64"})
        q, all_keys, all_vectors = _unit(ask["q"]), block[key].to_numpy("int64"), block[column].to_numpy()
        best_s, best_k = np.zeros((len(q), 0)), np.zeros((len(q), 0), dtype="int64")
        for i in range(0, len(all_keys), STEP):
            names = all_keys[i:i + STEP]
            s = np.concatenate([best_s, q @ _unit(all_vectors[i:i + STEP]).T], axis=1)
            names = np.concatenate([best_k, np.broadcast_to(names, (len(q), len(names)))], axis=1)
            order = np.lexsort((names, -s), axis=1)[:, :k]
            best_s, best_k = np.take_along_axis(s, order, 1), np.take_along_axis(names, order, 1)
        n = best_s.shape[1]
        return pd.DataFrame({"query_id": np.repeat(ask["query_id"].to_numpy("int64"), n), key: best_k.ravel(), "score": best_s.ravel()})

    hits = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(nearest, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(rows) -> np.ndarray:
    e = np.vstack(list(rows)).astype("float64")
    return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
