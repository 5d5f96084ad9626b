"""Review text queries R01-R16."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstar.functions.exprs import half_up
from shelfstar.functions.exprs import half_up_sql as r
from shelfstar.operators import text as ops
from shelfstar.plans.ctes import TABLES, pick
from shelfstar.plans.inventory import cols
from shelfstar.plans.metric_views import count_if
from shelfstar.plans.registry import query, report
from shelfstar.plans.report import BASE, Report
from shelfstar.star import Star

_TAGS = ", ".join("(" + " or ".join(f"contains(lower(text), '{w}')" for w in words) + f") as {n}" for n, words in ops.TOPICS.items())
_RATING = "case when quality is null then 4 when quality = 1 and toxic = 0 then 5 when quality = 1 then 3 when toxic = 0 then 2 else 1 end"
TABLES["review_0"] = f"""
    select *, {_RATING} as rating, {_TAGS}, len(regexp_extract_all(text, '\\S+')) as word_count
    from documents left join labels using (doc_id)"""
TABLES["reviews"] = f"""
    select 'REV_' || doc_id as review_id, doc_id, doc_id as customer_key, r.product_key, cast((select d from horizon) - cast(doc_id % 365 as int) as date) as review_date, rating,
      review_type, text, verified_purchase, helpful_votes, source as source_channel, lang, {', '.join(ops.TOPICS)}, word_count, (rating - 3) / 2e0 as sentiment_score,
      category_level_1 as product_category, brand as product_brand, segment as customer_segment
    from (select *, case when doc_id % 5 <> 0 then doc_id * 7 % (select greatest(1, count(*)) from part) end as product_key,
            case doc_id % 5 when 0 then 'purchase_experience' when 1 then 'return_feedback' else 'product_review' end as review_type, doc_id % 10 <> 0 as verified_purchase,
            case when rating in (1, 5) then doc_id % 51 else doc_id % 21 end + least(10, length(text) // 100) as helpful_votes from review_0) r
    left join product_d p on p.product_key = r.product_key left join customer_d c on c.customer_key = doc_id"""
BASE["reviews"] = lambda star, _: ops.reviews(star)
BASE["documents"] = lambda star, _: star.raw("documents")


@query("R01_topic_tags", f"select doc_id, rating, {', '.join(ops.TOPICS)}, word_count, (rating - 3) / 2e0 as sentiment_score from review_0")
def topic_tags(star: Star) -> DataFrame:
    return ops.reviews(star).select("doc_id", "rating", *ops.TOPICS, "word_count", "sentiment_score")


def _normal(value: str, words: list[str], default: str, partial: bool = False) -> str:
    exact = " ".join(f"when lower({value}) = '{w}' then '{w}'" for w in words)
    part = " ".join(f"when contains(lower({value}), '{w}') or contains('{w}', lower({value})) then '{w}'" for w in words) if partial else ""
    return f"(case {exact} {part} else '{default}' end)"


_SEASON = ("(case when substr(upper(season_raw), 1, 2) in ('SS', 'FW', 'AW') and length(season_raw) >= 2 then substr(upper(season_raw), 1, 2) "
           "when contains(upper(season_raw), 'CORE') then 'CORE' else 'default' end)")
_NORMAL = f"""(select *, {_normal('material_primary', ops.MATERIALS, 'default', True)} as material_key, {_normal('category_raw', ops.CATEGORY_KEYS, 'accessories')} as category_key,
      {_normal('price_tier', ops.PRICE_TIERS, 'default')} as tier_key, {_SEASON} as season_key
    from (select product_key, brand, price_tier, {pick(ops.RAW_MATERIALS, '(product_key % 11)')} as material_primary, {pick(ops.RAW_CATEGORIES, '(product_key % 4)')} as category_raw,
            {pick(ops.RAW_SEASONS, '(product_key % 6)')} as season_raw from product_d) p)"""


@query("R02_normalised_attributes", f"select * from {_NORMAL} t")
def normalised(star: Star) -> DataFrame:
    return ops.normalised_products(star)


@query("R02_unexpected_values", f"""
    select 'material' as field, material_primary as value, count(*) as products from {_NORMAL} t where material_key = 'default' group by 1, 2
    union all select 'category', category_raw, count(*) from {_NORMAL} t where category_raw not in ('apparel', 'footwear', 'accessories') group by 1, 2
    union all select 'season', season_raw, count(*) from {_NORMAL} t where season_key = 'default' group by 1, 2""")
def unexpected(star: Star) -> DataFrame:
    return ops.unexpected_values(ops.normalised_products(star))


@query("R03_helpful_votes", "select doc_id, helpful_votes, least(10, length(text) // 100) as length_bonus from reviews")
def helpful(star: Star) -> DataFrame:
    return ops.reviews(star).select("doc_id", "helpful_votes", ops.length_bonus(F.length("text")).alias("length_bonus"))


AVG_RATING = {"review_count": "count(*)", "avg_rating": r("avg(rating)", 2)}
AVG_MOOD = r("avg(sentiment_score)", 2)
report("R04_by_type", Report("reviews", cols("review_type"), AVG_RATING, order="review_count desc, review_type"))


@query("R04_by_rating", f"select rating, count(*) as count, {r('count(*) * 1e2 / sum(count(*)) over ()', 1)} as pct from reviews group by 1")
def by_rating(star: Star) -> DataFrame:
    counts = ops.reviews(star).groupBy("rating").agg(F.count("*").alias("count"))
    total = star.raw("documents").count()
    return counts.withColumn("pct", half_up(F.col("count") * 100.0 / F.lit(total), 1)).orderBy(F.desc("rating"))


report("R04_by_segment", Report("reviews", cols("customer_segment"), {**AVG_RATING, "avg_sentiment": AVG_MOOD}, "customer_segment is not null"))
report("R04_by_category", Report("reviews", {"category_level_1": "product_category"}, AVG_RATING, "product_category is not null"))
report("R04_by_brand", Report("reviews", {"brand": "coalesce(product_brand, 'N/A - Purchase Experience')"}, AVG_RATING))
report("R04_topic_totals", Report("reviews", {}, {
    **{n: count_if(n) for n in ops.TOPICS}, "avg_word_count": r("avg(word_count)", 1), "avg_sentiment": AVG_MOOD}))
report("R04_sentiment_by_rating", Report("reviews", cols("rating"), {
    "count": "count(*)", "avg_sentiment": AVG_MOOD, "min_sentiment": "min(sentiment_score)", "max_sentiment": "max(sentiment_score)",
    "avg_words": r("avg(word_count)", 0)}))
report("R04_low_rated", Report("reviews", {
    **cols("review_id", "rating", "review_type"), "review_excerpt": "substring(text, 1, 150)", "category_level_1": "product_category", "doc_id": "doc_id"}, {},
    "rating <= 2", order="doc_id", limit=5))


def _distribution(key: str, expected: dict, points: int, kind: str) -> str:
    rows = ", ".join(f"({k!r}, {v}e0)" for k, v in expected.items())
    share = r("coalesce(n, 0) * 1e2 / (select count(*) from reviews)", 1)
    exp = "coalesce(expected, 0e0) * 1e2"
    return f"""select coalesce(w.k, a.k) as {key}, coalesce(n, 0) as count, {share} as actual_pct, {exp} as expected_pct, abs({share} - {exp}) < {points} as within_tolerance,
        case when expected is null then 'UNEXPECTED' when n is null then 'MISSING' else 'PRESENT' end as status
      from (select cast(k as {kind}) as k, expected from (values {rows}) v(k, expected)) w full outer join (select {key} as k, count(*) as n from reviews group by 1) a on w.k = a.k"""


@query("R05_type_distribution", _distribution("review_type", ops.REVIEW_TYPES, 2, "varchar"))
def type_distribution(star: Star) -> DataFrame:
    return ops.compare_distribution(ops.reviews(star), "review_type", ops.REVIEW_TYPES, 2.0)


@query("R05_rating_distribution", _distribution("rating", ops.RATINGS, 10, "int"))
def rating_distribution(star: Star) -> DataFrame:
    return ops.compare_distribution(ops.reviews(star), "rating", ops.RATINGS, 10.0)


EXPECTED_CATEGORIES = {"SMALL": 0.2, "MEDIUM": 0.2, "LARGE": 0.2, "PROMO": 0.2, "FOOTWEAR": 0.2}


@query("R05_missing_categories", f"select * from ({_distribution('product_category', EXPECTED_CATEGORIES, 10, 'varchar')}) t where status <> 'PRESENT'")
def missing_categories(star: Star) -> DataFrame:
    return ops.compare_distribution(ops.reviews(star), "product_category", EXPECTED_CATEGORIES, 10.0).where("status <> 'PRESENT'")


report("R06_date_coverage", Report("reviews", {}, {
    "earliest_review": "min(review_date)", "latest_review": "max(review_date)", "unique_dates": "count(distinct review_date)"},
    post={"days_covered": "DAYS(latest_review, earliest_review)"}))
report("R06_quality_summary", Report("reviews", {}, {
    "null_review_ids": count_if("review_id is null"), "null_customer_keys": count_if("customer_key is null"),
    "empty_reviews": count_if("text is null or length(text) = 0"), "invalid_ratings": count_if("rating is null or rating < 1 or rating > 5"),
    "unique_customers": "count(distinct customer_key)", "unique_products": "count(distinct product_key)", "avg_word_count": r("avg(word_count)", 1),
    "min_word_count": "min(word_count)", "max_word_count": "max(word_count)"}))
report("R06_newest_reviews", Report("reviews", {
    **cols("review_id", "rating", "review_type", "customer_segment", "product_category", "product_brand", "sentiment_score", "word_count", "review_date", "doc_id"),
    "review_preview": "substring(text, 1, 200)"}, {}, order="review_date desc, doc_id", limit=10))


@query("R07_length_profile", f"""
    select count(*) as total_documents, min(n) as min_chars, max(n) as max_chars, {r('avg(n)', 0)} as avg_chars, quantile_cont(n, 0.25) as p25_chars,
      quantile_cont(n, 0.5) as median_chars, quantile_cont(n, 0.75) as p75_chars, quantile_cont(n, 0.9) as p90_chars, quantile_cont(n, 0.95) as p95_chars,
      quantile_cont(n, 0.99) as p99_chars from (select length(text) as n from documents where text is not null) t""")
def length_profile(star: Star) -> DataFrame:
    return ops.length_profile(star.raw("documents"))


_TOK = f"""select count(*) as total_docs, min(t) as min_tokens, max(t) as max_tokens, {r('avg(t)', 0)} as avg_tokens,
      count(*) filter (where t > 512) as exceeds_max, count(*) filter (where t > 400) as exceeds_safe, quantile_cont(t, 0.5) as median_tokens,
      quantile_cont(t, 0.9) as p90_tokens, quantile_cont(t, 0.95) as p95_tokens, quantile_cont(t, 0.99) as p99_tokens
    from (select cast(floor(length(text) / 4e0 + 5e-1) as bigint) as t from documents where text is not null) t"""


@query("R08_token_profile", _TOK)
def token_profile(star: Star) -> DataFrame:
    return ops.token_profile(star.raw("documents"))


_LEN = "length(text) / 4e0"
BUCKETS = ["0-50", "50-100", "100-150", "150-200", "200-256", "256-400 (SAFE)", "400-512 (CAUTION)", "512+ (TRUNCATED)"]
_BUCKET = "case " + " ".join(f"when {_LEN} < {top} then '{b}'" for b, top in zip(BUCKETS, (50, 100, 150, 200, 256, 400, 512))) + f" else '{BUCKETS[-1]}' end"
report("R09_token_histogram", Report("documents", {"token_bucket": _BUCKET}, {"doc_count": "count(*)"}, "text is not null",
       post={"o": "case token_bucket " + " ".join(f"when '{b}' then {i}" for i, b in enumerate(BUCKETS)) + " end"}, order="o",
       keep=["token_bucket", "doc_count"]))


@query("R10_embed_or_chunk", f"select {ops.DECISION} as strategy, {ops.CONFIDENCE} as confidence, exceeds_max * 1e2 / total_docs as truncation_rate, max_tokens, p95_tokens from ({_TOK}) t")
def embed_or_chunk(star: Star) -> DataFrame:
    return ops.token_profile(star.raw("documents")).selectExpr(
        f"{ops.DECISION} as strategy", f"{ops.CONFIDENCE} as confidence", "exceeds_max * 1e2 / total_docs as truncation_rate", "max_tokens", "p95_tokens")


report("R11_longest_documents", Report("documents", {
    "doc_id": "doc_id", "char_count": "length(text)", "est_tokens": "cast(floor(length(text) / 4e0 + 5e-1) as bigint)", "preview": "substring(text, 1, 100)",
    "tail_preview": "right(text, 100)"}, {}, "text is not null", order="char_count desc, doc_id", limit=5))


@query("R12_chunks", r"""
    with recursive step as (
      select doc_id, 0 as s, 0 as e, -1 as i from documents where length(text) > 0
      union all
      select doc_id, nxt, case when raw >= n then raw when raw = n - 1 and substr(text, n, 1) in ('.', '!', '?') then n
          when regexp_matches(rev, ' [.!?]') then raw - 320 + length(w) - length(regexp_extract(rev, '(?s)^(.*?) [.!?]', 1)) - 1 + 1 else raw end, i + 1
      from (select *, reverse(w) as rev from (select doc_id, text, length(text) as n, i, nxt, nxt + 1600 as raw, substr(text, nxt + 1600 - 318, 321) as w
            from (select doc_id, i, case when i = -1 then 0 else e - 200 end as nxt from step) p join documents using (doc_id)) a) b
      where nxt < n)
    select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as chunk_index, s as char_start, chunk_text
    from (select doc_id, i, s, regexp_replace(substr(text, s + 1, e - s), '^\s+|\s+$', '', 'g') as chunk_text from step join documents using (doc_id) where i >= 0) t
    where chunk_text <> ''
    union all select doc_id, 0, 0, '' from documents where coalesce(text, '') = ''""")
def chunks(star: Star) -> DataFrame:
    return ops.chunks(star.raw("documents"))


_ADVISED = ["review_id", "doc_id", "customer_key", "product_key", "rating", "review_type", "verified_purchase", "helpful_votes", "source_channel", "lang", *ops.TOPICS,
            "word_count", "sentiment_score", "product_category", "product_brand", "customer_segment", "text"]
_CARD = "(" + " union all ".join(
    f"select '{c}' as column_name, count(distinct {c}) as distinct_count, {str(c == 'text').lower()} as is_text, count(*) as total_rows from reviews" for c in _ADVISED) + ")"


@query("R13_cardinality_advisor", f"select column_name, distinct_count, distinct_count / total_rows as cardinality_ratio, {ops.GRADE} as recommendation from {_CARD} t")
def cardinality(star: Star) -> DataFrame:
    return ops.cardinality(ops.reviews(star).select(*_ADVISED))


_PICKED = f"""(select column_name from (select *, {ops.GRADE} as g from {_CARD} t) u where g in ('EXCELLENT', 'GOOD') qualify g = 'EXCELLENT' or
    row_number() over (order by g, distinct_count, column_name) <= greatest(8, count(*) filter (where g = 'EXCELLENT') over ()))"""


@query("R14_filter_value_distribution", f"""
    select column_name, value, n as count, {r('n * 1e2 / total', 1)} as pct, rank from (
      select *, sum(n) over (partition by column_name) as total, row_number() over (partition by column_name order by n desc, value asc nulls first) as rank
      from ({' union all '.join(f"select '{c}' as column_name, cast({c} as varchar) as value, count(*) as n from reviews group by 2" for c in _ADVISED if c != 'text')}) v
      where column_name in {_PICKED}) w where rank <= 10""")
def filter_values(star: Star) -> DataFrame:
    base = ops.reviews(star).select(*_ADVISED)
    return ops.value_distribution(base, ops.filter_columns(base, ops.cardinality(base)))


@query("R15_source_check", "select count(*) as row_count, count(*) - count(distinct doc_id) as duplicate_keys, 'store_id' as missing_columns, false as is_ready from documents")
def source_check(star: Star) -> DataFrame:
    return ops.source_check(star.raw("documents"), "doc_id", "text", ["lang", "source", "store_id"])


def exemplars(star: Star) -> DataFrame:
    """One query per label: its first vector."""
    return star.raw("embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(
        F.col("label").cast("long").alias("query_id"), "embedding")


def _knn(where: str) -> str:
    return f"""(select query_id, vec_id, label, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
        select q.label as query_id, v.vec_id, v.label, list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[])) as score
        from embeddings v, (select label, arg_min(embedding, vec_id) as embedding from embeddings group by 1) q where {where}) t)"""


def _result(df: DataFrame) -> DataFrame:
    return df.withColumn("score", half_up(F.col("score"), 6))


@query("R16_vector_top_k", f"select query_id, vec_id, rank, {r('score', 6)} as score from {_knn('true')} k where rank <= 10")
def vector_top_k(star: Star) -> DataFrame:
    return _result(ops.search(star.raw("embeddings"), exemplars(star), 10))


@query("R16_vector_top_k_equal_filter", f"select query_id, vec_id, rank, {r('score', 6)} as score from {_knn('v.label = 3')} k where rank <= 10")
def vector_equal(star: Star) -> DataFrame:
    return _result(ops.search(star.raw("embeddings"), exemplars(star), 10, "label = 3"))


@query("R16_vector_top_k_in_filter_joined", f"select query_id, vec_id, rank, label, {r('score', 6)} as score from {_knn('v.label in (1, 4, 7)')} k where rank <= 5")
def vector_in(star: Star) -> DataFrame:
    """Filtered by a list of values and joined back to the source for its other columns."""
    hits = _result(ops.search(star.raw("embeddings"), exemplars(star), 5, F.col("label").isin(1, 4, 7)))
    return star.raw("embeddings").select("vec_id", "label").join(hits, "vec_id")
