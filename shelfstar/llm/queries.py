"""Registered queries of the operators (production parameters, whole tables) and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstar.llm import ann, bpe, chat, divergence, licenses, mixing, ngram_lm, qda, quality_rules, rns_negatives, simhash, suffix_dedup, url_filter
from shelfstar.llm.common import table

QUERIES: dict = {}
CHECKS: dict[str, str] = {}

#: Weights of the mix, repeating over the sources, and how often a document may be taken.
WEIGHTS, LIMIT = [1.0, 2.0, 3.0], 3.0
#: The conversation that tests the template's escapes.
TRICKY = "\\### Assistant: </turn> ok"


def query(name: str, check: str | None = None):
    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn
    return wrap


def sha256(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


@query("op1_learned_partitions")
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose vec_id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 20 == 0).alias("asks"))
    return ann.nearest(rows, 20).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of it without repeated strings of 200 bytes."""
    marked, spans = suffix_dedup.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), suffix_dedup.Params(length=200))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    gone = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return marked.select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size(spans).cast("long").alias("n_spans"),
                         F.sha2(suffix_dedup.remaining(data, F.col(spans)), 256).alias("kept_sha256"))


@query("op3_source_mix")
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    got = mixing.plan(table(spark, sf_dir, "documents"), WEIGHTS, LIMIT)
    return got.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op4_tree_bpe")
def op4_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them."""
    path = tokenizer_file()
    got = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="back")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                      sha256(F.col("back")).alias("decoded_sha256"))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint over four-word shingles and its component."""
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, d=4)
    return got.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licence families that its paragraphs state."""
    docs = table(spark, sf_dir, "documents")
    model = licenses.fit(spark, docs.select(F.explode(licenses.paragraphs_of(F.col("text"))).alias("text")))
    return licenses.scan(docs, model).withColumn("licenses", F.array_join("licenses", ","))


@query("op7_stupid_backoff", r"""
WITH w AS (SELECT doc_id, row, unnest(range(1, len(l) + 1)) AS i, l FROM (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS l FROM documents)),
pos AS (SELECT doc_id, row, i, l[i] AS w, CASE WHEN i > 1 THEN l[i - 1] END AS v FROM w),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY w, row) AS c1, count(*) OVER () - count(*) OVER (PARTITION BY row) AS rest,
         CASE WHEN v IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY v, w, row) END AS c2 FROM pos),
with_context AS (SELECT *, lag(c1) OVER (PARTITION BY row ORDER BY i) AS cv FROM counted),
steps AS (
  SELECT *, CASE WHEN c2 > 0 THEN ln(c2 / cv) ELSE ln(CASE WHEN c1 > 0 THEN c1 ELSE 0.4 END / greatest(rest, 1)) + CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END END AS step
  FROM with_context),
sums AS (SELECT row, count(*) AS n_words, sum((c2 > 0)::INT)::BIGINT AS n_known_pairs, sum(step) AS log_score FROM steps GROUP BY row)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_known_pairs, 0) AS n_known_pairs, round(coalesce(log_score, 0), 3) AS log_score
FROM (SELECT doc_id, row_number() OVER () AS row FROM documents) LEFT JOIN sums USING (row)""")
def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the counts of all other documents."""
    got = ngram_lm.scores(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_known_pairs", F.round("log_score", 3).alias("log_score"))


RULES = [url_filter.Rule("allow", "org"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
         url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/")]
#: Rounds of the check: by then damping has brought every change far below the tolerance.
ROUNDS = 120


def _rank_sql(rounds: int, damping: float) -> str:
    """Rounds of trust and distrust, each from the one before."""
    return f"""ranks AS (
  SELECT 0 AS round, host, {1 - damping} * s_trust AS trust, {1 - damping} * s_distrust AS distrust FROM seeds
  UNION ALL
  SELECT r.round + 1, s.host, {1 - damping} * s_trust + {damping} * coalesce(t, 0), {1 - damping} * s_distrust + {damping} * coalesce(d, 0)
  FROM ranks r JOIN seeds s USING (host)
  LEFT JOIN (SELECT dst AS host, sum(weight / leaving * trust) AS t FROM shares JOIN ranks ON src = host GROUP BY dst) a USING (host)
  LEFT JOIN (SELECT src AS host, sum(weight / coming * distrust) AS d FROM shares JOIN ranks ON dst = host GROUP BY src) b USING (host)
  WHERE r.round < {rounds})"""


def _url_sql() -> str:
    rules = ", ".join(f"('{r.name}', '{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    return rf"""
WITH RECURSIVE urls AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(name, h, p, v) AS (VALUES {rules}),
judged AS (
  SELECT page_id, html, host, path, (SELECT max_by(name, length(name)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM urls),
ruled AS (SELECT j.*, v FROM judged j LEFT JOIN rules ON rule = name),
links AS (
  SELECT src, dst, count(*)::DOUBLE AS weight
  FROM (SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1))),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM urls)
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
shares AS (SELECT *, sum(weight) OVER (PARTITION BY src) AS leaving, sum(weight) OVER (PARTITION BY dst) AS coming FROM links),
seeds AS (
  SELECT host, coalesce(good / greatest(sum(good) OVER (), 1), 0) AS s_trust, coalesce(bad / greatest(sum(bad) OVER (), 1), 0) AS s_distrust
  FROM (SELECT host, sum(g) AS good, sum(b) AS bad FROM (
    SELECT host, CASE WHEN v = 'allow' THEN 1.0::DOUBLE ELSE 0 END AS g, CASE WHEN v = 'block' THEN 1.0::DOUBLE ELSE 0 END AS b FROM ruled WHERE host <> ''
    UNION ALL SELECT src, 0, 0 FROM links UNION ALL SELECT dst, 0, 0 FROM links) GROUP BY host)),
{_rank_sql(ROUNDS, 0.85)}
SELECT page_id, r.host, path, rule, coalesce(v, CASE WHEN distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN (SELECT * FROM ranks WHERE round = {ROUNDS}) q ON r.host = q.host"""


@query("op8_url_trust", _url_sql())
def op8_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the rule that fits it and the verdict."""
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def with_tricky(spark: SparkSession, turns: DataFrame) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return turns.select(*extra.columns).unionByName(extra)


@query("op9_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e'), ': ', '\c') AS safe FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe) + 4 + 2 + 9 + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
           WHEN role IS NULL THEN 4 ELSE 5 + length(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), ': ', '\c')) END
       )::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id""")
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    made = chat.format_chats(with_tricky(spark, table(spark, sf_dir, "conversations")))
    back = made.withColumn("turns", chat.read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(said).alias("turns_sha256"),
                       F.length(learned).cast("long").alias("loss_chars"), sha256(learned).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


#: Measurements and verdict of the quality rules, from a table or expression ``{docs}`` with doc_id and text.
QUALITY_SQL = r"""
raw AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM {docs}),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS l FROM raw),
wins AS (SELECT row, unnest(range(1, len(w) - 3)) AS i, w FROM split WHERE len(w) > 5),
named AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS n FROM wins),
hits AS (SELECT row, count(DISTINCT i + j) AS n_repeat_words FROM named, range(0, 5) t(j) WHERE n > 1 GROUP BY row),
lines AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT row, unnest(l) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
measured AS (
  SELECT row, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN hits USING (row) LEFT JOIN lines USING (row)),
quality AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines AS more_failed
  FROM measured)"""


@query("op10_quality_rules", "WITH " + QUALITY_SQL.replace("{docs}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT more_failed AS kept FROM quality""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of every document and the verdict of the newest policy."""
    marked, m, bits = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, newest = quality_rules.POLICIES["base"], quality_rules.POLICIES["v1"]
    return marked.select("doc_id", *[F.col(m)[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                         (~quality_rules.kept(F.col(bits), base)).alias("base_failed"), quality_rules.kept(F.col(bits), newest).alias("kept"))


@query("op11_quality_qda")
def op11_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of label 1 by class densities of its statistics."""
    return qda.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_rns_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id,
       positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""")
def op12_rns_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose vec_id is divisible by 100, for its five best rows of the same label."""
    vec = F.col("vec_id")
    label = F.when(vec % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(vec.alias("id"), label.alias("label"), rns_negatives.integers(F.col("embedding"), 256).alias("vector"),
                                                     (vec % 100 == 0).alias("is_anchor"))
    return rns_negatives.mine(rows)


@query("op13_source_divergence", r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
dense AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, c FROM g JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS p,
         1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER s + 5 * count(*) OVER s) AS q
  FROM dense WINDOW s AS (PARTITION BY lang, source)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""")
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that set each source apart from its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))
