"""From raw documents to a deduplicated, mixed and tokenised corpus.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. ``run`` applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstar.llm import bpe, mixing, quality_rules, simhash, suffix_dedup
from shelfstar.llm.common import cut, table
from shelfstar.llm.queries import LIMIT, WEIGHTS, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the newest policy rejects."""
    return quality_rules.apply_policy(docs, quality_rules.POLICIES["v1"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints over four-word shingles are linked by four or fewer differing bits."""
    return simhash.keep_one(docs, k=4, d=4)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that also start elsewhere; documents of which nothing is left go."""
    kept = suffix_dedup.remove(docs, suffix_dedup.Params(length=200))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).where(F.length(F.trim("text")) > 0)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mix(docs, WEIGHTS, LIMIT)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, token ids, their number, and the text decoded from them in place of the text."""
    coded = bpe.encode(docs, tokenizer_file(), decoded="text")
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "n_tokens")]
    return coded.select(*names, "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("source_mix", source_mix), ("tokens", tokens)]

#: The mix draws by hashes and the tokens need a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
