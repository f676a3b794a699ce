"""The corpus pipeline: quality rules, near-duplicates, secrets, the source mix and token ids.

Every stage takes (spark, docs, sf_dir) and returns documents; its result is written and read
again as the input of the next one.  The last stage returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemeld.llm import bpe, mixing, quality, secrets, simhash
from tablemeld.llm.common import materialize, table
from tablemeld.llm.queries import bpe_vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (five words, 0.8): the one with the smallest id."""
    return simhash.keep_one(docs, simhash.cluster_similar(docs))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; ``n_chars`` is counted again where the text changed."""
    scanned = secrets.scan_secrets(docs)
    found = F.size("secrets") > 0
    clean = scanned.withColumn("text", secrets.redact(F.col("text"), F.col("secrets")))
    return clean.withColumn("n_chars", F.when(found, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of each document of the mix."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe_vocabulary(spark))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", hide_secrets),
    ("source mix", mix_sources),
    ("BPE encoding", token_ids),
]

#: Certified cutoffs, fingerprints, random rounding and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
