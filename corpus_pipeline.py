"""Training-data pipeline over ``documents``: toxic texts go, then texts of bad
quality, then near copies but one; secrets are masked and the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept.  All but the last return the columns of ``docs``.  The stages fit
classifiers, so SQL can't express them; the tests check each against its
brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentscope.llm import jaccard_join, packing, quality_rules, secrets, toxicity
from talentscope.llm.common import documents, labels, saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    return toxicity.clean(docs, labels(spark, sf_dir))


def drop_bad_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality_rules.good(docs, labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, ``n_chars`` follows; no document goes."""
    out = secrets.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, neighbours on the curve together."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_bad_quality), ("jaccard_join", drop_near_copies), ("secret_scan", mask_secrets), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
