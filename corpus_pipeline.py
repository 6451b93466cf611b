"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Quality rules, near-duplicate removal, benchmark decontamination and secret redaction return the columns of ``documents``; the last
stage returns the texts' tokens. SQL cannot express a tokeniser, so ``ORACLE_SQL`` is None; the tests compare the near-duplicate stage with
a comparison of all pairs, the others with their operators, which have brute-force versions of their own in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.llm import decontamination, quality_rules, secrets, simhash, spm
from pointmill.llm.common import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Bands are learned from the labelled rows that are not held out."""
    return quality_rules.keep_good(docs, bands=quality_rules.fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return secrets.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, how many there are, the original bytes each stands for, and the digest of what the ids decode to."""
    return spm.encode(docs, decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends", "decoded_sha256")


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
