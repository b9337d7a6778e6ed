"""The corpus pipeline: documents through five stages, each over all that the one before kept.

1. language_id: documents without a letter, or of an ambiguous language, go (if no language is known at all, only the former).
2. minhash_near_dedup: of each group of near-duplicates one row stays, of the least id.
3. secret_scans: every secret found is replaced by [REDACTED].
4. mixing: documents are selected to the target weights of domains and languages.
5. sentencepiece: the token ids of each selected document.

The first four return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from longpath.llm import langid, minhash, mixing, pieces, secrets
from longpath.llm.common import stored
from longpath.llm.queries import SEED, WEIGHTS, domain_of

SHARE, EPOCHS = (3, 5), 1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.fit(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, domain_of(), WEIGHTS, SHARE, EPOCHS, SEED)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mixing", mixing_to_weights),
    ("sentencepiece", sentencepiece),
]

# Classifiers, hash minima and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
