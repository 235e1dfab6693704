"""The corpus pipeline: five stages over ``documents``.

Each stage takes all its predecessor kept; its result is written as Parquet to
the shared folder and read again as the next one's input. Stages read the columns
of ``documents`` by name and drop any others, whatever these are called; an
empty table gives an empty result; texts of any length are worked whole. A stage
bounds the session's Arrow batches by bytes (``small_batches``).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontamination, minhash, packing, quality_classifier, secrets
from basketry.llm.common import materialize, small_batches, table
from basketry.llm.queries import token_cache, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def in_small_batches(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)
    return run


@in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject. Learnt from all labels;
    null and empty texts are scored like any other, repeated ids row by row."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model, {c: F.col(c) for c in COLUMNS})
    return scored.filter(F.col("score") >= 0.5).select(*COLUMNS)


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles,
    similarity 0.8): the one with the smallest id, of rows that share it the
    first. Null and empty texts are in no group and stay."""
    found = minhash.near_duplicates(docs, k=5, percent=80, keep=COLUMNS)
    return found.filter("chosen").select(*[F.col(f"keep_{c}").alias(c) for c in COLUMNS])


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null and empty texts
    stay; rows with equal texts all go or all stay."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


@in_small_batches
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a marker unless the value is a
    widely copied example. Null texts become empty ones; every row stays."""
    return secrets.redacted(docs, keep=COLUMNS).select(*COLUMNS)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as ranges of their texts, in sequences of the
    permitted numbers of tokens. A null or empty text is one empty piece; a text
    longer than the largest sequence comes in several."""
    return packing.pack_tokens(docs, tokenizer(), token_cache(spark, sf_dir))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("redact_secrets", redact_secrets), ("pack", pack)]

#: Training, sketches and packing are not SQL: tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
