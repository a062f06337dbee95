"""A corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

Defined results: a null text is scored as empty text, has no duplicates and no benchmark item, and stays null up to the
last stage, which encodes it as empty; rows without doc_id take part in no group of near duplicates and stay; rows with
one doc_id and different texts are rows of their own; rows that repeat stay once, if they have words; columns beside
doc_id, text and n_chars pass through all but the last stage untouched, whatever their names; an empty table of
documents gives an empty result, an empty one of labels accepts every document, one of benchmark removes none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, decontam, minhash, pii, quality
from lattica.llm.common import table, written

#: No SQL says what the classifier and the tokenizer do; the tests do every later stage again in plain Python.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.accepted(docs, labels)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.unique(docs, 80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that reveal it, replaced."""
    return pii.redacted(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and what they decode to."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality_stage), ("MinHash near-dedup", dedup_stage), ("benchmark decontamination", decontamination_stage), ("PII", pii_stage), ("byte-level BPE", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
