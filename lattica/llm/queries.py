"""The corpus operators as queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import oracles
from lattica.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.langid import identified

    return identified(table(spark, sf_dir, "documents"))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm.bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


@query
def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.pll import scored

    return scored(table(spark, sf_dir, "documents"))


@query
def op9_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.quality import scored

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return scored(table(spark, sf_dir, "documents"), labels)


@query
def op2_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


ORACLE_SQL["op2_norm_bucket_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op10_minhash_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.minhash import linked

    return linked(table(spark, sf_dir, "documents"), 85)


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.suffix import deduplicated

    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")


@query
def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


@query
def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.licenses import scanned

    return scanned(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.conversations import damaged, repaired

    out = repaired(damaged(table(spark, sf_dir, "conversations")))
    return out.withColumn("repaired_sha256", F.sha2(F.col("repaired").cast("binary"), 256)).drop("repaired")


ORACLE_SQL["op11_conversation_repair"] = oracles.REPAIR


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.resample import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op12_importance_resampling"] = oracles.RESAMPLING


@query
def op13_toxicity_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.toxic import scored

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return scored(table(spark, sf_dir, "documents"), labels)
