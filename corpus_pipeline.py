"""A corpus pipeline of five stages, each by one of the operators in tessera.llm.

Each stage is written as Parquet in the shared folder and read again by the next.  All but the last
return the columns of documents; the last adds what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, nearcopies, pii, quality
from tessera.plans.shared import discard, materialise, scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return nearcopies.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each span of personal data replaced by its kind; n_chars follows the text."""
    found = pii.redact(docs)
    return found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with the words it takes of each: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES = [("quality classifier", keep_quality), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_benchmark), ("PII", hide_personal_data), ("mixing sources", mix_sources)]

#: The classifier is trained and the embedding walks at random: not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the documents that came through all stages.  What a stage wrote is deleted once the next has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch() as steps:
            done = steps.keep(materialise(stage(spark, docs, sf_dir), f"stage{k}"))
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
