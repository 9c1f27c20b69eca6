"""From raw documents to token ids: rules, near duplicates, test items, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it
returns is written as Parquet and read again as the docs of the next one. All stages but the last return
the columns of `docs`. Edge cases are those of the operators (see their modules): null and empty texts
fail the first stage's word rule; repeated rows are one document after the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.llm import sentencepieces, stages
from docsieve.session import scratch_table


#: Rows of an Arrow batch, and of a batch of Spark's Parquet reader: batches of long texts stay small.
BATCH_ROWS, READ_ROWS = 250, 512


def small_batches(spark: SparkSession) -> None:
    """Set for the session, because a stage's result is computed when its caller writes it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep (operator 7)."""
    small_batches(spark)
    return stages.quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with links of 80 percent or more (operator 6)."""
    small_batches(spark)
    return stages.unique(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 8)."""
    small_batches(spark)
    return stages.clean_of(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked (operator 5)."""
    small_batches(spark)
    return stages.private(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (operator 3)."""
    small_batches(spark)
    return sentencepieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("pieces", pieces),
]

#: SQL can express neither the signatures, the tagger nor the pieces; the tests compare with plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_table(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
