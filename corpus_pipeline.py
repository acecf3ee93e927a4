"""A corpus pipeline of five operators; every stage works on all that the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the
columns of ``documents``.  Each result is written as Parquet to the shared folder and read
again as the next stage's input.  SQL can't express the stages of the classifier and of packing, so there is
no ``ORACLE_SQL``; tests hold the pipeline against brute force.

Defined cases: as the operators define nulls, empty and very long texts, ties and repeated rows; a row
with a null text is rejected by the first stage; an empty table passes all stages as an empty one;
extra columns are carried through the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumiflow.llm.decontam import without_contaminated
from lumiflow.llm.dedup import without_near_duplicates
from lumiflow.llm.packing import pack_documents
from lumiflow.llm.quality_lm import without_unlikely
from lumiflow.llm.quality_rules import without_low_quality
from lumiflow.llm.shared import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_unlikely(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_low_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
