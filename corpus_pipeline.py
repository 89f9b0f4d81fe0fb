"""From documents to packed training sequences: five stages, each a written table.

Stages in order: quality rules (rejected documents go), line dedup (later repeated runs of lines
are cut), near-dedup (one document of each group stays), decontamination (documents with benchmark
passages go), packing (a row per piece). The first four return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxfold.llm.common import keep, read_table
from fluxfold.llm.decontamination import drop_contaminated
from fluxfold.llm.line_dedup import drop_repeated_lines
from fluxfold.llm.near_dedup import drop_near_duplicates
from fluxfold.llm.packing import pack_documents
from fluxfold.llm.quality_rules import quality_filter
from fluxfold.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no tokenizer and no fixed packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
