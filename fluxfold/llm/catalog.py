"""The registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from fluxfold.llm import sql
from fluxfold.llm.common import read_table
from fluxfold.llm.decontamination import contamination
from fluxfold.llm.html_text import extract_text
from fluxfold.llm.jaccard_join import jaccard_groups
from fluxfold.llm.licenses import scan_licences
from fluxfold.llm.line_dedup import line_report
from fluxfold.llm.near_dedup import near_duplicates
from fluxfold.llm.packing import pack_documents
from fluxfold.llm.phrases import collocations
from fluxfold.llm.quality_rules import quality_verdicts
from fluxfold.llm.spelling import spelling_variants
from fluxfold.llm.substring_dedup import substring_dedup
from fluxfold.llm.token_counts import count_tokens
from fluxfold.llm.token_files import token_file_digests

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=4)


def op2_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(read_table(spark, sf_dir, "documents"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents"), size=4, percent=85)


def op12_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op13_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_token_binary_output,
        op3_quality_rules,
        op4_line_dedup,
        op5_token_counts,
        op6_best_fit_packing,
        op7_license_scans,
        op8_html_extraction,
        op9_suffix_array_dedup,
        op10_benchmark_decontamination,
        op11_ngram_jaccard_join,
        op12_phrase_collocation_mining,
        op13_spelling_variant_grouping,
    )
}
LLM_QUERIES["pipeline"] = corpus_pipeline.run

LLM_ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": sql.near_sql(),
    "op3_quality_rules": sql.quality_sql(),
    "op4_line_dedup": sql.line_sql(),
    "op9_suffix_array_dedup": sql.substring_sql(),
    "op11_ngram_jaccard_join": sql.join_sql(),
    "op12_phrase_collocation_mining": sql.phrase_sql(),
    "op13_spelling_variant_grouping": sql.spelling_sql(),
}
if corpus_pipeline.ORACLE_SQL:
    LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
