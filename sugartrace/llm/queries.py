"""The registered queries of this folder: (spark, folder of the tables) to a DataFrame, and SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sugartrace.llm import compact, crf, decontam, fim, graysim, mixing, periodic, pivots, repair, runindex, sql, templates, toxicity
from sugartrace.llm import warc
from sugartrace.llm.common import read


def op1_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leak_rows(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_rows(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op3_run_index_spans(spark: SparkSession, folder: str) -> DataFrame:
    return runindex.span_rows(read(spark, folder, "documents"))


def op4_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.line_rows(read(spark, folder, "documents"))


def op5_compact_passages(spark: SparkSession, folder: str) -> DataFrame:
    return compact.passage_rows(read(spark, folder, "documents"))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_words(read(spark, folder, "documents"))


def op7_line_field_quality(spark: SparkSession, folder: str) -> DataFrame:
    return crf.quality_rows(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op8_repair_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return repair.round_trip(read(spark, folder, "documents"))


def op9_pivot_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.hundredths(read(spark, folder, "embeddings"))


def op10_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return graysim.component_rows(read(spark, folder, "documents"))


def op11_revisit_archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_rows(read(spark, folder, "pages"))


def op12_captured_middles(spark: SparkSession, folder: str) -> DataFrame:
    return fim.middle_rows(read(spark, folder, "documents"))


def op13_grammar_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_rows(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: run for name, run in globals().items() if name.startswith("op") and callable(run)
}
SQL: dict[str, str] = {name: text for name, text in vars(sql).items() if name in QUERIES}
