"""From documents to token files: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugartrace.llm import crf, decontam, mixing, neardup, repair
from sugartrace.llm.common import apart, read
from sugartrace.session import materialize

KEPT_FROM = 0.3
SHINGLE = 5
RADIUS = neardup.RADIUS  # differing bits up to which a pair always is compared; similarity decides


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the line field scores at least KEPT_FROM."""
    field = crf.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return apart(docs, lambda own: crf.scores(own, field, "_score").where(F.col("_score") >= KEPT_FROM).drop("_score"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, and of its rows the first text."""
    return apart(docs, lambda own: neardup.one_of_each(own, SHINGLE))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return apart(docs, lambda own: decontam.clean(own, read(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order and as often as the weighted mix of their sources takes them."""
    return apart(docs, mixing.mixed_documents)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return repair.round_trip(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

# Fitted weights, connected components and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
