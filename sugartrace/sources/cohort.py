"""Simulator cohort: Parquet with one row per patient-minute, and a profile of any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.functions import scalars

SIGNALS = ("blood_glucose", "insulin_mu_min", "cho_mg_announced")
LABELS = {
    "missed": "bolus_status",
    "late": "bolus_status",
    "large": "meal_size",
    "prolonged": "exercise_type",
    "anaerobic": "exercise_type",
}


def read(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    for name in df.columns:  # column names differ in case between producers
        if name != name.lower():
            df = df.withColumnRenamed(name, name.lower())
    return df


def select_signals(df: DataFrame, ids: DataFrame | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Signal columns of the wanted patients; a missing announced-carb column is zero."""
    if "cho_mg_announced" not in df.columns:
        df = df.withColumn("cho_mg_announced", F.lit(0.0))
    out = df.select("patient_id", "absolute_minute", *SIGNALS, *extra)
    return out if ids is None else out.join(ids.select("patient_id"), "patient_id", "left_semi")


def label_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({f"f_{c}": scalars.label_flag(F.col(LABELS[c]), c) for c in K.CLASSES})


def announced_or_consumed(df: DataFrame) -> DataFrame:
    """Carbs per minute: announced, else consumed, else zero."""
    parts = [F.col(c) for c in ("cho_mg_announced", "cho_mg_min") if c in df.columns]
    return df.withColumn("cho_mg", F.coalesce(*parts, F.lit(0.0)))


def describe(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls, distinct estimate, smallest and largest value as text."""
    rows = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.count_if(F.col(field.name).isNull()).alias("nulls"),
                F.min(F.col(field.name)).cast("string").alias("min"),
                F.max(F.col(field.name)).cast("string").alias("max"),
            ).alias(f"_{field.name}")
            for field in df.schema.fields
        ],
    )
    return rows.select("rows", F.inline(F.array(*[F.col(f"_{c}") for c in df.columns])))
