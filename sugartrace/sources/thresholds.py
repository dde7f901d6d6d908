"""Glucose thresholds: request, else stored configuration, else defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugartrace import constants as K

DEFAULTS = {"very_low": K.VERY_LOW, "low": K.LOW, "high": K.HIGH, "very_high": K.VERY_HIGH}
CONFIG_KEYS = {"very_low": "veryLow", "low": "low", "high": "high", "very_high": "veryHigh"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON file with veryLow, low, high, veryHigh; absent keys stay null."""
    schema = ", ".join(f"{k} DOUBLE" for k in CONFIG_KEYS.values())
    stored = spark.read.schema(schema).option("multiLine", True).json(path)
    return stored.select(*[F.col(json).alias(name) for name, json in CONFIG_KEYS.items()])


def resolve(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Fill each request's null thresholds from the stored configuration, then the defaults.

    The configuration is aggregated to exactly one row: without a stored row all its values are null, and of
    several the highest counts.
    """
    present = [c for c in DEFAULTS if c in stored.columns]
    config = stored.agg(*[F.max(c).alias(f"_{c}") for c in present], F.count(F.lit(1)).alias("_rows"))
    joined = requests.crossJoin(F.broadcast(config))
    filled = {
        c: F.coalesce(F.col(c), *([F.col(f"_{c}")] if c in present else []), F.lit(default))
        for c, default in DEFAULTS.items()
    }
    return joined.withColumns(filled).drop("_rows", *[f"_{c}" for c in present])
