"""Set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def distinct_timestamps(*tables: DataFrame) -> DataFrame:
    keys = [df.select("patient_id", "timestamp") for df in tables]
    return reduce(DataFrame.unionByName, keys).distinct()


def in_both(train: DataFrame, test: DataFrame, key: str = "patient_id") -> DataFrame:
    return train.select(key).intersect(test.select(key))
