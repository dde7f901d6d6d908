"""Per-patient thresholds from exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.operators import joins, ordered, trimmed
from sugartrace.session import materialize

PID = "patient_id"
QUARTILES = {"_q1": 0.25, "median": 0.5, "_q3": 0.75}


def _sigma() -> Column:
    return F.greatest((F.col("_q3") - F.col("_q1")) / K.IQR_PER_SIGMA, F.lit(K.SIGMA_FLOOR))


def _threshold(quartiles: DataFrame, k: float) -> DataFrame:
    return quartiles.withColumn("sigma", _sigma()).withColumn(
        "threshold", F.col("median") + k * F.col("sigma")
    ).drop("_q1", "_q3")


def leading(scored: DataFrame, n: int, position: str = "start", block: int = K.MINUTES_PER_DAY) -> DataFrame:
    """The first n scored windows of each patient in time order."""
    numbered = ordered.row_number(ordered.with_block(scored, position, block), [PID], [position], "_rn")
    return numbered.filter(F.col("_rn") <= n).drop("_rn", ordered.BLOCK)


def threshold_leading(scored: DataFrame, n: int, k: float = K.THRESHOLD_K) -> DataFrame:
    """median + k * IQR / 1.349 of each patient's first n windows (all of them when there are fewer)."""
    first = leading(scored, n)
    return _threshold(ordered.grouped_quantiles(first, [PID], "score", QUARTILES), k)


def threshold_all(scored: DataFrame, keys: list[str], k: float = K.THRESHOLD_K) -> DataFrame:
    return _threshold(ordered.grouped_quantiles(scored, keys, "score", QUARTILES), k)


def robust_baseline(
    scored: DataFrame, k: float = K.THRESHOLD_K, passes: int = 3, written: bool = False
) -> DataFrame:
    """Median, sigma and threshold of each patient's non-anomalous windows.

    Each pass drops the scores above the threshold, never below half of them. What is kept is always the first
    ranks of the patient's sorted scores, so all passes follow from counts in bins and the values of a few bins
    (`trimmed`). Scores are read twice; `written` says that they are a stored table already.
    """
    scores = scored.select(PID, "score")
    return trimmed.trimmed_quartiles(scores if written else materialize(scores), [PID], "score", k, passes)


def flag(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    joined = joins.lookup_join(scored, thresholds, [PID])
    return joined.withColumn("flagged", F.col("score") > F.col("threshold"))


def flagged_share(flagged: DataFrame) -> DataFrame:
    """Flagged windows per patient, and over all (null patient)."""
    per_patient = flagged.groupBy(PID).agg(
        F.count(F.lit(1)).alias("windows"), F.count_if("flagged").alias("flagged")
    )
    total = per_patient.agg(F.sum("windows").alias("windows"), F.sum("flagged").alias("flagged"))
    both = per_patient.unionByName(total.withColumn(PID, F.lit(None).cast("long")))
    return both.withColumn("flagged_pct", 100.0 * F.col("flagged") / F.col("windows"))


def severity(scored: DataFrame, baseline: DataFrame) -> DataFrame:
    joined = joins.lookup_join(scored, baseline, [PID])
    return joined.withColumn("severity", (F.col("score") - F.col("median")) / F.col("sigma"))
