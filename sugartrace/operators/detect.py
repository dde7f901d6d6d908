"""From scored windows to named, stored anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.functions import rounding, scalars
from sugartrace.operators import calibrate, events, forecast, joins, rules, series
from sugartrace.operators import windows as W
from sugartrace.session import materialize

PID = "patient_id"


def score_series(grid: DataFrame, forecaster: forecast.Forecaster = forecast.zero, mode: str = "end",
                 stride: int = K.SCORE_STRIDE, flags: Sequence[str] = ()) -> DataFrame:
    """Scale by patient, window, forecast and score."""
    scaled = series.zscore_patient(grid)
    return forecast.score_windows(W.forecast_windows(scaled, stride, flags=flags), forecaster, mode)


def score_series_flagged(
    grid: DataFrame, flags: DataFrame, forecaster: forecast.Forecaster = forecast.zero, mode: str = "end",
    stride: int = K.SCORE_STRIDE,
) -> DataFrame:
    """The same with the horizon's maximum of each sparse flag (`flags`: patient, minute, f_*) per window."""
    names = [c for c in flags.columns if c.startswith("f_")]
    marked = series.zscore_patient(grid).join(flags, [PID, "minute"], "left").fillna(0.0, names)
    return forecast.score_windows(W.forecast_windows(marked, stride, flags=names), forecaster, mode)


def group_events(flagged: DataFrame, min_length: int = K.MIN_EVENT_MIN) -> DataFrame:
    """Sessions of flagged windows with the strongest window's score and direction (earliest on ties)."""
    sessions = events.event_sessions(flagged)
    bounds = events.session_bounds(sessions, min_length=min_length)
    strength = F.struct(F.col("score"), -F.col("start"))
    best = sessions.groupBy(PID, "session").agg(
        F.max_by(F.struct("score", "direction", "median", "sigma"), strength).alias("_best")
    )
    return bounds.join(best, [PID, "session"]).select(
        PID,
        "start_min",
        "end_min",
        (F.col("end_min") - F.col("start_min")).alias("duration_min"),
        F.col("_best.score").alias("score"),
        F.col("_best.direction").alias("direction"),
        ((F.col("_best.score") - F.col("_best.median")) / F.col("_best.sigma")).alias("severity"),
    )


def detect_events(
    scored: DataFrame, boluses: DataFrame, k: float = K.THRESHOLD_K, min_length: int = K.MIN_EVENT_MIN
) -> DataFrame:
    """Robust threshold, session merge, severity and rule label. Scores are written once: they are
    read for the baseline and again for the flags."""
    scored = materialize(scored)
    flagged = calibrate.flag(scored, calibrate.robust_baseline(scored, k, written=True)).filter("flagged")
    return rules.classify_detection(group_events(flagged, min_length), boluses)


def surface(found: DataFrame, origins: DataFrame, max_events: int = 0) -> DataFrame:
    """Named events as anomalies with strength, residual in mmol/L, times and a sentence.

    `origins`: patient, t0 (first timestamp), glucose_scale (population deviation of glucose).
    Strength relates to the strongest event of the patient, named or not.
    """
    strongest = found.groupBy(PID).agg(F.max("severity").alias("_max"))
    named = found.filter("rule_label IS NOT NULL")
    named = joins.lookup_join(named, strongest.join(origins, PID), [PID])
    scale = F.when(F.col("glucose_scale") != 0, F.col("glucose_scale")).otherwise(1.0)
    top = F.when(F.col("_max") != 0, F.col("_max")).otherwise(1.0)
    residual = F.col("direction") * scale
    missed = F.col("rule_label") == "missed"
    sentence = F.concat(
        F.lit("glucose ran "),
        F.format_string("%.1f", F.abs(residual)),
        F.lit(" mmol/L "),
        F.when(residual >= 0, "above").otherwise("below"),
        F.lit(" forecast for "),
        F.col("duration_min").cast("string"),
        F.lit(" min; "),
        F.when(missed, "no bolus logged around the rise").otherwise("covering bolus arrived late"),
    )
    end = F.col("start_min") + F.col("duration_min")
    out = named.select(
        PID,
        scalars.minute_to_timestamp(F.col("t0"), F.col("start_min")).alias("start"),
        scalars.minute_to_timestamp(F.col("t0"), end).alias("end"),
        F.col("start_min").alias("start_minute"),
        "duration_min",
        F.when(missed, "missed_bolus").otherwise("late_bolus").alias("anomaly_type"),
        sentence.alias("description"),
        rounding.half_even(F.col("severity"), 2).alias("severity"),
        rounding.half_even(100.0 * F.col("severity") / top, 1).alias("anomaly_strength"),
        rounding.half_even(F.col("score"), 4).alias("score"),
        rounding.half_even(residual, 2).alias("residual_mmoll"),
        (F.col("direction") >= 0).alias("above_forecast"),
    )
    if max_events <= 0:
        return out.orderBy(PID, F.desc("severity"))
    from sugartrace.operators import ranking

    return ranking.top_events(out, max_events, tie="start_minute")


def detection_counts(grid: DataFrame, found: DataFrame) -> DataFrame:
    """Valid minutes, detected and named events per patient."""
    minutes = grid.groupBy(PID).agg(F.count_if("valid").alias("valid_minutes"))
    counts = found.groupBy(PID).agg(
        F.count(F.lit(1)).alias("detected"), F.count_if(F.col("rule_label").isNotNull()).alias("named")
    )
    return minutes.join(counts, PID, "left").fillna(0, ["detected", "named"])


def diary(
    scored: DataFrame, thresholds: DataFrame, embeddings: DataFrame, labels: DataFrame, distance, radius: float,
    classes: Sequence[str], minimum: float = 0.30, min_length: int = K.MIN_EVENT_MIN,
) -> DataFrame:
    """Events with mean embedding, class probabilities and rule label.

    `embeddings`: patient, start, embedding, probs per window. `distance`: function from an
    embedding column to its distance from the normal cluster.
    """
    flagged = calibrate.flag(scored, thresholds).filter("flagged")
    sessions = materialize(events.event_sessions(flagged))
    bounds = events.session_bounds(sessions, min_length=min_length)
    peaks = sessions.groupBy(PID, "session").agg(F.max("score").alias("score"))
    vectors = sessions.join(embeddings, [PID, "start"]).select(
        PID, "session", F.posexplode(F.concat("probs", "embedding")).alias("_i", "_x")
    )
    means = vectors.groupBy(PID, "session", "_i").agg(F.avg("_x").alias("_x"))
    packed = F.sort_array(F.collect_list(F.struct("_i", "_x")))  # one entry per dimension
    means = means.groupBy(PID, "session").agg(packed["_x"].alias("_mean"))
    n = len(classes)
    out = (
        bounds.join(peaks, [PID, "session"])
        .join(means, [PID, "session"])
        .withColumn("probs", F.slice("_mean", 1, n))
        .withColumn("ood_distance", distance(F.slice("_mean", F.lit(n + 1), F.size("_mean") - n)))
    )
    out = out.withColumn("ood_flag", F.col("ood_distance") > radius).withColumn(
        "soft_label", scalars.top_class(F.col("probs"), classes)
    )
    out = out.withColumn(
        "characterised", scalars.event_characterised(F.col("probs"), classes, F.col("ood_distance"), radius, minimum)
    )
    return rules.overlap_label(
        out.select(PID, "start_min", "end_min", "score", "soft_label", "ood_distance", "ood_flag", "characterised"),
        labels,
    )
