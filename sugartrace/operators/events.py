"""Runs in minute series and the events they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.functions import rounding, scalars
from sugartrace.operators import joins, ordered

PID = "patient_id"


def _runs(df: DataFrame, flag: Column, minute: str, block: int) -> DataFrame:
    return ordered.islands(ordered.with_block(df, minute, block), [PID], minute, flag)


def collapse_runs(
    df: DataFrame, value: str, flag_value: float = 0.0, minute: str = "absolute_minute", block: int = K.MINUTES_PER_DAY
) -> DataFrame:
    """Each run of values above the flag becomes its sum on the run's first row, the flag elsewhere."""
    df = ordered.with_block(df, minute, block).withColumn("_on", F.coalesce(F.col(value) > flag_value, F.lit(False)))
    at = F.col(minute).cast("long")
    df = ordered.sweep(
        df,
        [PID],
        [minute],
        forward={"_run": F.when(~F.col("_on"), at), "_was": F.col("_on")},
        strict=["_was"],
    ).withColumn("_run", F.coalesce("_run", F.lit(ordered.NO_ROW)))
    first = F.col("_on") & ~F.coalesce(F.col("_was"), F.lit(False))
    df = df.withColumn("_first", first)
    sums = df.filter("_on").groupBy(PID, "_run").agg(F.sum(value).alias("_total"))
    firsts = df.filter("_first").join(sums, [PID, "_run"]).withColumn("collapsed", F.col("_total"))
    rest = df.filter(~F.col("_first")).withColumn(
        "collapsed", F.when(F.col("_on"), F.lit(flag_value)).otherwise(F.col(value))
    )
    return firsts.drop("_total").unionByName(rest).drop("_on", "_was", "_first", "_run", ordered.BLOCK)


def run_bounds(df: DataFrame, flag: Column, minute: str = "minute", block: int = K.MINUTES_PER_DAY) -> DataFrame:
    """(start, end exclusive, length) of every run."""
    return (
        _runs(df, flag, minute, block)
        .groupBy(PID, "run")
        .agg(F.min(minute).alias("start"), (F.max(minute) + 1).alias("end"), F.count(F.lit(1)).alias("length"))
    )


def meal_events(cohort: DataFrame, carbs: str = "cho_mg", block: int = K.MINUTES_PER_DAY) -> DataFrame:
    """Carb runs to meals: whole grams above zero, at the onset, typed by the onset's time of day."""
    runs = _runs(cohort, F.col(carbs) > 0, "absolute_minute", block)
    return (
        runs.groupBy(PID, "run")
        .agg(
            F.min("absolute_minute").alias("absolute_minute"),
            F.min_by("minute", "absolute_minute").alias("_clock"),
            rounding.half_even(rounding.settled(F.sum(carbs) / 1000.0)).alias("carbs"),
        )
        .filter("carbs > 0")
        .select(PID, "absolute_minute", "carbs", scalars.meal_type(F.col("_clock")).alias("meal_type"))
    )


def bolus_events(
    cohort: DataFrame, insulin: str = "insulin_mu_min", cut: float = K.BASAL_BOLUS_CUT_MU, block: int = K.MINUTES_PER_DAY
) -> DataFrame:
    runs = _runs(cohort, F.coalesce(insulin, F.lit(0.0)) > cut, "absolute_minute", block)
    return (
        runs.groupBy(PID, "run")
        .agg(
            F.min("absolute_minute").alias("absolute_minute"),
            rounding.half_even(rounding.settled(F.sum(insulin) / 1000.0), 2).alias("units"),
        )
        .filter("units > 0")
        .select(PID, "absolute_minute", "units")
    )


def basal_events(
    cohort: DataFrame, insulin: str = "insulin_mu_min", cut: float = K.BASAL_BOLUS_CUT_MU, block: int = K.MINUTES_PER_DAY
) -> DataFrame:
    """Hourly basal sums, then zero markers where basal stops and one minute before it resumes.

    On the same minute the hourly sum wins, then the first marker.
    """
    rows = cohort.select(PID, "absolute_minute", F.coalesce(insulin, F.lit(0.0)).alias("v"))
    basal = (F.col("v") > 0) & (F.col("v") <= cut)
    hourly = (
        rows.filter(basal)
        .groupBy(PID, (ordered.floor_div("absolute_minute", 60) * 60).alias("absolute_minute"))
        .agg(rounding.half_even(rounding.settled(F.sum("v") / 1000.0), 2).alias("units"))
        .withColumn("_rank", F.lit(0))
    )
    steps = ordered.neighbour(
        ordered.with_block(rows, "absolute_minute", block), [PID], ["absolute_minute"], {"p": F.col("v")}
    ).filter("p IS NOT NULL")
    was = (F.col("p") > 0) & (F.col("p") <= cut)
    stop = was & ~basal & (F.col("v") <= cut)
    resume = basal & ~was & (F.col("p") == 0.0)
    markers = steps.filter(stop | resume).select(
        PID,
        F.when(stop, F.col("absolute_minute")).otherwise(F.col("absolute_minute") - 1).alias("absolute_minute"),
        F.lit(0.0).alias("units"),
        F.lit(1).alias("_rank"),
    )
    return joins.first_by(hourly.unionByName(markers), [PID, "absolute_minute"], ["_rank"], ["units"])


def announced_runs(cohort: DataFrame, block: int = K.MINUTES_PER_DAY) -> DataFrame:
    """Onset of every announced-carb run and whether its status is normal throughout."""
    return (
        _runs(cohort, F.col("cho_mg_announced") > 0, "absolute_minute", block)
        .groupBy(PID, "run")
        .agg(F.min("absolute_minute").alias("minute"), F.every(F.col("status") == "normal").alias("all_normal"))
    )


def derive_events(
    grid: DataFrame, block: int = K.MINUTES_PER_DAY, lengths: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Meals and boluses from channel rates: carb runs, and insulin runs above the rolling basal."""
    from sugartrace.operators import series

    meals = (
        _runs(grid, F.col("carbs") > 0, "minute", block)
        .groupBy(PID, "run")
        .agg(F.min("minute").alias("minute"), F.sum("carbs").alias("carb_g"))
        .select(PID, "minute", "carb_g")
    )
    spikes = series.rolling_median(grid, "insulin", "_basal", lengths=lengths).withColumn("_spike", F.col("insulin") - F.col("_basal"))
    boluses = (
        _runs(spikes, F.col("_spike") > K.BOLUS_MIN_U, "minute", block)
        .groupBy(PID, "run")
        .agg(F.min("minute").alias("minute"), F.sum("_spike").alias("units"))
        .select(PID, "minute", "units")
    )
    return meals, boluses


def event_edges(
    grid: DataFrame, bolus_cut: float = 200.0, block: int = K.MINUTES_PER_DAY, lengths: DataFrame | None = None
) -> DataFrame:
    """Per patient: onsets of carbs above zero and of insulin above the rolling basal by `bolus_cut`."""
    from sugartrace.operators import series

    rows = series.rolling_median(grid, "insulin", "_basal", lengths=lengths).select(
        PID, "minute", (F.col("carbs") > 0).alias("c"), (F.col("insulin") - F.col("_basal") > bolus_cut).alias("b")
    )
    steps = ordered.neighbour(
        ordered.with_block(rows, "minute", block), [PID], ["minute"], {"pc": F.col("c"), "pb": F.col("b")}
    )
    onset = lambda now, before: F.col(now) & ~F.coalesce(F.col(before), F.lit(False))
    return steps.groupBy(PID).agg(
        F.count_if(onset("c", "pc")).alias("n_carb"), F.count_if(onset("b", "pb")).alias("n_insulin")
    )


def exercise_bouts(cohort: DataFrame, label: str = "exercise_type", block: int = K.MINUTES_PER_DAY) -> DataFrame:
    active = F.col(label).isNotNull() & (F.lower(label) != "none")
    return (
        _runs(cohort, active, "absolute_minute", block)
        .groupBy(PID, "run")
        .agg(
            F.min("absolute_minute").alias("absolute_minute"),
            F.count(F.lit(1)).alias("duration_minutes"),
            F.min_by(label, "absolute_minute").alias("_label"),
        )
        .select(PID, "absolute_minute", "duration_minutes", scalars.intensity_from_text(F.col("_label")).alias("intensity"))
    )


def flag_onsets(
    cohort: DataFrame, missed: Column, late: Column, block: int = K.MINUTES_PER_DAY
) -> DataFrame:
    """0-to-1 transitions of the missed and late flags as anomaly rows."""
    rows = ordered.with_block(
        cohort.select(PID, "absolute_minute", missed.alias("m"), late.alias("l")), "absolute_minute", block
    )
    steps = ordered.neighbour(rows, [PID], ["absolute_minute"], {"pm": F.col("m"), "pl": F.col("l")})
    was = lambda c: F.coalesce(F.col(c), F.lit(False))
    kinds = F.array(
        F.when(F.col("m") & ~was("pm"), F.struct(F.lit("missed_bolus").alias("t"), F.lit(0.95).alias("c"))),
        F.when(F.col("l") & ~was("pl"), F.struct(F.lit("late_bolus").alias("t"), F.lit(0.90).alias("c"))),
    )
    return (
        steps.select(PID, "absolute_minute", F.explode(F.array_compact(kinds)).alias("k"))
        .select(PID, "absolute_minute", F.col("k.t").alias("anomaly_type"), F.col("k.c").alias("confidence"))
    )


def rate_of_change(samples: DataFrame, block: int = K.MINUTES_PER_DAY) -> DataFrame:
    """Steps between consecutive samples with |change| per minute where the step is no gap.

    `samples`: patient, minute, glucose. A gap is a step above 1.5 times the patient's median step.
    """
    steps = ordered.neighbour(
        ordered.with_block(samples, "minute", block), [PID], ["minute"],
        {"_pm": F.col("minute"), "_pg": F.col("glucose")},
    ).filter("_pm IS NOT NULL")
    steps = steps.withColumn("dt", F.col("minute") - F.col("_pm"))
    counts = steps.filter("dt > 0").groupBy(PID, "dt").agg(F.count(F.lit(1)).alias("n"))
    # one row per distinct step length, so the weighted percentile holds a few values
    median = counts.groupBy(PID).agg(F.expr("percentile(dt, 0.5D, n)").alias("median_dt"))
    out = joins.lookup_join(steps, median, [PID])
    gap = F.col("dt") > 1.5 * F.col("median_dt")
    usable = (F.col("dt") > 0) & ~gap & F.col("glucose").isNotNull() & F.col("_pg").isNotNull()
    return out.select(
        PID,
        "minute",
        "dt",
        "median_dt",
        gap.alias("is_gap"),
        F.when(usable, F.abs(F.col("glucose") - F.col("_pg")) / F.col("dt")).alias("roc"),
    )


def event_sessions(
    flagged: DataFrame, position: str = "start", merge_gap: int = K.MERGE_GAP_MIN, block: int = K.MINUTES_PER_DAY
) -> DataFrame:
    """Number (`session`) the groups of flagged window starts that lie at most `merge_gap` apart."""
    rows = ordered.with_block(flagged, position, block)
    rows = ordered.neighbour(rows, [PID], [position], {"_p": F.col(position)})
    new = F.col("_p").isNull() | (F.col(position) - F.col("_p") > merge_gap)
    return ordered.prefix_sum(rows, [PID], [position], {"session": new.cast("long")}).drop("_p", ordered.BLOCK)


def session_bounds(
    sessions: DataFrame, position: str = "start", context: int = K.CONTEXT_LEN, window: int = K.FORECAST_WINDOW,
    min_length: int = K.MIN_EVENT_MIN,
) -> DataFrame:
    """Per session: first start + context, last start + window; shorter than `min_length` is dropped."""
    bounds = sessions.groupBy(PID, "session").agg(
        (F.min(position) + context).alias("start_min"), (F.max(position) + window).alias("end_min"),
        F.count(F.lit(1)).alias("windows"),
    )
    return bounds.filter(F.col("end_min") - F.col("start_min") >= min_length)
