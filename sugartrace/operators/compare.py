"""Cohort statistics: pooled, per patient, bands across patients and their ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.operators import events, joins, ordered

PID = "patient_id"
METRICS = ("glu_mean", "glu_std", "cv", "tir_pct", "hypo_pct", "hyper_pct", "vhyper_pct", "roc_std")


def pool_stats(samples: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per cohort: size, days, sampling, gaps, distribution, volatility, events per day.

    `samples`: cohort, patient, minute, glucose (patients are unique over cohorts).
    `counts`: patient, n_insulin, n_carb. Sampling statistics use patients with 3+ samples.
    """
    finite = samples.filter(F.col("glucose").isNotNull() & ~F.isnan("glucose"))
    g, one = F.col("glucose"), F.count(F.lit(1))
    levels = finite.groupBy("cohort").agg(
        F.avg(g).alias("glu_mean"), F.stddev_pop(g).alias("glu_std"),
        (100.0 * F.count_if(g < K.LOW) / one).alias("hypo_pct"),
        (100.0 * F.count_if(g > K.HIGH) / one).alias("hyper_pct"),
    )
    patients = samples.groupBy("cohort", PID).agg(
        one.alias("n"), ((F.max("minute") - F.min("minute")) / 1440.0).alias("days")
    )
    sized = patients.join(counts, PID, "left")
    sizes = sized.groupBy("cohort").agg(
        one.alias("n_pat"),
        F.avg(F.when(F.col("n") >= 3, F.col("days"))).alias("days_per_pat"),
        F.sum(F.when(F.col("n") >= 3, F.col("days"))).alias("_days"),
        F.sum("n_insulin").alias("_ins"), F.sum("n_carb").alias("_carb"),
    )
    enough = patients.filter("n >= 3").select(PID, "cohort")
    steps = joins.lookup_join(events.rate_of_change(samples), enough, [PID])
    moves = steps.groupBy("cohort").agg(
        (100.0 * F.count_if("is_gap") / one).alias("gap_pct"), F.stddev_pop("roc").alias("roc_std")
    )
    dts = steps.filter("dt > 0").groupBy("cohort", "dt").agg(one.alias("n"))
    # distinct step lengths only, weighted by how often they occur
    dt = dts.groupBy("cohort").agg(F.expr("percentile(dt, 0.5D, n)").alias("dt_min"))
    days = F.when(F.coalesce("_days", F.lit(0.0)) > 0, F.col("_days")).otherwise(1.0)
    return (
        sizes.join(levels, "cohort").join(moves, "cohort", "left").join(dt, "cohort", "left")
        .select(
            "cohort", "n_pat", "days_per_pat", "dt_min", "gap_pct", "glu_mean", "glu_std", "hypo_pct", "hyper_pct",
            "roc_std", (F.col("_ins") / days).alias("ins_per_day"), (F.col("_carb") / days).alias("carb_per_day"),
        )
    )


def patient_metrics(samples: DataFrame, least: int = 100) -> DataFrame:
    """Distribution and volatility per patient; patients with fewer than `least` samples are left out."""
    finite = samples.filter(F.col("glucose").isNotNull() & ~F.isnan("glucose"))
    g, one = F.col("glucose"), F.count(F.lit(1))
    levels = (
        finite.groupBy(PID)
        .agg(
            one.alias("n"), F.avg(g).alias("glu_mean"), F.stddev_pop(g).alias("glu_std"),
            (100.0 * F.count_if(g.between(K.LOW, K.HIGH)) / one).alias("tir_pct"),
            (100.0 * F.count_if(g < K.LOW) / one).alias("hypo_pct"),
            (100.0 * F.count_if(g > K.HIGH) / one).alias("hyper_pct"),
            (100.0 * F.count_if(g > K.VERY_HIGH) / one).alias("vhyper_pct"),
        )
        .filter(F.col("n") >= least)
        .withColumn("cv", 100.0 * F.col("glu_std") / F.nullif("glu_mean", F.lit(0.0)))
    )
    roc = events.rate_of_change(samples).groupBy(PID).agg(F.stddev_pop("roc").alias("roc_std"))
    return levels.join(roc, PID, "left").select(PID, *METRICS)


def cohort_bands(metrics: DataFrame, ids: tuple[str, ...] = ("cohort", PID)) -> DataFrame:
    """Median, 10th and 90th percentile across patients per cohort and metric."""
    long = metrics.unpivot(list(ids), list(METRICS), "metric", "value").filter("value IS NOT NULL")
    return ordered.grouped_quantiles(long, ["cohort", "metric"], "value", {"p50": 0.5, "p10": 0.1, "p90": 0.9})


def spread_ratio(bands: DataFrame, simulated: str = "sim", narrow: float = 0.6) -> DataFrame:
    """Width of the simulated band over each real cohort's, flagged when too narrow."""
    width = (F.col("p90") - F.col("p10")).alias("width")
    sim = bands.filter(F.col("cohort") == simulated).select("metric", width.alias("_sim"))
    real = bands.filter(F.col("cohort") != simulated).select("cohort", "metric", width)
    ratio = F.when(F.col("width") > 0, F.col("_sim") / F.col("width"))
    return real.join(sim, "metric").select("cohort", "metric", ratio.alias("ratio"), (ratio < narrow).alias("too_narrow"))
