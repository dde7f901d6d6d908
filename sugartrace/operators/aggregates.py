"""Windowed and cohort aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.functions import rounding, scalars
from sugartrace.operators import joins

PID = "patient_id"


def _share(condition: Column, digits: int = 1) -> Column:
    return rounding.half_even(F.count_if(condition) / F.count(F.lit(1)) * 100, digits)


def time_in_range(
    readings: DataFrame, patients: DataFrame | None = None, value: str = "glucose_mmoll",
    very_low: float = K.VERY_LOW, low: float = K.LOW, high: float = K.HIGH, very_high: float = K.VERY_HIGH,
) -> DataFrame:
    """Percent per band and whole-day span per patient; with `patients`, zeros where there is no reading."""
    v = F.col(value)
    bands = {
        "very_low": v < very_low,
        "low": (v >= very_low) & (v < low),
        "in_range": (v >= low) & (v <= high),
        "high": (v > high) & (v <= very_high),
        "very_high": v > very_high,
    }
    span = F.floor((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 86_400_000_000)
    out = readings.groupBy(PID).agg(
        span.cast("long").alias("span_days"), *[_share(c).alias(n) for n, c in bands.items()]
    )
    if patients is None:
        return out
    zeros = {c: 0 if c == "span_days" else 0.0 for c in out.columns if c != PID}
    return patients.select(PID).join(out, PID, "left").fillna(zeros)


def average_glucose(readings: DataFrame) -> DataFrame:
    return readings.groupBy(PID).agg(rounding.settled(F.avg("glucose_mmoll")).alias("average_mmoll"))


def hba1c(averages: DataFrame) -> DataFrame:
    """Estimated HbA1c; the IFCC value starts from the rounded percent."""
    percent = rounding.half_even((46.7 + F.col("average_mmoll") * K.MGDL_SERVER) / 28.7, 1)
    return averages.select(
        PID,
        percent.alias("percent"),
        rounding.half_even((percent - 2.152) / 0.09148, 0).alias("mmol_per_mol"),
    )


def gmi(averages: DataFrame) -> DataFrame:
    return averages.select(
        PID,
        rounding.half_even(3.31 + 0.02392 * (F.col("average_mmoll") * K.MGDL_SERVER), 1).alias("gmi"),
    )


def daily_summary(readings: DataFrame) -> DataFrame:
    return (
        readings.groupBy(PID, F.to_date("timestamp").alias("day"))
        .agg(
            F.avg("glucose_mmoll").alias("average"),
            F.min("glucose_mmoll").alias("min"),
            F.max("glucose_mmoll").alias("max"),
        )
        .select(PID, "day", *[rounding.half_even(rounding.settled(F.col(c)), 2).alias(c) for c in ("average", "min", "max")])
    )


def glucose_distribution(readings: DataFrame) -> DataFrame:
    g = F.col("glucose_mmoll")
    counts = readings.groupBy("status").agg(
        F.count(F.lit(1)).alias("readings"),
        rounding.half_up(rounding.settled(F.avg(g)), 2).alias("avg_mmoll"),
        rounding.half_up(F.min(g), 2).alias("min_mmoll"),
        rounding.half_up(F.max(g), 2).alias("max_mmoll"),
    )
    total = F.sum("readings").over(Window.partitionBy())  # five rows
    return counts.withColumn("pct", rounding.half_up(F.col("readings") * 100.0 / total, 1)).orderBy(
        scalars.status_rank(F.col("status"))
    )


def status_shares(readings: DataFrame) -> DataFrame:
    """Per patient: count, mean and percent of each status."""
    n = F.count(F.lit(1))
    return readings.groupBy(PID).agg(
        n.alias("readings"),
        F.avg("glucose_mmoll").alias("mean_mmoll"),
        *[
            rounding.half_up(100.0 * F.count_if(F.col("status") == s) / n, 1).alias(s)
            for s in K.STATUS_ORDER
        ],
        rounding.half_up(100.0 * F.count_if(F.col("status").isin("very_low", "low")) / n, 1).alias("hypo_pct"),
        rounding.half_up(100.0 * F.count_if(F.col("status").isin("high", "very_high")) / n, 1).alias("hyper_pct"),
    )


def tir_ranking(readings: DataFrame, patients: DataFrame, top: int = 10) -> DataFrame:
    shares = status_shares(readings).join(patients.withColumnRenamed("id", PID), PID)
    return (
        shares.orderBy(F.desc("in_range"), "external_id")
        .limit(top)
        .select("external_id", *K.STATUS_ORDER)
    )


def extreme_profiles(readings: DataFrame, patients: DataFrame, top: int = 10) -> DataFrame:
    shares = status_shares(readings).join(patients.withColumnRenamed("id", PID), PID)
    return (
        shares.orderBy("in_range", "external_id")
        .limit(top)
        .select(
            "external_id",
            rounding.half_up(rounding.settled(F.col("mean_mmoll")), 2).alias("mean_mmoll"),
            "hypo_pct",
            "hyper_pct",
            F.col("in_range").alias("tir_pct"),
        )
    )


def insulin_summary(insulins: DataFrame) -> DataFrame:
    u = F.col("units")
    return insulins.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        rounding.half_up(rounding.settled(F.avg(u)), 2).alias("avg_units"),
        rounding.half_up(F.min(u), 2).alias("min_units"),
        rounding.half_up(F.max(u), 2).alias("max_units"),
        rounding.half_up(rounding.settled(F.sum(u)), 0).alias("total_units"),
    )


def meal_summary(meals: DataFrame) -> DataFrame:
    c = F.col("carbs")
    return (
        meals.groupBy(F.coalesce("meal_type", F.lit("unknown")).alias("meal_type"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            rounding.half_up(rounding.settled(F.avg(c)), 1).alias("avg_carbs_g"),
            rounding.half_up(F.min(c), 1).alias("min_carbs_g"),
            rounding.half_up(F.max(c), 1).alias("max_carbs_g"),
        )
        .orderBy(F.desc("events"))
    )


def temporal_coverage(readings: DataFrame) -> DataFrame:
    first, last = F.to_date(F.min("timestamp")), F.to_date(F.max("timestamp"))
    # two-level distinct: one row per patient first, then a count
    per_patient = readings.groupBy(PID).agg(F.min("timestamp").alias("timestamp"), F.max("timestamp").alias("_max"))
    return per_patient.agg(
        first.alias("earliest"),
        F.to_date(F.max("_max")).alias("latest"),
        F.datediff(F.to_date(F.max("_max")), first).alias("span_days"),
        F.count(F.lit(1)).alias("patients_with_data"),
    )


def readings_per_day(readings: DataFrame) -> DataFrame:
    daily = readings.groupBy(PID, F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.agg(
        rounding.half_up(F.avg("n"), 1).alias("avg_readings_per_patient_day"),
        F.min("n").alias("min"),
        F.max("n").alias("max"),
    )


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("anomaly_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_acknowledged").alias("acknowledged"),
        F.count_if(~F.col("is_acknowledged")).alias("pending"),
        rounding.half_up(rounding.settled(F.avg("confidence")), 3).alias("avg_confidence"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows")
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("rows"), "tbl")


def patient_overview(
    patients: DataFrame, glucoses: DataFrame, insulins: DataFrame, meals: DataFrame, as_of: Column, top: int = 10
) -> DataFrame:
    glucose = glucoses.groupBy(F.col(PID).alias("id")).agg(
        F.count(F.lit(1)).alias("glucose_readings"),
        F.to_date(F.min("timestamp")).alias("first_reading"),
        F.to_date(F.max("timestamp")).alias("last_reading"),
    )
    insulin = insulins.groupBy(F.col(PID).alias("id")).agg(F.count(F.lit(1)).alias("insulin_events"))
    meal = meals.groupBy(F.col(PID).alias("id")).agg(F.count(F.lit(1)).alias("meal_events"))
    return (
        patients.join(glucose, "id", "left")
        .join(insulin, "id", "left")
        .join(meal, "id", "left")
        .fillna(0, ["glucose_readings", "insulin_events", "meal_events"])
        .orderBy(F.desc("glucose_readings"), "id")
        .limit(top)
        .select(
            "id", "external_id", "name",
            scalars.patient_age(F.col("date_of_birth"), as_of).alias("age"),
            "glucose_readings", "insulin_events", "meal_events", "first_reading", "last_reading",
        )
    )


def _local(ts: Column, tz: str) -> Column:
    return ts if tz == "UTC" else F.from_utc_timestamp(ts, tz)


def hourly_insulin(insulins: DataFrame, tz: str = "UTC") -> DataFrame:
    """Units per hour of day, basal and bolus side by side, null where there is none."""
    hour = F.hour(_local(F.col("timestamp"), tz))
    return (
        insulins.groupBy(PID, hour.alias("hour")).pivot("event_type", ["basal", "bolus"]).agg(F.sum("units"))
    )


def carb_points(meals: DataFrame, tz: str = "UTC") -> DataFrame:
    local = _local(F.col("timestamp"), tz)
    return meals.select(
        PID,
        "id",
        (F.hour(local) + F.minute(local) / 60.0).alias("hour"),
        F.date_format(local, "HH:mm").alias("time"),
        "carbs",
        F.coalesce("meal_type", F.lit("unknown")).alias("meal_type"),
    )


def weekly_overlay(readings: DataFrame, unit: str = "mmol/L", tz: str = "UTC") -> DataFrame:
    """Readings by ISO week and weekday; every week of a patient shows seven days, also empty ones."""
    local = _local(F.col("timestamp"), tz)
    points = readings.select(
        PID,
        F.to_date(F.date_trunc("week", local)).alias("week_start"),
        F.weekday(local).alias("day_index"),
        "id",
        scalars.minute_of_day(local).alias("minute_of_day"),
        scalars.convert_glucose(F.col("glucose_mmoll"), unit).alias("glucose"),
        "status",
    )
    filled = points.groupBy(PID, "week_start", "day_index").agg(F.count(F.lit(1)).alias("_n"))
    calendar = (
        filled.select(PID, "week_start").distinct().withColumn("day_index", F.explode(F.sequence(F.lit(0), F.lit(6))))
    )
    empty = calendar.join(filled, [PID, "week_start", "day_index"], "left_anti")
    return points.unionByName(empty, allowMissingColumns=True).withColumns(
        {"week_number": F.weekofyear("week_start"), "day": F.date_add("week_start", F.col("day_index"))}
    )


def daily_mean_band(readings: DataFrame, low: float = K.LOW, high: float = K.HIGH) -> DataFrame:
    shown = scalars.convert_glucose(F.col("glucose_mmoll"), "mmol/L")
    mean = F.col("mean")
    return (
        readings.groupBy(PID, F.to_date("timestamp").alias("day"))
        .agg(rounding.settled(F.avg(shown)).alias("mean"))
        .withColumn("band", F.when(mean < low, "danger").when(mean > high, "warning").otherwise("primary"))
    )


def scatter_whiskers(daily: DataFrame, unit: str = "mmol/L") -> DataFrame:
    shown = {c: scalars.convert_glucose(F.col(c), unit) for c in ("average", "min", "max")}
    edges = [scalars.convert_glucose(F.lit(x), unit) for x in (K.VERY_LOW, K.LOW, K.HIGH, K.VERY_HIGH)]
    return daily.select(
        PID,
        "day",
        shown["average"].alias("avg"),
        shown["min"].alias("min"),
        shown["max"].alias("max"),
        scalars.day_band(shown["average"], *edges).alias("color_type"),
        F.greatest(F.lit(0.0), shown["max"] - shown["average"]).alias("error_up"),
        F.greatest(F.lit(0.0), shown["average"] - shown["min"]).alias("error_down"),
    )


def anomaly_rate_per_day(anomalies: DataFrame, minimum: float) -> DataFrame:
    days = F.col("_span") / 86400.0
    return (
        anomalies.groupBy(PID)
        .agg(
            F.count("detected_at").alias("_stamps"),
            (F.unix_seconds(F.max("detected_at")) - F.unix_seconds(F.min("detected_at"))).alias("_span"),
            F.count_if(F.col("severity").isNull() | (F.col("severity") >= minimum)).alias("shown"),
        )
        .select(PID, "shown", F.when((F.col("_stamps") >= 2) & (days >= 0.5), F.col("shown") / days).alias("per_day"))
    )


def unacknowledged(anomalies: DataFrame, minimum: float) -> DataFrame:
    """Visible unacknowledged anomalies per patient and, with a null patient, in total."""
    hit = scalars.severity_visible(F.col("severity"), F.col("is_acknowledged"), minimum)
    per_patient = anomalies.groupBy(PID).agg(F.count_if(hit).alias("pending"))
    total = per_patient.agg(F.sum("pending").alias("pending")).select(F.lit(None).cast("long").alias(PID), "pending")
    return per_patient.unionByName(total)


def latest_reading(readings: DataFrame) -> DataFrame:
    return joins.last_by(readings, [PID], ["timestamp", "id"], ["id", "timestamp", "glucose_mmoll", "status"])


def patient_panel(patients: DataFrame, readings: DataFrame, bounds: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Latest reading, time in range, average, HbA1c and anomaly counts of every patient in one plan.

    `bounds` are those of `timerange.request_bounds`.
    """
    from sugartrace.operators import timerange

    facts = joins.lookup_join(readings, bounds, [PID], "left")
    inside = F.col("timestamp").between(F.col("range_start"), F.col("range_end"))
    v = F.col("glucose_mmoll")
    stats = facts.groupBy(PID).agg(
        F.max_by(v, F.struct("timestamp", "id")).alias("latest_mmoll"),
        F.count_if(inside).alias("_n"),
        F.count_if(inside & (v >= K.LOW) & (v <= K.HIGH)).alias("_in"),
        rounding.settled(F.avg(F.when(inside, v))).alias("average_mmoll"),
    )
    shown = timerange.anomalies_in_window(anomalies, bounds)
    counts = shown.groupBy(PID).agg(
        F.count(F.lit(1)).alias("anomalies"), F.count_if(~F.col("is_acknowledged")).alias("pending")
    )
    percent = rounding.half_even((46.7 + F.col("average_mmoll") * K.MGDL_SERVER) / 28.7, 1)
    return (
        patients.select(F.col("id").alias(PID))
        .join(stats, PID, "left")
        .join(counts, PID, "left")
        .select(
            PID,
            "latest_mmoll",
            F.when(F.col("_n") > 0, rounding.half_even(F.col("_in") / F.col("_n") * 100, 1)).otherwise(0.0)
            .alias("in_range"),
            "average_mmoll",
            percent.alias("hba1c_percent"),
            F.coalesce("anomalies", F.lit(0)).alias("anomalies"),
            F.coalesce("pending", F.lit(0)).alias("pending"),
        )
    )


def label_prevalence(cohort: DataFrame) -> DataFrame:
    """Share of minutes per label value, one row per (label, value)."""
    labels = ("bolus_status", "meal_size", "exercise_type")
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("label"), F.coalesce(c, F.lit("none")).alias("value")) for c in labels])
    )
    counts = cohort.select(pairs.alias("_p")).groupBy("_p.label", "_p.value").agg(F.count(F.lit(1)).alias("minutes"))
    total = F.sum("minutes").over(Window.partitionBy("label"))  # a handful of values per label
    return counts.withColumn("pct", 100.0 * F.col("minutes") / total)


def scenario_tir(cohort: DataFrame) -> DataFrame:
    g, n = F.col("blood_glucose"), F.count(F.lit(1))
    return cohort.groupBy("base_scenario").agg(
        n.alias("minutes"),
        (100.0 * F.count_if(g.between(K.LOW, K.HIGH)) / n).alias("tir_pct"),
        (100.0 * F.count_if(g < K.LOW) / n).alias("hypo_pct"),
        (100.0 * F.count_if(g > K.HIGH) / n).alias("hyper_pct"),
        F.avg(g).alias("mean_glucose"),
    )


def overlay_days(cohort: DataFrame) -> DataFrame:
    """Patient-days touched by each overlay label."""
    daily = cohort.groupBy(PID, "day").agg(
        F.max((F.col("meal_size") == "large").cast("int")).alias("large"),
        F.max((F.col("bolus_status") == "missed").cast("int")).alias("missed"),
        F.max((F.col("bolus_status") == "late").cast("int")).alias("late"),
        F.max(F.col("exercise_type").isNotNull().cast("int")).alias("exercise"),
    )
    n = F.count(F.lit(1))
    return daily.agg(
        n.alias("patient_days"),
        *[(100.0 * F.sum(F.coalesce(c, F.lit(0))) / n).alias(f"{c}_pct") for c in ("large", "missed", "late", "exercise")],
    )


def cohort_readiness(cohort: DataFrame) -> DataFrame:
    g, n = F.col("blood_glucose"), F.count(F.lit(1))
    per_patient = cohort.groupBy(PID).agg(
        n.alias("n"),
        F.sum(g).alias("s"),
        F.sum(g * g).alias("q"),
        F.count_if(g.between(K.LOW, K.HIGH)).alias("tir"),
        F.count_if(g < K.LOW).alias("hypo"),
        F.count_if(g > K.HIGH).alias("hyper"),
    )
    total = per_patient.agg(
        F.count(F.lit(1)).alias("patients"), *[F.sum(c).alias(c) for c in ("n", "s", "q", "tir", "hypo", "hyper")]
    )
    mean = F.col("s") / F.col("n")
    cv = 100.0 * F.sqrt(F.col("q") / F.col("n") - mean * mean) / mean
    pct = {c: 100.0 * F.col(c) / F.col("n") for c in ("tir", "hypo", "hyper")}
    checks = F.array(
        *[
            F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), ok.alias("ok"))
            for name, value, ok in (
                ("patients", F.col("patients"), F.col("patients") >= 1000),
                ("tir_pct", pct["tir"], pct["tir"] >= 55),
                ("hypo_pct", pct["hypo"], pct["hypo"] < 5),
                ("hyper_pct", pct["hyper"], pct["hyper"] < 30),
                ("cv_pct", cv, cv.between(30, 45)),
            )
        ]
    )
    return total.select(F.inline(checks))


def cohort_compare(cohorts: DataFrame, names: list[str]) -> DataFrame:
    """Metrics as rows, cohorts as columns."""
    g, n = F.col("blood_glucose"), F.count(F.lit(1))
    sizes = cohorts.groupBy("cohort", PID).agg(F.count(F.lit(1)).alias("n")).groupBy("cohort").agg(
        F.count(F.lit(1)).cast("double").alias("patients"), F.sum("n").cast("double").alias("rows")
    )
    values = cohorts.groupBy("cohort").agg(
        F.avg(g).alias("bg_mean"), F.stddev_pop(g).alias("bg_std"), F.min(g).alias("bg_min"), F.max(g).alias("bg_max"),
        (100.0 * F.count_if(F.col("bolus_status") == "missed") / n).alias("missed_pct"),
        (100.0 * F.count_if(F.col("bolus_status") == "late") / n).alias("late_pct"),
        (100.0 * F.count_if(F.col("meal_size") == "large") / n).alias("large_pct"),
        (100.0 * F.count_if(F.col("exercise_type") == "prolonged") / n).alias("prolonged_pct"),
        (100.0 * F.count_if(F.col("exercise_type") == "anaerobic") / n).alias("anaerobic_pct"),
    )
    wide = sizes.join(values, "cohort")
    metrics = [c for c in wide.columns if c != "cohort"]
    return wide.unpivot("cohort", metrics, "metric", "value").groupBy("metric").pivot("cohort", names).agg(F.max("value"))
