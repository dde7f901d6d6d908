"""Rules that name events by the boluses around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.operators import joins, ordered

PID = "patient_id"


def boluses_around(probes: DataFrame, boluses: DataFrame, before: int, after: int, position: str = "minute") -> DataFrame:
    """Per probe: number and earliest minute of boluses in `[position - before, position + after]`.

    Boluses are first counted per minute, probes per minute, so a probe meets at most one
    row per minute of its interval and copies of an event are matched once.
    """
    per_minute = boluses.groupBy(PID, F.col("minute").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    spots = probes.select(PID, F.col(position).alias("_spot")).distinct()
    matched = joins.interval_join(
        spots, per_minute, [PID], F.col("_spot") - before, F.col("_spot") + after, "_at", before + after + 1, "inner"
    )
    found = matched.groupBy(PID, "_spot").agg(F.sum("_n").alias("boluses"), F.min("_at").alias("first_bolus"))
    return (
        probes.withColumn("_spot", F.col(position))
        .join(found, [PID, "_spot"], "left")
        .withColumn("boluses", F.coalesce("boluses", F.lit(0)))
        .drop("_spot")
    )


def large_meals(meals: DataFrame, block_days: int = K.HISTORY_DAYS) -> DataFrame:
    """Flag meals above mean + k * max(std, cv * mean) of the prior week; three prior meals needed.

    History is summed per minute and read through a halo of one week, so each task holds two
    weeks of one patient. `meals`: patient, id, minute, carb_g.
    """
    span = K.HISTORY_DAYS * K.MINUTES_PER_DAY
    per_minute = meals.groupBy(PID, "minute").agg(
        F.count(F.lit(1)).alias("n"), F.sum("carb_g").alias("s"), F.sum(F.col("carb_g") * F.col("carb_g")).alias("q")
    )
    tiles = ordered.with_halo(per_minute, "minute", block_days * K.MINUTES_PER_DAY, before=span)
    prior = Window.partitionBy(PID, ordered.TILE).orderBy("minute").rangeBetween(-span, -1)
    history = tiles.select(
        PID, "minute", ordered.CORE,
        F.sum("n").over(prior).alias("_n"), F.sum("s").over(prior).alias("_s"), F.sum("q").over(prior).alias("_q"),
    ).filter(ordered.CORE)
    out = meals.join(history.drop(ordered.CORE), [PID, "minute"])
    mean = F.col("_s") / F.col("_n")
    spread = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
    limit = mean + K.LARGE_K * F.greatest(spread, K.LARGE_MIN_CV * mean)
    large = (F.col("_n") >= K.MIN_PRIOR_MEALS) & (F.col("carb_g") > limit)
    return out.withColumn("is_large", F.coalesce(large, F.lit(False))).drop("_n", "_s", "_q")


def bolus_timing(first: Column, at: Column, delay: int) -> Column:
    return F.when(first.isNull(), "missed").when(first - at >= delay, "late")


def classify_meals(meals: DataFrame, boluses: DataFrame) -> DataFrame:
    """Missed / late by the boluses in `[-10, +60]` min, large by the patient's own week; snacks are skipped."""
    kept = meals.filter(F.col("carb_g") >= K.MIN_CARB_G)
    given = boluses.filter("units > 0")
    sized = large_meals(kept)
    timed = boluses_around(sized, given, K.BOLUS_LEAD, K.LATE_MAX)
    return timed.withColumn("timing", bolus_timing(F.col("first_bolus"), F.col("minute"), K.LATE_DELAY)).drop(
        "boluses", "first_bolus"
    )


def meal_labels(classified: DataFrame) -> DataFrame:
    """One row per (meal, class): a meal can be missed and large."""
    classes = F.array_compact(F.array(F.col("timing"), F.when(F.col("is_large"), "large")))
    return classified.select(PID, "id", "minute", F.explode(classes).alias("class"))


def classify_detection(events: DataFrame, boluses: DataFrame, onset: str = "start_min", direction: str | None = "direction") -> DataFrame:
    """Name detected excursions: missed (not when glucose ran below forecast), late, or null."""
    given = boluses.filter("units > 0") if "units" in boluses.columns else boluses
    timed = boluses_around(events, given, K.DETECT_LOOKBACK, K.DETECT_ATTRIBUTE_MAX, onset)
    first, at = F.col("first_bolus"), F.col(onset)
    below = F.coalesce(F.col(direction) < 0, F.lit(False)) if direction else F.lit(False)
    label = F.when(first.isNull(), F.when(~below, "missed")).when(first - at >= K.DETECT_LATE, "late")
    return timed.withColumn("rule_label", label).drop("boluses", "first_bolus")


def icr_check(meals: DataFrame, boluses: DataFrame) -> DataFrame:
    """Grams per unit of each meal's nearest bolus in `[-5, +60]` min; the cohort median should be 7 to 15.

    Nearest = the later of the last bolus before and the first bolus after, so only two
    candidates per meal are looked at.
    """
    given = joins.first_by(boluses.filter("units > 0"), [PID, "minute"], ["id"], ["units"])
    tagged = meals.select(PID, "minute", "id", "carb_g", F.lit(1).alias("_side")).unionByName(
        given.select(PID, "minute", F.struct(F.col("minute").alias("at"), "units").alias("_hit"), F.lit(0).alias("_side")),
        allowMissingColumns=True,
    )
    tagged = ordered.with_block(tagged, "minute", K.MINUTES_PER_DAY)
    order = ["minute", "_side", "id"]
    hit = F.col("_hit")
    tagged = ordered.sweep(tagged, [PID], order, forward={"_prev": hit}, backward={"_next": hit})
    m = F.col("minute")
    prev = F.when(m - F.col("_prev.at") <= 5, F.col("_prev"))
    nxt = F.when(F.col("_next.at") - m <= 60, F.col("_next"))
    near = F.when(prev.isNotNull() & (nxt.isNull() | (m - prev["at"] <= nxt["at"] - m)), prev).otherwise(nxt)
    ratios = tagged.filter("_side = 1").select((F.col("carb_g") / near["units"]).alias("icr")).filter("icr IS NOT NULL")
    out = ordered.grouped_quantiles(ratios, [], "icr", {"median_icr": 0.5})
    return out.select(F.col("n").alias("meals"), "median_icr", F.round("median_icr", 6).between(7, 15).alias("plausible"))


def clean_meals(meals: DataFrame, grid: DataFrame, min_grams: float = 30.0, lookback: int = 30, low: float = K.LOW) -> DataFrame:
    """Drop snacks and meals after a low in the prior half hour: no bolus is right there."""
    kept = meals.filter(F.col("carb_g") >= min_grams)
    lows = grid.filter(F.col("glucose") < low).select(PID, F.col("minute").alias("_at"))
    spots = kept.select(PID, F.col("minute").alias("_spot")).distinct()
    rescued = joins.interval_join(
        spots, lows, [PID], F.col("_spot") - lookback, F.col("_spot"), "_at", lookback + 1, "inner"
    ).select(PID, F.col("_spot").alias("minute")).distinct()
    return kept.join(rescued, [PID, "minute"], "left_anti")


def overlap_label(events: DataFrame, labels: DataFrame, window: int = K.FORECAST_WINDOW) -> DataFrame:
    """First class, in the order missed, late, large, with a meal in `[start - window, end]` of the event."""
    rank = F.when(F.col("class") == "missed", 0).when(F.col("class") == "late", 1).otherwise(2)
    per_minute = labels.groupBy(PID, F.col("minute").alias("_at")).agg(F.min(rank).alias("_rank"))
    matched = joins.interval_join(
        events, per_minute, [PID], F.col("start_min") - window, F.col("end_min"), "_at", 360
    )
    best = matched.groupBy(*events.columns).agg(F.min("_rank").alias("_rank"))
    label = F.when(F.col("_rank") == 0, "missed").when(F.col("_rank") == 1, "late").when(F.col("_rank") == 2, "large")
    return best.withColumn("rule_label", label).drop("_rank")


def anomalies_of_readings(readings: DataFrame, anomalies: DataFrame, minimum: float, minutes: int = 15) -> DataFrame:
    """Readings with the visible anomalies of the same day less than `minutes` away, one row per pair.

    A reading without any keeps one row with a null anomaly.
    """
    seconds = minutes * 60
    shown = anomalies.filter(F.col("severity").isNull() | (F.col("severity") >= minimum)).select(
        PID, F.col("id").alias("anomaly_id"), F.unix_seconds("detected_at").alias("_at")
    )
    probes = readings.select(PID, "id", F.unix_seconds("timestamp").alias("_ts"))
    day = 86_400
    hits = joins.interval_join(
        probes, shown, [PID], F.col("_ts") - (seconds - 1), F.col("_ts") + (seconds - 1), "_at", 4 * seconds, "inner"
    ).filter(ordered.floor_div("_ts", day) == ordered.floor_div("_at", day))
    pairs = hits.select("id", "anomaly_id")
    alone = probes.select("id").join(pairs.select("id"), "id", "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)
