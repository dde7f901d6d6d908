"""Series preparation, windows, forecasts, thresholds and detected events."""

from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.operators import calibrate, detect, embedding, events, forecast, joins, rules, series
from sugartrace.operators import windows as W
from sugartrace.plans.oracle_views import folded, ts
from sugartrace.plans.registry import query
from sugartrace.session import materialize

FLAGS = list(W.FLAGS)
FLAG_MAX = ", ".join(f"max({f}) OVER w AS {f}" for f in FLAGS)
FLAG_LIST = ", ".join(FLAGS)

# ---- series --------------------------------------------------------------------------------


@query(
    "minute_grid",
    """SELECT patient_id, minute, round(glucose, 6) AS glucose, round(insulin, 6) AS insulin, round(carbs, 6) AS carbs, valid FROM grid""",
)
def _(t):
    return t.grid


@query("interpolate_glucose", "SELECT patient_id, minute, round(glucose, 6) AS glucose FROM grid")
def _(t):
    return t.grid.select("patient_id", "minute", "glucose")


@query(
    "validity_mask",
    "SELECT patient_id, count(*) AS minutes, count(*) FILTER (valid) AS valid_minutes FROM grid GROUP BY 1",
)
def _(t):
    return t.grid.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("minutes"), F.count_if("valid").alias("valid_minutes")
    )


@query("zscore_patient", "SELECT patient_id, minute, round(z, 6) AS glucose FROM zgrid")
def _(t):
    return series.zscore_patient(t.grid).select("patient_id", "minute", "glucose")


@query(
    "zscore_global",
    """SELECT patient_id, minute, round((glucose - avg(glucose) FILTER (patient_id % 3 <> 0) OVER ())
         / greatest(stddev_pop(glucose) FILTER (patient_id % 3 <> 0) OVER (), 1e-8), 6) AS glucose,
         round((carbs - avg(carbs) FILTER (patient_id % 3 <> 0) OVER ())
         / greatest(stddev_pop(carbs) FILTER (patient_id % 3 <> 0) OVER (), 1e-8), 6) AS carbs FROM grid""",
)
def _(t):
    train = t.grid.filter(F.col("patient_id") % 3 != 0)
    return series.zscore_global(t.grid, train).select("patient_id", "minute", "glucose", "carbs")


@query(
    "normalize_mode",
    """SELECT patient_id, minute, round(z, 6) AS per_patient, round((g.glucose - m) / d, 6) AS global FROM zgrid
       JOIN grid g USING (patient_id, minute), (SELECT avg(glucose) AS m, greatest(stddev_pop(glucose), 1e-8) AS d FROM grid)""",
)
def _(t):
    own = series.normalize(t.grid, "per_patient").select("patient_id", "minute", F.col("glucose").alias("per_patient"))
    shared = series.normalize(t.grid, "global").select("patient_id", "minute", F.col("glucose").alias("global"))
    return own.join(shared, ["patient_id", "minute"])


@query("iob_cob")
def _(t):
    return series.iob_cob(t.grid).select("patient_id", "minute", "iob", "cob")


@query(
    "basal_piecewise_hold",
    """SELECT g.patient_id, g.minute, round(coalesce(e.rate, 0.0), 6) AS basal FROM grid g ASOF LEFT JOIN (
       SELECT patient_id, minute, glucose / 10.0 AS rate FROM cgm WHERE event_type = 'signup') e
       ON e.patient_id = g.patient_id AND e.minute <= g.minute""",
)
def _(t):
    return _basal(t).select("patient_id", "minute", "basal")


def _basal(t):
    entries = t.cgm.filter("event_type = 'signup'").select(
        "patient_id", "minute", (F.col("glucose") / 10.0).alias("rate"), F.col("id").alias("seq")
    )
    return series.basal_hold(t.grid.select("patient_id", "minute", "glucose"), entries)


@query(
    "temp_basal_override",
    """SELECT g.patient_id, g.minute, round(coalesce(o.rate, 1.0), 6) AS basal FROM grid g LEFT JOIN (
       SELECT patient_id, m AS minute, arg_max(glucose, id) AS rate FROM cgm, unnest(range(minute, minute + 12 + id % 20)) u(m)
       WHERE event_type = 'view' GROUP BY 1, 2) o ON o.patient_id = g.patient_id AND o.minute = g.minute""",
)
def _(t):
    overrides = t.cgm.filter("event_type = 'view'").select(
        "patient_id",
        F.col("minute").alias("begin"),
        (F.col("minute") + 11 + F.col("id") % 20).alias("end"),
        F.col("glucose").alias("rate"),
        F.col("id").alias("seq"),
    )
    flat = t.grid.select("patient_id", "minute", F.lit(1.0).alias("basal"))
    return series.temp_basal_override(flat, overrides)


RENDERED = """SELECT g.patient_id, g.minute, round(2.0 + coalesce(b.v, 0.0), 6) AS insulin, round(coalesce(c.v, 0.0), 6) AS carbs FROM grid g
    LEFT JOIN (SELECT patient_id, m AS minute, sum(units * 1000.0 / 3) AS v FROM {src}, unnest(range(minute, minute + 3)) u(m) GROUP BY 1, 2) b
      ON b.patient_id = g.patient_id AND b.minute = g.minute
    LEFT JOIN (SELECT patient_id, m AS minute, sum(carb_g * 1000.0 / 20) AS v FROM {src}, unnest(range(minute, minute + 20)) u(m) GROUP BY 1, 2) c
      ON c.patient_id = g.patient_id AND c.minute = g.minute"""
DOSED = "(SELECT patient_id, minute, units, units * 8 AS carb_g FROM boluses)"


def _dosed(t):
    return t.boluses.withColumn("carb_g", F.col("units") * 8)


def _flat(t):
    return t.grid.select("patient_id", "minute", F.lit(2.0).alias("basal"))


@query("render_channels", RENDERED.format(src=DOSED))
def _(t):
    return series.render_channels(_flat(t), _dosed(t)).drop("basal")


@query(
    "consolidate_5min",
    """WITH n AS (SELECT patient_id, max(minute) // 5 AS last FROM grid GROUP BY 1),
       b AS (SELECT patient_id, least(minute // 5, last) AS bin, sum(units) AS v FROM boluses JOIN n USING (patient_id) GROUP BY 1, 2),
       c AS (SELECT patient_id, least(minute // 5, last) AS bin, sum(carb_g) AS v FROM carbs_list JOIN n USING (patient_id) GROUP BY 1, 2)
       SELECT g.patient_id, g.minute, round_even(round(g.glucose, 9), 2) AS glucose, 0.12::DOUBLE AS basal_rate,
         round_even(round(coalesce(b.v, 0.0), 9), 3) AS bolus, round_even(round(coalesce(c.v, 0.0), 9), 1) AS carbs FROM grid g
       LEFT JOIN b ON b.patient_id = g.patient_id AND b.bin = g.minute // 5 LEFT JOIN c ON c.patient_id = g.patient_id AND c.bin = g.minute // 5
       WHERE g.minute % 5 = 0""",
)
def _(t):
    return series.consolidate(t.grid.withColumn("basal", F.lit(2.0)), t.boluses, t.carbs)


# ---- windows -------------------------------------------------------------------------------

LENGTHS = "(SELECT patient_id, max(minute) AS last FROM grid GROUP BY 1)"


@query(
    "window_index",
    f"SELECT patient_id, m AS start FROM {LENGTHS}, unnest(range(0, last + 2 - 120, 15)) u(m)",
)
def _(t):
    return W.window_index(t.grid, K.CONTEXT_LEN, K.TRAIN_STRIDE, t.lengths)


@query(
    "patient_window_counts",
    f"SELECT patient_id, count(*) AS windows FROM (SELECT patient_id, m FROM {LENGTHS}, unnest(range(0, last + 2 - 120, 15)) u(m)) GROUP BY 1",
)
def _(t):
    return W.window_counts(t.lengths, K.CONTEXT_LEN, K.TRAIN_STRIDE)


def _labels_sql(length: int, stride: int) -> str:
    return f"""SELECT patient_id, start, {FLAG_LIST} FROM (SELECT patient_id, minute AS start, count(*) OVER w AS n, {FLAG_MAX} FROM flag_grid
        WINDOW w AS (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING))
        WHERE n = {length} AND start % {stride} = 0"""


@query("window_labels", _labels_sql(120, 15))
def _(t):
    return W.window_labels(t.flags, t.lengths, K.CONTEXT_LEN, K.TRAIN_STRIDE)


@query(
    "window_class",
    f"""SELECT patient_id, start, CASE WHEN f_missed > 0 THEN 'missed' WHEN f_late > 0 THEN 'late' WHEN f_large > 0 THEN 'large'
        WHEN f_prolonged > 0 THEN 'prolonged' WHEN f_anaerobic > 0 THEN 'anaerobic' ELSE 'normal' END AS class FROM ({_labels_sql(120, 15)})""",
)
def _(t):
    from sugartrace.functions import scalars

    labels = W.window_labels(t.flags, t.lengths, K.CONTEXT_LEN, K.TRAIN_STRIDE)
    return labels.select("patient_id", "start", scalars.window_class([F.col(f) for f in FLAGS]).alias("class"))


@query(
    "any_anomaly_label",
    f"SELECT patient_id, start, CAST(greatest({FLAG_LIST}) > 0 AS DOUBLE) AS label FROM ({_labels_sql(120, 15)})",
)
def _(t):
    from sugartrace.functions import scalars

    labels = W.window_labels(t.flags, t.lengths, K.CONTEXT_LEN, K.TRAIN_STRIDE)
    return labels.select("patient_id", "start", scalars.any_flag([F.col(f) for f in FLAGS]).alias("label"))


@query("clean_window_index", f"SELECT patient_id, start FROM ({_labels_sql(160, 15)}) WHERE greatest({FLAG_LIST}) = 0")
def _(t):
    return W.clean_windows(t.flags, t.lengths, K.FORECAST_WINDOW, K.TRAIN_STRIDE)


@query(
    "contrastive_pools",
    f"SELECT patient_id, start, greatest({FLAG_LIST}) = 0 AS is_normal FROM ({_labels_sql(120, 15)})",
)
def _(t):
    return W.contrastive_pools(t.flags, t.lengths, K.CONTEXT_LEN, K.TRAIN_STRIDE)


@query("valid_window_starts", "SELECT patient_id, start FROM scored")
def _(t):
    return W.valid_windows(t.channels)


@query("horizon_labels", f"SELECT patient_id, start, {FLAG_LIST} FROM horizon_flags")
def _(t):
    return W.horizon_labels(t.flags, t.lengths, K.SCORE_STRIDE)


@query(
    "forecast_windows",
    """SELECT patient_id, start, round(h, 6) AS history_sum, round(i, 6) AS insulin_sum, round(c, 6) AS carbs_sum, round(y0, 6) AS target_first,
         round(y1, 6) AS target_last FROM (SELECT patient_id, minute AS start, count(*) OVER w AS n, bool_and(valid) OVER w AS ok,
         sum(glucose) OVER hist AS h, sum(insulin) OVER w AS i, sum(carbs) OVER w AS c,
         lead(glucose, 120) OVER o AS y0, lead(glucose, 159) OVER o AS y1 FROM grid
         WINDOW w AS (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN CURRENT ROW AND 159 FOLLOWING),
         hist AS (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN CURRENT ROW AND 119 FOLLOWING),
         o AS (PARTITION BY patient_id ORDER BY minute)) WHERE n = 160 AND ok AND start % 5 = 0""",
)
def _(t):
    cut = W.forecast_windows(t.grid)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    return cut.select(
        "patient_id",
        "start",
        add(F.col("history")).alias("history_sum"),
        add(F.col("insulin")).alias("insulin_sum"),
        add(F.col("carbs")).alias("carbs_sum"),
        F.element_at("target", 1).alias("target_first"),
        F.element_at("target", -1).alias("target_last"),
    )


# ---- forecasts and scores ------------------------------------------------------------------


@query("score_windows", "SELECT patient_id, start, round(score, 6) AS score, round(direction, 6) AS direction FROM scored")
def _(t):
    return detect.score_series(t.grid)


PERSIST = """SELECT z.patient_id, s.start, z.z - l.z AS r, z.minute - s.start - 120 AS h FROM scored s
    JOIN zgrid z ON z.patient_id = s.patient_id AND z.minute >= s.start + 120 AND z.minute < s.start + 160
    JOIN zgrid l ON l.patient_id = s.patient_id AND l.minute = s.start + 119"""


@query(
    "score_modes",
    f"""SELECT patient_id, start, round(avg(r * r), 6) AS sym, round(avg(greatest(r, 0)), 6) AS signed, round(max(r * r), 6) AS peak,
        round(avg(r * r) FILTER (h >= 30), 6) AS "end", round(avg(0.5 * (r * r * exp(-0.2) + 0.2)), 6) AS nll FROM ({PERSIST}) GROUP BY 1, 2""",
)
def _(t):
    cut = forecast.persistence(W.forecast_windows(series.zscore_patient(t.grid)))
    cut = cut.withColumn("_r", forecast.residuals(F.col("target"), F.col("mean")))
    logvar = F.transform("target", lambda x: F.lit(0.2))
    return cut.select(
        "patient_id",
        "start",
        *[forecast.window_score(F.col("_r"), m).alias(m) for m in ("sym", "signed", "peak", "end")],
        forecast.window_score(F.col("_r"), "sym", logvar).alias("nll"),
    )


@query("forecast_loss", f"SELECT round(avg(r * r), 6) AS loss FROM ({PERSIST})")
def _(t):
    return forecast.forecast_loss(forecast.persistence(W.forecast_windows(series.zscore_patient(t.grid))))


@query(
    "residual_direction",
    f"SELECT patient_id, start, round(avg(r) FILTER (h >= 30), 6) AS direction FROM ({PERSIST}) GROUP BY 1, 2",
)
def _(t):
    return detect.score_series(t.grid, forecast.persistence).select("patient_id", "start", "direction")


LAG = 30


@query(
    "arx_features",
    """SELECT patient_id, minute AS anchor, round(y, 6) AS target, round(g, 6) AS glucose_sum, round(i, 6) AS insulin_sum, round(c, 6) AS carbs_sum
       FROM (SELECT patient_id, minute, lead(glucose, 40) OVER o AS y, row_number() OVER o AS rn,
         sum(glucose) OVER (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS g,
         sum(insulin) OVER w AS i, sum(carbs) OVER w AS c FROM grid
         WINDOW o AS (PARTITION BY patient_id ORDER BY minute),
         w AS (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN 30 PRECEDING AND 39 FOLLOWING)) WHERE rn > 30 AND y IS NOT NULL""",
)
def _(t):
    rows = forecast.arx_features(t.grid, LAG, K.HORIZON)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    reach = LAG + K.HORIZON
    return rows.select(
        "patient_id",
        "anchor",
        F.col("y")[0].alias("target"),
        add(F.slice("x", 1, LAG)).alias("glucose_sum"),
        add(F.slice("x", LAG + 1, reach)).alias("insulin_sum"),
        add(F.slice("x", LAG + reach + 1, reach)).alias("carbs_sum"),
    )


@query("arx_fit")
def _(t):
    features = forecast.arx_features(series.zscore_patient(t.grid), LAG, K.HORIZON)
    return forecast.weights_frame(t.spark, *forecast.arx_fit(features))


@query("arx_residual")
def _(t):
    grid = materialize(t.grid)  # read for the scalers, the features and the minutes of the result
    features = materialize(forecast.arx_features(series.zscore_patient(grid), LAG, K.HORIZON, packed=True))
    anchored = forecast.arx_residual(features, *forecast.arx_fit(features))
    return forecast.residual_series(grid.select("patient_id", "minute"), anchored)


@query("score_windows_arx")
def _(t):
    cut = W.forecast_windows(series.zscore_patient(t.grid))
    fitted = forecast.arx_fit(forecast.horizon_features(cut, LAG))
    return forecast.score_windows(cut, forecast.arx(*fitted, LAG))


@query(
    "arx_window_score",
    f"""WITH r AS (SELECT f.*, coalesce((lead(glucose, 40) OVER o - glucose) ^ 2, 0.0) * CAST(minute >= 30 AS INTEGER) AS r FROM flag_grid f
          WINDOW o AS (PARTITION BY patient_id ORDER BY minute))
        SELECT patient_id, start, round(score, 6) AS score, {FLAG_LIST} FROM (SELECT patient_id, minute AS start, avg(r) OVER w AS score, {FLAG_MAX},
          count(*) OVER (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN CURRENT ROW AND 159 FOLLOWING) AS n FROM r
          WINDOW w AS (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN CURRENT ROW AND 119 FOLLOWING))
        WHERE n = 160 AND start >= 30 AND (start - 30) % 5 = 0""",
)
def _(t):
    rows = forecast.arx_features(t.grid, LAG, K.HORIZON)
    now = W.windows(t.grid, ["glucose"], LAG + K.HORIZON + 1, 1).select(
        "patient_id", (F.col("start") + LAG).alias("minute"), F.element_at("glucose", LAG + 1).alias("now")
    )
    change = rows.select("patient_id", F.col("anchor").alias("minute"), F.col("y")[0].alias("later")).join(
        now, ["patient_id", "minute"]
    )
    residual = change.select("patient_id", "minute", F.pow(F.col("later") - F.col("now"), 2).alias("residual"))
    rows = forecast.residual_series(t.flag_grid, residual)
    return W.window_mean(rows, "residual", K.CONTEXT_LEN, K.SCORE_STRIDE, LAG, K.HORIZON, FLAGS)


# ---- thresholds and events -----------------------------------------------------------------


def _scored(t):
    """Window scores, written once: thresholds and flags both read them."""
    return materialize(detect.score_series(t.grid))


FIVE_DAYS = 5 * K.MINUTES_PER_DAY // K.SCORE_STRIDE  # windows
LEADING = """SELECT patient_id, count(*) AS n, round(median(score), 6) AS median,
    greatest((quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.349, 1e-6) AS sigma,
    median(score) + 2.0 * greatest((quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.349, 1e-6) AS threshold
    FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY start) AS rn FROM scored) WHERE rn <= 1440 GROUP BY 1"""


@query(
    "threshold_leading",
    folded(f"SELECT patient_id, n, median, round(sigma, 6) AS sigma, round(threshold, 6) AS threshold FROM ({LEADING})", 4),
)
def _(t):
    return calibrate.threshold_leading(_scored(t.merged(4)), FIVE_DAYS)


@query(
    "robust_baseline",
    """SELECT patient_id, round(median, 6) AS median, round(sigma, 6) AS sigma, round(threshold, 6) AS threshold, kept FROM robust""",
)
def _(t):
    return calibrate.robust_baseline(_scored(t), written=True)


@query(
    "calibrate_per_patient",
    folded(
        f"""WITH c AS (SELECT s.patient_id, count(*) AS windows, count(*) FILTER (score > threshold) AS flagged FROM scored s
          JOIN ({LEADING}) l ON l.patient_id = s.patient_id GROUP BY 1)
        SELECT patient_id, windows, flagged, round(100.0 * flagged / windows, 6) AS flagged_pct FROM c
        UNION ALL SELECT NULL, CAST(sum(windows) AS BIGINT), CAST(sum(flagged) AS BIGINT), round(100.0 * sum(flagged) / sum(windows), 6) FROM c""",
        4,
    ),
)
def _(t):
    scored = _scored(t.merged(4))
    return calibrate.flagged_share(calibrate.flag(scored, calibrate.threshold_leading(scored, FIVE_DAYS)))


@query(
    "severity",
    "SELECT s.patient_id, start, round((score - median) / sigma, 6) AS severity FROM scored s JOIN robust r ON r.patient_id = s.patient_id",
)
def _(t):
    scored = _scored(t)
    return calibrate.severity(scored, calibrate.robust_baseline(scored, written=True)).select("patient_id", "start", "severity")


def _found(t):
    return detect.detect_events(detect.score_series(t.grid), t.boluses)


@query(
    "detect_events",
    """SELECT patient_id, start_min, end_min, duration_min, round(score, 6) AS score, round(direction, 6) AS direction,
       round(severity, 6) AS severity, rule_label FROM detected""",
)
def _(t):
    return _found(t)


@query(
    "classify_detection",
    """SELECT e.patient_id, e.id, e.minute, CASE WHEN fb IS NULL THEN CASE WHEN d < 0 THEN NULL ELSE 'missed' END WHEN fb - minute >= 15 THEN 'late' END AS rule_label
       FROM (SELECT patient_id, id, minute, glucose - 7.0 AS d, (SELECT min(b.minute) FROM boluses b WHERE b.patient_id = c.patient_id
         AND b.minute >= c.minute - 15 AND b.minute <= c.minute + 75) AS fb FROM cgm c WHERE event_type = 'error') e""",
)
def _(t):
    onsets = t.cgm.filter("event_type = 'error'").select(
        "patient_id", "id", "minute", (F.col("glucose") - 7.0).alias("direction")
    )
    return rules.classify_detection(onsets, t.boluses, "minute").drop("direction")


LARGE = """SELECT *, carb_g > m + 1.5 * greatest(d, 0.1 * m) AND n >= 3 AS is_large FROM (
    SELECT *, avg(carb_g) OVER w AS m, stddev_pop(carb_g) OVER w AS d, count(*) OVER w AS n FROM carbs_list WHERE carb_g >= 10
    WINDOW w AS (PARTITION BY patient_id ORDER BY minute RANGE BETWEEN 10080 PRECEDING AND 1 PRECEDING))"""


@query("rolling_large_meal", f"SELECT patient_id, id, minute, coalesce(is_large, false) AS is_large FROM ({LARGE})")
def _(t):
    kept = t.carbs.filter(F.col("carb_g") >= K.MIN_CARB_G)
    return rules.large_meals(kept).select("patient_id", "id", "minute", "is_large")


TIMED = f"""SELECT patient_id, id, minute, carb_g, coalesce(is_large, false) AS is_large,
    CASE WHEN fb IS NULL THEN 'missed' WHEN fb - minute >= 30 THEN 'late' END AS timing FROM (
    SELECT l.*, (SELECT min(b.minute) FROM boluses b WHERE b.patient_id = l.patient_id AND b.minute >= l.minute - 10 AND b.minute <= l.minute + 60) AS fb
    FROM ({LARGE}) l)"""


@query("classify_meals", f"SELECT patient_id, id, minute, round(carb_g, 6) AS carb_g, is_large, timing FROM ({TIMED})")
def _(t):
    return rules.classify_meals(t.carbs, t.boluses)


MEAL_LABELS = f"""SELECT patient_id, id, minute, timing AS class FROM ({TIMED}) WHERE timing IS NOT NULL
    UNION ALL SELECT patient_id, id, minute, 'large' FROM ({TIMED}) WHERE is_large"""


@query(
    "rule_label_overlap",
    f"""SELECT e.patient_id, start_min, end_min, (SELECT CASE min(CASE class WHEN 'missed' THEN 0 WHEN 'late' THEN 1 ELSE 2 END)
          WHEN 0 THEN 'missed' WHEN 1 THEN 'late' WHEN 2 THEN 'large' END FROM ({MEAL_LABELS}) m
          WHERE m.patient_id = e.patient_id AND m.minute >= e.start_min - 160 AND m.minute <= e.end_min) AS rule_label FROM detected_raw e""",
)
def _(t):
    found = _found(t).select("patient_id", "start_min", "end_min")
    labels = rules.meal_labels(rules.classify_meals(t.carbs, t.boluses))
    return rules.overlap_label(found, labels)


ORIGINS = """SELECT e.patient_id, t0, scale FROM (SELECT patient_id, min(timestamp) AS t0 FROM entity GROUP BY 1) e
    JOIN (SELECT patient_id, stddev_pop(glucose) AS scale FROM grid GROUP BY 1) s ON s.patient_id = e.patient_id"""
SURFACED = f"""SELECT d.patient_id, t0 + to_minutes(start_min) AS t_start, t0 + to_minutes(end_min) AS t_end, start_min, duration_min,
    rule_label, direction, round_even(severity, 2) AS severity, round_even(100.0 * severity / mx, 1) AS strength, round_even(score, 4) AS score,
    direction * scale AS residual FROM detected d JOIN (SELECT patient_id, max(severity) AS mx FROM detected GROUP BY 1) m ON m.patient_id = d.patient_id
    JOIN ({ORIGINS}) o ON o.patient_id = d.patient_id WHERE rule_label IS NOT NULL"""


def _origins(t):
    first = t.glucoses.groupBy("patient_id").agg(F.min("timestamp").alias("t0"))
    scale = t.grid.groupBy("patient_id").agg(F.stddev_pop("glucose").alias("glucose_scale"))
    return first.join(scale, "patient_id")


@query(
    "surface_anomalies",
    f"""SELECT patient_id, {ts('t_start')} AS start, {ts('t_end')} AS "end", start_min AS start_minute, duration_min, rule_label || '_bolus' AS anomaly_type,
        'glucose ran ' || printf('%.1f', abs(residual)) || ' mmol/L ' || CASE WHEN residual >= 0 THEN 'above' ELSE 'below' END || ' forecast for '
        || CAST(duration_min AS VARCHAR) || ' min; ' || CASE WHEN rule_label = 'missed' THEN 'no bolus logged around the rise'
        ELSE 'covering bolus arrived late' END AS description, severity, strength AS anomaly_strength, score,
        round_even(residual, 2) AS residual_mmoll, direction >= 0 AS above_forecast FROM ({SURFACED})""",
)
def _(t):
    return detect.surface(_found(t), _origins(t))


@query(
    "persist_filter",
    folded(
        f"""SELECT patient_id, rule_label || '_bolus' AS anomaly_type, round(strength / 100.0, 6) AS confidence, severity,
        {ts('t_start')} AS detected_at FROM ({SURFACED}) WHERE severity >= 6.0""",
        4,
    ),
)
def _(t):
    from sugartrace.sources import sinks

    t = t.merged(4)
    stored = sinks.persistable(detect.surface(_found(t), _origins(t)))
    return stored.select("patient_id", "anomaly_type", "confidence", "severity", "detected_at")


@query(
    "detection_counts",
    """SELECT g.patient_id, valid_minutes, coalesce(detected, 0) AS detected, coalesce(named, 0) AS named FROM (
       SELECT patient_id, count(*) FILTER (valid) AS valid_minutes FROM grid GROUP BY 1) g LEFT JOIN (
       SELECT patient_id, count(*) AS detected, count(rule_label) AS named FROM detected GROUP BY 1) d ON d.patient_id = g.patient_id""",
)
def _(t):
    return detect.detection_counts(t.grid, _found(t))


# ---- embeddings ----------------------------------------------------------------------------


@query("ood_fit")
def _(t):
    normal = t.read("embeddings").filter("label = 0")
    mean, inverse = embedding.ood_fit(normal)
    rows = [(i, float(mean[i]), float(inverse[i, i])) for i in range(len(mean))]
    return t.spark.createDataFrame(rows, "dimension int, mean double, inverse_diagonal double")


@query("ood_distance")
def _(t):
    vectors = t.read("embeddings")
    normal = vectors.filter("label = 0")
    distance = embedding.ood_distance(*embedding.ood_fit(normal))
    radius = embedding.ood_radius(normal, distance)
    scored = vectors.select("vec_id", "label", distance(F.col("embedding")).alias("distance"))
    return scored.withColumn("outside", F.col("distance") > radius)


@query("gmm_score")
def _(t):
    vectors = t.read("embeddings")
    fitted = embedding.mixture_fit(vectors.filter("label = 0"))
    return embedding.mixture_score(vectors, *fitted).select("vec_id", "label", "score")


CLASS_NAMES = ("normal", *K.CLASSES)


def _probabilities(column):
    # six class probabilities from the first six embedding dimensions
    raw = F.transform(F.slice(column, 1, 6), lambda x: F.exp(x.cast("double") * 4))
    total = F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(raw, lambda x: x / total)


@query(
    "event_characterised",
    """WITH p AS (SELECT vec_id, label, list_transform(embedding[1:6], lambda x: exp(x::DOUBLE * 4)) AS e FROM embeddings),
       q AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM p)
       SELECT vec_id, label <= 2 AND list_position(probs, list_max(probs)) <> 1 AND list_max(probs) >= 0.30 AS shown FROM q""",
)
def _(t):
    from sugartrace.functions import scalars

    vectors = t.read("embeddings").withColumn("probs", _probabilities(F.col("embedding")))
    shown = scalars.event_characterised(F.col("probs"), CLASS_NAMES, F.col("label").cast("double"), 2.0)
    return vectors.select("vec_id", shown.alias("shown"))


@query("diary_events")
def _(t):
    scored = _scored(t)
    vectors = t.read("embeddings")
    distance = embedding.distance_expression(*embedding.ood_fit(vectors.filter("label = 0")))
    total = vectors.count()
    keyed = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
                           _probabilities(F.col("embedding")).alias("probs"))
    windows = scored.select(
        "patient_id", "start", F.pmod(F.xxhash64("patient_id", "start"), F.lit(total)).alias("vec_id")
    )
    embeddings = windows.join(keyed, "vec_id").drop("vec_id")
    labels = rules.meal_labels(rules.classify_meals(t.carbs, t.boluses))
    thresholds = calibrate.threshold_leading(scored, FIVE_DAYS)
    return detect.diary(scored, thresholds, embeddings, labels, distance, 9.0, CLASS_NAMES)
