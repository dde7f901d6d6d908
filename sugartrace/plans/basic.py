"""Scalar functions, time windows, aggregates, lists and set operations."""

import re

from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.functions import rounding, scalars
from sugartrace.operators import aggregates as agg
from sugartrace.operators import joins, ranking, sets, timerange
from sugartrace.plans.oracle_views import MEAL, STATUS, day, ts
from sugartrace.plans.registry import query
from sugartrace.session import materialize, scratch_path
from sugartrace.sources.store import EventStore

G = "glucose_mmoll"
AS_OF = "2024-02-29"


# ---- row-level functions -------------------------------------------------------------------


@query("glucose_status", f"SELECT id, {STATUS.format(x='glucose_mmoll')} AS status FROM glucoses")
def _(t):
    return t.glucoses.select("id", scalars.glucose_status(F.col(G)).alias("status"))


@query(
    "glucose_status_loader",
    """SELECT id, CASE WHEN v < 3.0 THEN 'very_low' WHEN v < 3.9 THEN 'low' WHEN v < 10.0 THEN 'in_range'
       WHEN v < 13.9 THEN 'high' ELSE 'very_high' END AS status
       FROM (SELECT id, round_even(glucose_mmoll, 1) AS v FROM glucoses)""",
)
def _(t):
    rounded = rounding.half_even(F.col(G), 1)
    return t.glucoses.select("id", scalars.glucose_status(rounded, inclusive=False).alias("status"))


@query("meal_type", f"SELECT id, {MEAL.format(m='(hour(timestamp) * 60 + minute(timestamp))')} AS meal_type FROM entity")
def _(t):
    return t.glucoses.select("id", scalars.meal_type(scalars.minute_of_day(F.col("timestamp"))).alias("meal_type"))


@query(
    "intensity_from_text",
    """SELECT event_id, CASE WHEN s LIKE '%high%' OR s LIKE '%intense%' OR s LIKE '%vigorous%' THEN 'high'
       WHEN s LIKE '%medium%' OR s LIKE '%moderate%' THEN 'medium' ELSE 'low' END AS intensity
       FROM (SELECT event_id, lower(CASE event_id % 5 WHEN 0 THEN 'HIGH pace' WHEN 1 THEN 'Moderate '
       WHEN 2 THEN 'vigorous' WHEN 3 THEN NULL ELSE '' END || event_type) AS s FROM events)""",
)
def _(t):
    k = F.col("event_id") % 5
    prefix = F.when(k == 0, "HIGH pace").when(k == 1, "Moderate ").when(k == 2, "vigorous").when(k == 4, "")
    text = F.concat(prefix, F.col("event_type"))
    return t.events.select("event_id", scalars.intensity_from_text(text).alias("intensity"))


@query(
    "patient_age",
    f"SELECT id, CAST(date_sub('year', date_of_birth, DATE '{AS_OF}') AS BIGINT) AS age FROM patients",
)
def _(t):
    return t.patients.select(
        "id", scalars.patient_age(F.col("date_of_birth"), F.lit(AS_OF).cast("date")).alias("age")
    )


@query(
    "external_id_format",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN printf('SIM_%06d', c_custkey)
       ELSE 'SIM_' || c_name END AS external_id FROM customer""",
)
def _(t):
    key = F.col("c_custkey")
    raw = F.when(key % 2 == 0, key.cast("string")).otherwise(F.col("c_name"))
    return t.read("customer").select(key.alias("id"), scalars.external_id(raw).alias("external_id"))


def _byte(at: int) -> str:
    digit = lambda i: f"(instr('0123456789abcdef', substr(md5(CAST(id AS VARCHAR)), {i}, 1)) - 1)"
    return f"({digit(at)} * 16 + {digit(at + 1)})"


@query(
    "birth_date_synthetic",
    f"""SELECT id, strftime(CAST(m + to_days(CAST({_byte(3)} % day(last_day(m)) AS INTEGER)) AS DATE), '%Y-%m-%d') AS date_of_birth
        FROM (SELECT id, make_date(CAST(2024 - (18 + id % 48) AS INTEGER), CAST({_byte(1)} % 12 + 1 AS INTEGER), 1) AS m FROM patients)""",
)
def _(t):
    age = (18 + F.col("id") % 48).cast("double")
    dob = scalars.synthetic_birth_date(F.col("id"), age, F.lit("2024-01-01").cast("date"))
    return t.patients.select("id", dob.alias("date_of_birth"))


@query(
    "parse_period",
    """SELECT patient_id, TRY_CAST(regexp_extract(txt, '^([0-9]+)[hdwm]$', 1) AS BIGINT) AS n,
       CASE WHEN n IS NOT NULL THEN right(txt, 1) END AS unit
       FROM (SELECT patient_id, CASE WHEN patient_id % 9 = 0 THEN '7x' ELSE coalesce(last, 'd') END AS txt FROM requests)""",
)
def _(t):
    text = F.when(F.col("patient_id") % 9 == 0, "7x").otherwise(F.coalesce("last", F.lit("d")))
    return t.requests.select("patient_id", scalars.parse_period(text).alias("p")).select("patient_id", "p.n", "p.unit")


@query(
    "minute_to_timestamp",
    f"SELECT patient_id, absolute_minute, {ts('TIMESTAMP ' + repr('2024-01-01 00:00:00') + ' + to_minutes(absolute_minute)')} AS timestamp FROM cohort",
)
def _(t):
    base = F.lit("2024-01-01").cast("date")
    return t.cohort.select(
        "patient_id", "absolute_minute", scalars.minute_to_timestamp(base, F.col("absolute_minute")).alias("timestamp")
    )


@query(
    "timestamp_to_minute",
    """SELECT event_id, CAST(round_even(dt, 0) AS BIGINT) AS minute_rounded, CAST(floor(dt) AS BIGINT) AS minute_floored
       FROM (SELECT event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 60000000.0 AS dt FROM events)""",
)
def _(t):
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("first"))
    out = joins.lookup_join(t.events, first, ["user_id"])
    return out.select(
        "event_id",
        scalars.minutes_between(F.col("ts"), F.col("first"), rounded=True).alias("minute_rounded"),
        scalars.minutes_between(F.col("ts"), F.col("first")).alias("minute_floored"),
    )


MGDL = "floor({x} * 18.0182 + 0.5)"
MMOL = "floor({x} * 10 + 0.5) / 10"


@query("convert_glucose", f"SELECT id, {MGDL.format(x=G)} AS mg_dl, {MMOL.format(x=G)} AS mmol_l FROM glucoses")
def _(t):
    return t.glucoses.select(
        "id",
        scalars.convert_glucose(F.col(G), "mg/dL").alias("mg_dl"),
        scalars.convert_glucose(F.col(G), "mmol/L").alias("mmol_l"),
    )


@query(
    "describe_anomaly",
    f"""SELECT id, CASE WHEN residual_mmoll IS NULL THEN anomaly_type ELSE 'Glucose ran ' ||
        CASE WHEN id % 2 = 0 THEN CAST(CAST({MGDL.format(x='abs(residual_mmoll)')} AS BIGINT) AS VARCHAR) || ' mg/dL'
             ELSE printf('%.1f', {MMOL.format(x='abs(residual_mmoll)')}) || ' mmol/L' END ||
        CASE WHEN residual_mmoll >= 0 THEN ' above' ELSE ' below' END || ' forecast for ' ||
        CAST(duration_min AS VARCHAR) || ' min · ' ||
        CASE WHEN anomaly_type = 'late_bolus' THEN 'covering bolus arrived late' ELSE 'no bolus logged around the rise' END
        END AS description FROM anomalies""",
)
def _(t):
    unit = F.when(F.col("id") % 2 == 0, "mg/dL").otherwise("mmol/L")
    text = scalars.describe_anomaly(
        F.col("residual_mmoll"), F.col("duration_min"), F.col("anomaly_type"), unit, F.col("anomaly_type")
    )
    return t.anomalies.select("id", text.alias("description"))


@query("excursion_size", "SELECT id, round(coalesce(abs(residual_mmoll) * duration_min, 0), 6) AS excursion FROM anomalies")
def _(t):
    return t.anomalies.select(
        "id", scalars.excursion_size(F.col("residual_mmoll"), F.col("duration_min")).alias("excursion")
    )


@query(
    "pct_to_hours",
    """SELECT id, CASE WHEN m // 60 = 0 THEN (m % 60)::VARCHAR || 'min.' WHEN m % 60 = 0 THEN (m // 60)::VARCHAR || 'h'
       ELSE (m // 60)::VARCHAR || 'h ' || (m % 60)::VARCHAR || 'min.' END AS text
       FROM (SELECT id, CAST(floor(value % 100.0 / 100.0 * 1440.0 + 0.5) AS BIGINT) AS m FROM entity)""",
)
def _(t):
    return t.events.select(
        F.col("event_id").alias("id"), scalars.percent_of_day(F.col("value") % 100.0).alias("text")
    )


DAILY = """SELECT patient_id, date_trunc('day', timestamp) AS d, round_even(round(avg(glucose_mmoll), 9), 2) AS average,
  round_even(round(min(glucose_mmoll), 9), 2) AS min, round_even(round(max(glucose_mmoll), 9), 2) AS max FROM glucoses GROUP BY 1, 2"""
BAND = """CASE WHEN {a} < 3.0 OR {a} > 13.9 THEN 'Danger' WHEN {a} < 3.9 OR {a} > 10.0 THEN 'Warning' ELSE 'Success' END"""


@query("day_colour_band", f"SELECT patient_id, {day('d')} AS day, {BAND.format(a='average')} AS band FROM ({DAILY})")
def _(t):
    edges = [F.lit(x) for x in (K.VERY_LOW, K.LOW, K.HIGH, K.VERY_HIGH)]
    return agg.daily_summary(t.glucoses).select("patient_id", "day", scalars.day_band(F.col("average"), *edges).alias("band"))


@query("severity_visible", "SELECT id FROM anomalies WHERE (severity IS NULL OR severity >= 6.0) AND NOT is_acknowledged")
def _(t):
    return t.anomalies.filter(
        scalars.severity_visible(F.col("severity"), F.col("is_acknowledged"), K.PERSIST_SEVERITY)
    ).select("id")


# ---- time windows --------------------------------------------------------------------------


def _bounds_sql(table: str) -> str:
    return f"""SELECT patient_id, {ts('range_start')} AS range_start, {ts('range_end')} AS range_end FROM {table}_bounds"""


@query("resolve_time_range", _bounds_sql("glucoses"))
def _(t):
    return timerange.resolve(t.requests, t.glucoses)


def _window_filter(table: str, columns: str):
    sql = f"""SELECT f.patient_id, f.id, {ts('timestamp')} AS timestamp, {columns},
        count(*) OVER (PARTITION BY f.patient_id) AS total
        FROM {table} f JOIN {table}_bounds b ON b.patient_id = f.patient_id
        WHERE timestamp >= range_start AND timestamp <= range_end"""

    @query(f"window_filter_{table}", sql)
    def _(t):
        bounds = materialize(timerange.resolve(t.requests, getattr(t, table)))
        inside = timerange.in_window(getattr(t.during(*timerange.span(bounds)), table), bounds)
        totals = inside.groupBy("patient_id").agg(F.count(F.lit(1)).alias("total"))
        names = [c.strip() for c in re.sub(r"round\(\w+, 6\) AS ", "", columns).split(",")]
        counted = joins.lookup_join(inside, totals, ["patient_id"])
        return counted.select("patient_id", "id", "timestamp", *names, "total").orderBy(
            "patient_id", F.desc("timestamp")
        )


_window_filter("glucoses", "round(glucose_mmoll, 6) AS glucose_mmoll, status")
_window_filter("insulins", "round(units, 6) AS units, event_type")
_window_filter("meals", "round(carbs, 6) AS carbs, meal_type")
_window_filter(
    "histories",
    "round(glucose_mmoll, 6) AS glucose_mmoll, round(insulin_u, 6) AS insulin_u, round(cho_grams, 6) AS cho_grams",
)

ANOMALY_WINDOW = """SELECT a.* FROM anomalies a JOIN requests r ON r.patient_id = a.patient_id
    JOIN glucoses_bounds b ON b.patient_id = a.patient_id
    WHERE (req_start IS NULL AND req_end IS NULL AND last IS NULL)
       OR (detected_at >= range_start AND detected_at <= range_end)"""


@query(
    "window_filter_anomalies",
    f"SELECT patient_id, id, round(severity, 6) AS severity, {ts('detected_at')} AS detected_at FROM ({ANOMALY_WINDOW})",
)
def _(t):
    bounds = materialize(timerange.request_bounds(t.requests, t.glucoses))
    return (
        timerange.anomalies_in_window(t.during(*timerange.span(bounds)).anomalies, bounds)
        .select("patient_id", "id", "severity", "detected_at")
        .orderBy("patient_id", F.desc_nulls_last("severity"))
    )


def _store(t):
    """The glucose readings as two uploads into a store by day."""
    store = EventStore(t.spark, scratch_path(t.spark, "store"))
    cut = F.lit("2024-01-16").cast("timestamp")
    for half in (F.col("timestamp") >= cut, F.col("timestamp") < cut):
        store.append(t.glucoses.filter(half))
    return store


@query(
    "store_window_filter",
    f"""SELECT f.patient_id, f.id, {ts('timestamp')} AS timestamp, round(glucose_mmoll, 6) AS glucose_mmoll, status
        FROM glucoses f JOIN glucoses_bounds b ON b.patient_id = f.patient_id WHERE timestamp >= range_start AND timestamp <= range_end""",
)
def _(t):
    store = _store(t)
    inside = store.window(materialize(store.resolve(t.requests)))
    return inside.select("patient_id", "id", "timestamp", "glucose_mmoll", "status")


@query(
    "store_recent_day",
    f"""SELECT f.patient_id, count(*) AS readings, round(avg(glucose_mmoll), 6) AS average, {ts('max(timestamp)')} AS latest
        FROM glucoses f JOIN (SELECT max(timestamp) - to_hours(24) AS lo FROM glucoses) ON timestamp >= lo GROUP BY 1""",
)
def _(t):
    store = _store(t)
    window = timerange.resolve_cohort(store.latest(), "24h")
    recent = store.between(*timerange.span(window))
    return recent.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("readings"), F.avg("glucose_mmoll").alias("average"), F.max("timestamp").alias("latest")
    )


@query(
    "latest_reading",
    f"""SELECT patient_id, id, {ts('timestamp')} AS timestamp, round(glucose_mmoll, 6) AS glucose_mmoll, status FROM (
        SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp DESC, id DESC) AS rn FROM glucoses) WHERE rn = 1""",
)
def _(t):
    return agg.latest_reading(t.glucoses)


# ---- aggregates ----------------------------------------------------------------------------

INSIDE = """SELECT f.* FROM glucoses f JOIN glucoses_bounds b ON b.patient_id = f.patient_id
    WHERE timestamp >= range_start AND timestamp <= range_end"""


def _windowed(t):
    bounds = materialize(timerange.resolve(t.requests, t.glucoses))
    return timerange.in_window(t.during(*timerange.span(bounds)).glucoses, bounds)


def time_in_range(t):
    everyone = t.patients.select(F.col("id").alias("patient_id"))
    return agg.time_in_range(_windowed(t), everyone)


query(
    "time_in_range",
    f"""SELECT p.id AS patient_id, coalesce(span_days, 0) AS span_days, coalesce(very_low, 0.0) AS very_low,
        coalesce(low, 0.0) AS low, coalesce(in_range, 0.0) AS in_range, coalesce(high, 0.0) AS high,
        coalesce(very_high, 0.0) AS very_high FROM patients p LEFT JOIN (
        SELECT patient_id, CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000.0) AS BIGINT) AS span_days,
          round_even(count(*) FILTER (glucose_mmoll < 3.0) / count(*)::DOUBLE * 100, 1) AS very_low,
          round_even(count(*) FILTER (glucose_mmoll >= 3.0 AND glucose_mmoll < 3.9) / count(*)::DOUBLE * 100, 1) AS low,
          round_even(count(*) FILTER (glucose_mmoll >= 3.9 AND glucose_mmoll <= 10.0) / count(*)::DOUBLE * 100, 1) AS in_range,
          round_even(count(*) FILTER (glucose_mmoll > 10.0 AND glucose_mmoll <= 13.9) / count(*)::DOUBLE * 100, 1) AS high,
          round_even(count(*) FILTER (glucose_mmoll > 13.9) / count(*)::DOUBLE * 100, 1) AS very_high
        FROM ({INSIDE}) GROUP BY 1) s ON s.patient_id = p.id""",
)(time_in_range)


AVERAGE = f"SELECT patient_id, round(avg(glucose_mmoll), 9) AS average_mmoll FROM ({INSIDE}) GROUP BY 1"


@query("average_glucose", f"SELECT patient_id, round(average_mmoll, 6) AS average_mmoll FROM ({AVERAGE})")
def _(t):
    return agg.average_glucose(_windowed(t))


@query(
    "hba1c_estimate",
    f"""SELECT patient_id, percent, round_even((percent - 2.152) / 0.09148, 0) AS mmol_per_mol FROM (
        SELECT patient_id, round_even((46.7 + average_mmoll * 18.018) / 28.7, 1) AS percent FROM ({AVERAGE}))""",
)
def _(t):
    return agg.hba1c(agg.average_glucose(_windowed(t)))


@query("gmi", f"SELECT patient_id, round_even(3.31 + 0.02392 * (average_mmoll * 18.018), 1) AS gmi FROM ({AVERAGE})")
def _(t):
    return agg.gmi(agg.average_glucose(_windowed(t)))


@query("daily_glucose_summary", f"SELECT patient_id, {day('d')} AS day, average, min, max FROM ({DAILY})")
def _(t):
    return agg.daily_summary(t.glucoses).orderBy("patient_id", "day")


@query(
    "glucose_distribution",
    """SELECT status, count(*) AS readings, round(round(avg(glucose_mmoll), 9), 2) AS avg_mmoll, round(min(glucose_mmoll), 2) AS min_mmoll,
       round(max(glucose_mmoll), 2) AS max_mmoll, round(count(*) * 100.0 / (SELECT count(*) FROM glucoses), 1) AS pct
       FROM glucoses GROUP BY 1""",
)
def _(t):
    return agg.glucose_distribution(t.glucoses)


def _pct(condition: str) -> str:
    return f"round(100.0 * count(*) FILTER ({condition}) / count(*)::DOUBLE, 1)"


SHARES = f"""SELECT p.external_id, avg(glucose_mmoll) AS mean_mmoll, {", ".join(f"{_pct(f"status = '{s}'")} AS {s}" for s in K.STATUS_ORDER)},
    {_pct("status IN ('very_low', 'low')")} AS hypo_pct, {_pct("status IN ('high', 'very_high')")} AS hyper_pct
    FROM glucoses g JOIN patients p ON p.id = g.patient_id GROUP BY p.id, p.external_id"""


@query(
    "tir_ranking",
    f"SELECT external_id, {', '.join(K.STATUS_ORDER)} FROM ({SHARES}) ORDER BY in_range DESC, external_id LIMIT 10",
)
def _(t):
    return agg.tir_ranking(t.glucoses, t.patients)


@query(
    "extreme_profiles",
    f"""SELECT external_id, round(round(mean_mmoll, 9), 2) AS mean_mmoll, hypo_pct, hyper_pct, in_range AS tir_pct
        FROM ({SHARES}) ORDER BY in_range, external_id LIMIT 10""",
)
def _(t):
    return agg.extreme_profiles(t.glucoses, t.patients)


@query(
    "insulin_summary",
    """SELECT event_type, count(*) AS events, round(round(avg(units), 9), 2) AS avg_units, round(min(units), 2) AS min_units,
       round(max(units), 2) AS max_units, round(round(sum(units), 9), 0) AS total_units FROM insulins GROUP BY 1""",
)
def _(t):
    return agg.insulin_summary(t.insulins)


@query(
    "meal_summary",
    """SELECT coalesce(meal_type, 'unknown') AS meal_type, count(*) AS events, round(round(avg(carbs), 9), 1) AS avg_carbs_g,
       round(min(carbs), 1) AS min_carbs_g, round(max(carbs), 1) AS max_carbs_g FROM meals GROUP BY 1""",
)
def _(t):
    return agg.meal_summary(t.meals)


@query(
    "temporal_coverage",
    f"""SELECT {day('min(timestamp)')} AS earliest, {day('max(timestamp)')} AS latest,
        date_diff('day', min(timestamp)::DATE, max(timestamp)::DATE) AS span_days,
        count(DISTINCT patient_id) AS patients_with_data FROM glucoses""",
)
def _(t):
    return agg.temporal_coverage(t.glucoses)


@query(
    "readings_per_day",
    """SELECT round(avg(n), 1) AS avg_readings_per_patient_day, min(n) AS min, max(n) AS max FROM (
       SELECT count(*) AS n FROM glucoses GROUP BY patient_id, date_trunc('day', timestamp))""",
)
def _(t):
    return agg.readings_per_day(t.glucoses)


@query(
    "anomaly_summary",
    """SELECT anomaly_type, count(*) AS total, count(*) FILTER (is_acknowledged) AS acknowledged,
       count(*) FILTER (NOT is_acknowledged) AS pending, round(round(avg(confidence), 9), 3) AS avg_confidence FROM anomalies GROUP BY 1""",
)
def _(t):
    return agg.anomaly_summary(t.anomalies)


ENTITIES = ("patients", "glucoses", "insulins", "meals", "histories", "exercises", "anomalies")


@query("row_counts", " UNION ALL ".join(f"SELECT '{e}' AS tbl, count(*) AS rows FROM {e}" for e in ENTITIES))
def _(t):
    return agg.row_counts({e: getattr(t, e) for e in ENTITIES})


@query(
    "patient_overview",
    f"""SELECT id, external_id, name, CAST(date_sub('year', date_of_birth, DATE '{AS_OF}') AS BIGINT) AS age,
        coalesce(g.n, 0) AS glucose_readings, coalesce(i.n, 0) AS insulin_events, coalesce(m.n, 0) AS meal_events,
        {day('g.lo')} AS first_reading, {day('g.hi')} AS last_reading FROM patients p
        LEFT JOIN (SELECT patient_id, count(*) AS n, min(timestamp) AS lo, max(timestamp) AS hi FROM glucoses GROUP BY 1) g ON g.patient_id = p.id
        LEFT JOIN (SELECT patient_id, count(*) AS n FROM insulins GROUP BY 1) i ON i.patient_id = p.id
        LEFT JOIN (SELECT patient_id, count(*) AS n FROM meals GROUP BY 1) m ON m.patient_id = p.id
        ORDER BY glucose_readings DESC, id LIMIT 10""",
)
def _(t):
    return agg.patient_overview(t.patients, t.glucoses, t.insulins, t.meals, F.lit(AS_OF).cast("date"))


@query(
    "hourly_insulin",
    """SELECT patient_id, hour(timestamp) AS hour, round(sum(units) FILTER (event_type = 'basal'), 6) AS basal,
       round(sum(units) FILTER (event_type = 'bolus'), 6) AS bolus FROM insulins GROUP BY 1, 2""",
)
def _(t):
    return agg.hourly_insulin(t.insulins)


@query(
    "carb_points",
    """SELECT patient_id, id, round(hour(timestamp) + minute(timestamp) / 60.0, 6) AS hour, strftime(timestamp, '%H:%M') AS time,
       round(carbs, 6) AS carbs, coalesce(meal_type, 'unknown') AS meal_type FROM meals""",
)
def _(t):
    return agg.carb_points(t.meals).orderBy("patient_id", "hour")


@query(
    "weekly_overlay",
    f"""WITH pts AS (SELECT patient_id, date_trunc('week', timestamp)::DATE AS wk, isodow(timestamp) - 1 AS day_index, id,
        hour(timestamp) * 60 + minute(timestamp) AS minute_of_day, {MMOL.format(x=G)} AS glucose, status FROM glucoses),
        weeks AS (SELECT DISTINCT patient_id, wk FROM pts)
        SELECT w.patient_id, {day('w.wk')} AS week_start, d AS day_index, id, minute_of_day, glucose, status,
          weekofyear(w.wk) AS week_number, {day('w.wk + CAST(d AS INTEGER)')} AS day
        FROM weeks w CROSS JOIN range(0, 7) r(d)
        LEFT JOIN pts p ON p.patient_id = w.patient_id AND p.wk = w.wk AND p.day_index = d""",
)
def _(t):
    return agg.weekly_overlay(t.glucoses)


@query(
    "daily_mean_band",
    f"""SELECT patient_id, {day('d')} AS day, round(mean, 6) AS mean,
        CASE WHEN mean < 3.9 THEN 'danger' WHEN mean > 10.0 THEN 'warning' ELSE 'primary' END AS band FROM (
        SELECT patient_id, date_trunc('day', timestamp) AS d, round(avg({MMOL.format(x=G)}), 9) AS mean FROM glucoses GROUP BY 1, 2)""",
)
def _(t):
    return agg.daily_mean_band(t.glucoses)


@query(
    "scatter_whiskers",
    f"""SELECT patient_id, {day('d')} AS day, a AS avg, lo AS min, hi AS max,
        CASE WHEN a < 54 OR a > 250 THEN 'Danger' WHEN a < 70 OR a > 180 THEN 'Warning' ELSE 'Success' END AS color_type,
        greatest(0, hi - a) AS error_up, greatest(0, a - lo) AS error_down FROM (
        SELECT patient_id, d, {MGDL.format(x='average')} AS a, {MGDL.format(x='min')} AS lo, {MGDL.format(x='max')} AS hi FROM ({DAILY}))""",
)
def _(t):
    return agg.scatter_whiskers(agg.daily_summary(t.glucoses), "mg/dL")


@query(
    "anomaly_rate_per_day",
    """SELECT patient_id, shown, CASE WHEN n >= 2 AND days >= 0.5 THEN round(shown / days, 6) END AS per_day FROM (
       SELECT patient_id, count(*) AS n, count(*) FILTER (severity IS NULL OR severity >= 6.0) AS shown,
       (epoch(max(detected_at)) - epoch(min(detected_at))) / 86400.0 AS days FROM anomalies GROUP BY 1)""",
)
def _(t):
    return agg.anomaly_rate_per_day(t.anomalies, K.PERSIST_SEVERITY)


@query(
    "unack_count",
    """WITH c AS (SELECT patient_id, count(*) FILTER ((severity IS NULL OR severity >= 6.0) AND NOT is_acknowledged) AS pending
       FROM anomalies GROUP BY 1)
       SELECT patient_id, pending FROM c UNION ALL SELECT NULL, CAST(sum(pending) AS BIGINT) FROM c""",
)
def _(t):
    return agg.unacknowledged(t.anomalies, K.PERSIST_SEVERITY)


@query(
    "patient_summary_panel",
    f"""SELECT p.id AS patient_id, round(l.glucose_mmoll, 6) AS latest_mmoll, coalesce(i.in_range, 0.0) AS in_range,
        round(i.average_mmoll, 6) AS average_mmoll,
        round_even((46.7 + i.average_mmoll * 18.018) / 28.7, 1) AS hba1c_percent,
        coalesce(a.anomalies, 0) AS anomalies, coalesce(a.pending, 0) AS pending FROM patients p
        LEFT JOIN (SELECT patient_id, glucose_mmoll FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
            ORDER BY timestamp DESC, id DESC) AS rn FROM glucoses) WHERE rn = 1) l ON l.patient_id = p.id
        LEFT JOIN (SELECT patient_id, round(avg(glucose_mmoll), 9) AS average_mmoll,
            round_even(count(*) FILTER (glucose_mmoll >= 3.9 AND glucose_mmoll <= 10.0) / count(*)::DOUBLE * 100, 1) AS in_range
            FROM ({INSIDE}) GROUP BY 1) i ON i.patient_id = p.id
        LEFT JOIN (SELECT patient_id, count(*) AS anomalies, count(*) FILTER (NOT is_acknowledged) AS pending
            FROM ({ANOMALY_WINDOW}) GROUP BY 1) a ON a.patient_id = p.id""",
)
def _(t):
    bounds = timerange.request_bounds(t.requests, t.glucoses)
    return agg.patient_panel(t.patients, t.glucoses, bounds, t.anomalies)


def _label(column: str) -> str:
    return f"SELECT '{column}' AS label, coalesce({column}, 'none') AS value FROM cohort"


@query(
    "label_prevalence",
    f"""SELECT label, value, count(*) AS minutes, round(100.0 * count(*) / (SELECT count(*) FROM cohort), 6) AS pct
        FROM ({" UNION ALL ".join(_label(c) for c in ("bolus_status", "meal_size", "exercise_type"))}) GROUP BY 1, 2""",
)
def _(t):
    return agg.label_prevalence(t.cohort)


@query(
    "scenario_tir",
    """SELECT base_scenario, count(*) AS minutes,
       round(100.0 * count(*) FILTER (blood_glucose >= 3.9 AND blood_glucose <= 10.0) / count(*), 6) AS tir_pct,
       round(100.0 * count(*) FILTER (blood_glucose < 3.9) / count(*), 6) AS hypo_pct,
       round(100.0 * count(*) FILTER (blood_glucose > 10.0) / count(*), 6) AS hyper_pct,
       round(avg(blood_glucose), 6) AS mean_glucose FROM cohort GROUP BY 1""",
)
def _(t):
    return agg.scenario_tir(t.cohort)


@query(
    "overlay_days",
    """SELECT count(*) AS patient_days, round(100.0 * sum(l) / count(*), 6) AS large_pct, round(100.0 * sum(m) / count(*), 6) AS missed_pct,
       round(100.0 * sum(t) / count(*), 6) AS late_pct, round(100.0 * sum(x) / count(*), 6) AS exercise_pct FROM (
       SELECT max(CASE WHEN meal_size = 'large' THEN 1 ELSE 0 END) AS l, max(CASE WHEN bolus_status = 'missed' THEN 1 ELSE 0 END) AS m,
         max(CASE WHEN bolus_status = 'late' THEN 1 ELSE 0 END) AS t, max(CASE WHEN exercise_type IS NOT NULL THEN 1 ELSE 0 END) AS x
       FROM cohort GROUP BY patient_id, day)""",
)
def _(t):
    return agg.overlay_days(t.cohort)


@query(
    "cohort_readiness",
    """WITH s AS (SELECT count(DISTINCT patient_id)::DOUBLE AS patients,
         100.0 * count(*) FILTER (blood_glucose >= 3.9 AND blood_glucose <= 10.0) / count(*) AS tir,
         100.0 * count(*) FILTER (blood_glucose < 3.9) / count(*) AS hypo,
         100.0 * count(*) FILTER (blood_glucose > 10.0) / count(*) AS hyper,
         100.0 * stddev_pop(blood_glucose) / avg(blood_glucose) AS cv FROM cohort)
       SELECT 'patients' AS "check", patients AS value, patients >= 1000 AS ok FROM s
       UNION ALL SELECT 'tir_pct', round(tir, 6), tir >= 55 FROM s UNION ALL SELECT 'hypo_pct', round(hypo, 6), hypo < 5 FROM s
       UNION ALL SELECT 'hyper_pct', round(hyper, 6), hyper < 30 FROM s
       UNION ALL SELECT 'cv_pct', round(cv, 6), cv >= 30 AND cv <= 45 FROM s""",
)
def _(t):
    return agg.cohort_readiness(t.cohort)


METRICS = {
    "patients": "count(DISTINCT patient_id)::DOUBLE",
    "rows": "count(*)::DOUBLE",
    "bg_mean": "avg(blood_glucose)",
    "bg_std": "stddev_pop(blood_glucose)",
    "bg_min": "min(blood_glucose)",
    "bg_max": "max(blood_glucose)",
    "missed_pct": "100.0 * count(*) FILTER (bolus_status = 'missed') / count(*)",
    "late_pct": "100.0 * count(*) FILTER (bolus_status = 'late') / count(*)",
    "large_pct": "100.0 * count(*) FILTER (meal_size = 'large') / count(*)",
    "prolonged_pct": "100.0 * count(*) FILTER (exercise_type = 'prolonged') / count(*)",
    "anaerobic_pct": "100.0 * count(*) FILTER (exercise_type = 'anaerobic') / count(*)",
}
COHORT_NAME = "CASE WHEN patient_id % 4 = 0 THEN 'small' ELSE 'large' END"


@query(
    "cohort_compare",
    "SELECT metric, round(max(v) FILTER (cohort = 'small'), 6) AS small, round(max(v) FILTER (cohort = 'large'), 6) AS large FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, {COHORT_NAME} AS cohort, {e} AS v FROM cohort GROUP BY 2" for m, e in METRICS.items())
    + ") GROUP BY 1",
)
def _(t):
    named = t.cohort.withColumn("cohort", F.when(F.col("patient_id") % 4 == 0, "small").otherwise("large"))
    return agg.cohort_compare(named, ["small", "large"])


# ---- sorted lists, pages, sets -------------------------------------------------------------


@query(
    "patients_page",
    f"""SELECT id, external_id, name, {day('date_of_birth')} AS date_of_birth, {ts('created_at')} AS created_at,
        (SELECT count(*) FROM patients) AS total, CAST(ceil((SELECT count(*) FROM patients) / 20.0) AS BIGINT) AS pages
        FROM patients ORDER BY date_of_birth DESC, id DESC LIMIT 20 OFFSET 20""",
)
def _(t):
    return ranking.patients_page(t.patients, "age", ascending=True, number=2, size=20)


COHORT_WINDOW = "SELECT max(timestamp) - to_days(14) AS lo, max(timestamp) AS hi FROM glucoses"


TOTAL = "(SELECT count(*) FROM patients) AS total, (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) FROM patients) AS pages"


@query(
    "patients_by_anomalies",
    f"""SELECT p.id, p.external_id, count(a.id) AS pending, {TOTAL} FROM patients p CROSS JOIN ({COHORT_WINDOW}) w
        LEFT JOIN anomalies a ON a.patient_id = p.id AND NOT a.is_acknowledged AND a.detected_at >= w.lo AND a.detected_at <= w.hi
        GROUP BY 1, 2 ORDER BY pending DESC, id DESC LIMIT 50""",
)
def _(t):
    window = materialize(timerange.resolve_cohort(t.glucoses))
    ranked = ranking.by_anomalies(t.patients, t.during(*timerange.span(window)).anomalies, window)
    rows = ranking.page_with_total(ranked, [F.desc("pending"), F.desc("id")], 1, 50)
    return rows.select("id", "external_id", "pending", "total", "pages")


@query(
    "patients_by_tir",
    f"""SELECT p.id, p.external_id, round(coalesce(count(*) FILTER (g.glucose_mmoll >= 3.9 AND g.glucose_mmoll <= 10.0)
          / nullif(count(g.id), 0)::DOUBLE, 0.0), 6) AS tir, {TOTAL} FROM patients p CROSS JOIN ({COHORT_WINDOW}) w
        LEFT JOIN glucoses g ON g.patient_id = p.id AND g.timestamp >= w.lo AND g.timestamp <= w.hi
        GROUP BY 1, 2 ORDER BY coalesce(count(*) FILTER (g.glucose_mmoll >= 3.9 AND g.glucose_mmoll <= 10.0)
          / nullif(count(g.id), 0)::DOUBLE, 0.0) DESC, id DESC LIMIT 50""",
)
def _(t):
    window = materialize(timerange.resolve_cohort(t.glucoses))
    ranked = ranking.by_tir(t.patients, t.during(*timerange.span(window)).glucoses, window)
    rows = ranking.page_with_total(ranked, [F.desc("tir"), F.desc("id")], 1, 50)
    return rows.select("id", "external_id", "tir", "total", "pages")


VISIBLE = "WHERE (severity IS NULL OR severity >= 6.0) AND NOT is_acknowledged"


@query(
    "anomalies_sorted",
    f"""SELECT id, round(coalesce(abs(residual_mmoll) * duration_min, 0), 6) AS excursion, round(severity, 6) AS severity
        FROM anomalies {VISIBLE}
        ORDER BY coalesce(abs(residual_mmoll) * duration_min, 0) DESC, coalesce(severity, 0) DESC, id""",
)
def _(t):
    visible = t.anomalies.filter(
        scalars.severity_visible(F.col("severity"), F.col("is_acknowledged"), K.PERSIST_SEVERITY)
    )
    size = scalars.excursion_size(F.col("residual_mmoll"), F.col("duration_min"))
    return (
        visible.withColumn("excursion", size)
        .orderBy(*ranking.anomaly_order("excursion"))
        .select("id", "excursion", "severity")
    )


def _sorted(key: str, descending: bool):
    """The visible anomalies in one of the list's other orders."""
    turn = "DESC" if descending else "ASC"
    order = {
        "severity": f"coalesce(severity, 0) {turn}, id",
        "date": f"detected_at {turn}, id",
        "excursion": f"coalesce(abs(residual_mmoll) * duration_min, 0) {turn}, coalesce(severity, 0) DESC, id",
    }[key]

    @query(
        f"anomalies_by_{key}_{turn.lower()}",
        f"""SELECT id, round(severity, 6) AS severity, strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS detected_at
            FROM anomalies {VISIBLE} ORDER BY {order}""",
    )
    def _(t):
        visible = scalars.severity_visible(F.col("severity"), F.col("is_acknowledged"), K.PERSIST_SEVERITY)
        rows = t.anomalies.filter(visible).orderBy(*ranking.anomaly_order(key, descending))
        return rows.select("id", "severity", "detected_at")


for _key, _descending in (("severity", True), ("severity", False), ("date", True), ("date", False), ("excursion", False)):
    _sorted(_key, _descending)


@query("severity_rank", "SELECT id, row_number() OVER (ORDER BY coalesce(severity, 0) DESC, id) AS rank FROM anomalies")
def _(t):
    return ranking.severity_rank(t.anomalies).select("id", "rank")


@query(
    "top_events",
    """SELECT patient_id, id, round(severity, 6) AS severity FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
       ORDER BY severity DESC NULLS LAST, id) AS rn FROM anomalies) WHERE rn <= 5""",
)
def _(t):
    return ranking.top_events(t.anomalies, 5, tie="id").select("patient_id", "id", "severity")


@query(
    "union_timestamps_distinct",
    f"""SELECT patient_id, {ts('timestamp')} AS timestamp FROM (SELECT patient_id, timestamp FROM glucoses
        UNION SELECT patient_id, timestamp FROM meals UNION SELECT patient_id, timestamp FROM insulins)""",
)
def _(t):
    return sets.distinct_timestamps(t.glucoses, t.meals, t.insulins)


@query(
    "split_intersection",
    """SELECT patient_id FROM glucoses WHERE timestamp < TIMESTAMP '2024-01-20'
       INTERSECT SELECT patient_id FROM glucoses WHERE timestamp >= TIMESTAMP '2024-01-20'""",
)
def _(t):
    train = t.glucoses.filter("timestamp < timestamp'2024-01-20'")
    test = t.glucoses.filter("timestamp >= timestamp'2024-01-20'")
    return sets.in_both(train, test)


@query("describe_parquet")
def _(t):
    from sugartrace.sources import cohort

    return cohort.describe(t.events)
