"""Cohort scans, event extraction, joins and idempotent writes."""

from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.operators import events, joins, rules, series
from sugartrace.plans.oracle_views import MEAL, day, ts
from sugartrace.plans.registry import query
from sugartrace.sources import cohort as cohort_source
from sugartrace.sources import sinks, thresholds

CUT = "timestamp '2024-01-20 00:00:00'"


@query(
    "scan_cohort",
    """SELECT patient_id, absolute_minute, round(blood_glucose, 6) AS blood_glucose, round(insulin_mu_min, 6) AS insulin_mu_min,
       round(cho_mg_announced, 6) AS cho_mg_announced FROM cohort
       WHERE patient_id IN (SELECT patient_id FROM anomalies WHERE severity > 45)""",
)
def _(t):
    ids = t.anomalies.filter("severity > 45").select("patient_id").distinct()
    return cohort_source.select_signals(t.cohort, ids)


@query(
    "scan_cohort_labels",
    """SELECT patient_id, absolute_minute, CAST(coalesce(bolus_status = 'missed', false) AS DOUBLE) AS f_missed,
       CAST(coalesce(bolus_status = 'late', false) AS DOUBLE) AS f_late, CAST(coalesce(meal_size = 'large', false) AS DOUBLE) AS f_large,
       CAST(coalesce(exercise_type = 'prolonged', false) AS DOUBLE) AS f_prolonged,
       CAST(coalesce(exercise_type = 'anaerobic', false) AS DOUBLE) AS f_anaerobic FROM cohort""",
)
def _(t):
    return cohort_source.label_flags(t.cohort).select(
        "patient_id", "absolute_minute", *[f"f_{c}" for c in K.CLASSES]
    )


@query(
    "load_thresholds",
    """SELECT patient_id, CASE WHEN patient_id % 2 = 0 THEN 2.8::DOUBLE ELSE 3.0 END AS very_low, 3.9::DOUBLE AS low,
       CASE WHEN patient_id % 3 = 0 THEN 9.5::DOUBLE ELSE 11.0 END AS high, 13.9::DOUBLE AS very_high FROM requests""",
)
def _(t):
    key = F.col("patient_id")
    asked = t.requests.select(
        "patient_id",
        F.when(key % 2 == 0, 2.8).alias("very_low"),
        F.lit(None).cast("double").alias("low"),
        F.when(key % 3 == 0, 9.5).alias("high"),
        F.lit(None).cast("double").alias("very_high"),
    )
    stored = t.spark.sql("SELECT 11.0D AS high, CAST(NULL AS DOUBLE) AS low")
    return thresholds.resolve(asked, stored)


# ---- writes --------------------------------------------------------------------------------

BATCH = f"""SELECT patient_id, timestamp, event_type, units, id AS seq FROM insulins
    UNION ALL SELECT patient_id, timestamp, event_type, units + 1, id + 1000000000 FROM insulins"""


def _batch(t):
    rows = t.insulins.select("patient_id", "timestamp", "event_type", "units", F.col("id").alias("seq"))
    again = rows.withColumns({"units": F.col("units") + 1, "seq": F.col("seq") + 1_000_000_000})
    return rows.unionByName(again)


@query(
    "sink_insert_if_absent",
    f"""SELECT patient_id, {ts('timestamp')} AS timestamp, event_type, round(units, 6) AS units FROM (
        SELECT *, row_number() OVER (PARTITION BY patient_id, timestamp, event_type ORDER BY seq) AS rn FROM ({BATCH})) b
        WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM insulins i WHERE i.timestamp < {CUT} AND i.patient_id = b.patient_id
          AND i.timestamp = b.timestamp AND i.event_type = b.event_type)""",
)
def _(t):
    stored = t.insulins.filter(f"timestamp < {CUT}")
    return sinks.rows_to_insert(_batch(t), stored, sinks.FACT_KEYS["insulins"]).drop("seq")


@query(
    "anti_existing_rows",
    f"""SELECT id, patient_id FROM meals m WHERE NOT EXISTS (SELECT 1 FROM glucoses g WHERE g.timestamp < {CUT}
        AND g.patient_id = m.patient_id AND g.timestamp = m.timestamp)""",
)
def _(t):
    stored = t.glucoses.filter(f"timestamp < {CUT}")
    return sinks.anti_existing(t.meals, stored, ["patient_id", "timestamp"]).select("id", "patient_id")


@query(
    "sink_upsert_patients",
    f"""SELECT coalesce(e.external_id, n.external_id) AS external_id, coalesce(e.name, n.name) AS name,
        {day('coalesce(n.dob, e.date_of_birth)')} AS date_of_birth,
        {ts("coalesce(e.created_at, TIMESTAMP '2024-03-01')")} AS created_at,
        {ts("CASE WHEN n.external_id IS NOT NULL THEN TIMESTAMP '2024-03-01' ELSE e.created_at END")} AS updated_at
        FROM patients e FULL OUTER JOIN (SELECT DISTINCT printf('SIM_%06d', user_id * 7) AS external_id,
          'Simulated patient ' || printf('%06d', user_id * 7) AS name, make_date(1990, 1, CAST(1 + user_id % 28 AS INTEGER)) AS dob FROM events) n
        ON n.external_id = e.external_id""",
)
def _(t):
    key = F.col("user_id") * 7
    incoming = t.events.select(
        F.format_string("SIM_%06d", key).alias("external_id"),
        F.format_string("Simulated patient %06d", key).alias("name"),
        F.make_date(F.lit(1990), F.lit(1), (1 + F.col("user_id") % 28).cast("int")).alias("date_of_birth"),
        F.col("event_id").alias("seq"),
    )
    return sinks.upsert_patients(t.patients.drop("id"), incoming, F.lit("2024-03-01").cast("timestamp"))


@query(
    "sink_overwrite_window",
    f"""WITH w AS (SELECT patient_id, max(timestamp) - to_days(7) AS lo, max(timestamp) AS hi FROM glucoses GROUP BY 1)
        SELECT a.patient_id, a.anomaly_type, round(a.severity, 6) AS severity, {ts('detected_at')} AS detected_at, is_acknowledged
        FROM anomalies a JOIN w ON w.patient_id = a.patient_id WHERE NOT (detected_at >= lo AND detected_at <= hi)
        UNION ALL SELECT w.patient_id, 'missed_bolus', 9.5, {ts('hi')}, false FROM w""",
)
def _(t):
    windows = t.glucoses.groupBy("patient_id").agg(F.max("timestamp").alias("range_end"))
    windows = windows.withColumn("range_start", F.col("range_end") - F.expr("interval 7 days"))
    surfaced = windows.select(
        "patient_id",
        F.lit("missed_bolus").alias("anomaly_type"),
        F.lit(80.0).alias("anomaly_strength"),
        F.explode(F.array(F.lit(9.5), F.lit(4.0))).alias("severity"),
        F.lit("").alias("description"),
        F.lit(1.0).alias("residual_mmoll"),
        F.lit(40).alias("duration_min"),
        F.col("range_end").alias("start"),
    )
    out = sinks.overwrite_window(t.anomalies, windows, sinks.persistable(surfaced))
    return out.select("patient_id", "anomaly_type", "severity", "detected_at", "is_acknowledged")


@query(
    "update_acknowledge",
    """SELECT id, patient_id, is_acknowledged OR (severity > 30 AND duration_min % 2 = 0) IS TRUE AS is_acknowledged FROM anomalies""",
)
def _(t):
    strong = t.anomalies.filter("severity > 30")
    owner = F.when(F.col("duration_min") % 2 == 0, F.col("patient_id")).otherwise(F.col("patient_id") + 1)
    acks = strong.select(F.col("id").alias("anomaly_id"), owner.alias("patient_id"))
    return sinks.acknowledge(t.anomalies, acks).select("id", "patient_id", "is_acknowledged")


@query(
    "upload_summary",
    f"""SELECT (SELECT count(DISTINCT patient_id) FROM entity WHERE kind <> 'x') AS patients_count, (SELECT count(*) FROM glucoses) AS glucose_count,
        (SELECT count(*) FROM meals) AS meal_count, (SELECT count(*) FROM insulins) AS insulin_count,
        (SELECT {ts('min(timestamp)')} FROM glucoses) AS date_from, (SELECT {ts('max(timestamp)')} FROM glucoses) AS date_to""",
)
def _(t):
    return sinks.upload_summary(t.glucoses, t.meals, t.insulins)


MERGED = """SELECT coalesce(g.patient_id, m.patient_id, i.patient_id) AS patient_id, coalesce(g.timestamp, m.timestamp, i.timestamp) AS timestamp,
    round_even(g.v, 1) AS glucose_mmoll, round_even(round(i.v, 9), 3) AS insulin_u, round_even(round(m.v, 9), 0) AS cho_grams
    FROM (SELECT patient_id, timestamp, arg_min(glucose_mmoll, id) AS v FROM glucoses WHERE id % 2 = 0 GROUP BY 1, 2) g
    FULL OUTER JOIN (SELECT patient_id, timestamp, sum(carbs) AS v FROM meals GROUP BY 1, 2) m
      ON m.patient_id = g.patient_id AND m.timestamp = g.timestamp
    FULL OUTER JOIN (SELECT patient_id, timestamp, sum(units) AS v FROM insulins GROUP BY 1, 2) i
      ON i.patient_id = coalesce(g.patient_id, m.patient_id) AND i.timestamp = coalesce(g.timestamp, m.timestamp)"""
MERGED = MERGED.replace(" WHERE id % 2 = 0", "")


@query(
    "merge_channels_outer",
    f"""WITH h AS (SELECT patient_id, timestamp, max(glucose_mmoll) AS glucose_mmoll, max(insulin_u) AS insulin_u, max(cho_grams) AS cho_grams
          FROM histories WHERE timestamp < {CUT} GROUP BY 1, 2), n AS ({MERGED})
        SELECT coalesce(h.patient_id, n.patient_id) AS patient_id, {ts('coalesce(h.timestamp, n.timestamp)')} AS timestamp,
          round(coalesce(n.glucose_mmoll, h.glucose_mmoll), 6) AS glucose_mmoll, round(coalesce(n.insulin_u, h.insulin_u), 6) AS insulin_u,
          round(coalesce(n.cho_grams, h.cho_grams), 6) AS cho_grams
        FROM h FULL OUTER JOIN n ON h.patient_id = n.patient_id AND h.timestamp = n.timestamp""",
)
def _(t):
    stored = (
        t.histories.filter(f"timestamp < {CUT}")
        .groupBy("patient_id", "timestamp")
        .agg(*[F.max(c).alias(c) for c in ("glucose_mmoll", "insulin_u", "cho_grams")])
    )
    return sinks.sync_histories(stored, sinks.merge_channels(t.glucoses, t.meals, t.insulins))


@query(
    "build_channel_rows",
    f"""WITH x AS (SELECT patient_id, timestamp, glucose_mmoll AS g, id, NULL AS u, NULL AS c FROM glucoses
        UNION ALL SELECT patient_id, timestamp + to_minutes(k), NULL, NULL, units / span, NULL FROM (
          SELECT *, CASE WHEN event_type = 'basal' THEN 60 ELSE 3 END AS span FROM insulins WHERE units > 0), unnest(range(0, span)) r(k)
        UNION ALL SELECT patient_id, timestamp, NULL, NULL, NULL, carbs FROM meals)
        SELECT patient_id, {ts('timestamp')} AS timestamp, round(arg_max(g, id), 6) AS glucose_mmoll, round(sum(u), 6) AS insulin_u,
          round(sum(c), 6) AS cho_grams FROM x GROUP BY patient_id, timestamp""",
)
def _(t):
    return sinks.build_channel_rows(t.glucoses, t.insulins, t.meals)


# ---- joins ---------------------------------------------------------------------------------


@query(
    "join_patient_fact",
    "SELECT g.id, p.external_id, round(g.glucose_mmoll, 6) AS glucose_mmoll FROM glucoses g JOIN patients p ON p.id = g.patient_id",
)
def _(t):
    owners = t.patients.select(F.col("id").alias("patient_id"), "external_id")
    return joins.lookup_join(t.glucoses, owners, ["patient_id"]).select("id", "external_id", "glucose_mmoll")


@query("semi_patient_in_file", "SELECT id, external_id FROM patients WHERE id IN (SELECT patient_id FROM cohort)")
def _(t):
    ids = t.cohort.select(F.col("patient_id").alias("id"))
    return t.patients.join(ids, "id", "left_semi").select("id", "external_id")


@query(
    "exists_patient",
    "SELECT r.patient_id, EXISTS (SELECT 1 FROM glucoses g WHERE g.patient_id = r.patient_id) AS present FROM requests r",
)
def _(t):
    known = t.glucoses.groupBy("patient_id").agg(F.lit(True).alias("present"))
    return t.requests.join(known, "patient_id", "left").select("patient_id", F.coalesce("present", F.lit(False)).alias("present"))


@query(
    "asof_carb_to_bolus",
    """SELECT patient_id, id, minute, round(coalesce(carb_g, 0), 6) AS carb_g FROM (
       SELECT b.patient_id, b.id, b.minute, c.carb_g, row_number() OVER (PARTITION BY b.id ORDER BY abs(c.minute - b.minute), c.minute, c.id) AS rn
       FROM boluses b LEFT JOIN carbs_list c ON c.patient_id = b.patient_id AND abs(c.minute - b.minute) <= 15) WHERE rn = 1""",
)
def _(t):
    out = joins.nearest_join(t.boluses, t.carbs, "patient_id", "minute", "id", ["carb_g"], K.ANNOUNCE_PAIR_MIN)
    return out.select("patient_id", "id", "minute", F.coalesce("carb_g", F.lit(0.0)).alias("carb_g"))


@query(
    "asof_anomaly_to_reading",
    f"""SELECT g.id, a.id AS anomaly_id FROM glucoses g LEFT JOIN anomalies a ON a.patient_id = g.patient_id
        AND abs(epoch(a.detected_at) - epoch(g.timestamp)) < 900 AND a.detected_at::DATE = g.timestamp::DATE
        AND (a.severity IS NULL OR a.severity >= 6.0)""",
)
def _(t):
    return rules.anomalies_of_readings(t.glucoses, t.anomalies, K.PERSIST_SEVERITY)


@query(
    "interval_bolus_near_meal",
    """SELECT m.patient_id, m.id, m.minute, count(b.minute) AS boluses, min(b.minute) AS first_bolus FROM carbs_list m
       LEFT JOIN boluses b ON b.patient_id = m.patient_id AND b.minute >= m.minute - 10 AND b.minute <= m.minute + 60 GROUP BY 1, 2, 3""",
)
def _(t):
    return rules.boluses_around(t.carbs, t.boluses, K.BOLUS_LEAD, K.LATE_MAX).select(
        "patient_id", "id", "minute", "boluses", "first_bolus"
    )


@query(
    "interval_bolus_cover",
    """SELECT e.patient_id, e.id, e.minute, count(b.minute) AS boluses, min(b.minute) AS first_bolus FROM cgm e
       LEFT JOIN boluses b ON b.patient_id = e.patient_id AND b.minute >= e.minute - 15 AND b.minute <= e.minute + 75
       WHERE e.event_type = 'error' GROUP BY 1, 2, 3""",
)
def _(t):
    onsets = t.cgm.filter("event_type = 'error'").select("patient_id", "id", "minute")
    return rules.boluses_around(onsets, t.boluses, K.DETECT_LOOKBACK, K.DETECT_ATTRIBUTE_MAX)


ICR = """SELECT m.id, m.carb_g / b.units AS icr, row_number() OVER (PARTITION BY m.id ORDER BY abs(b.minute - m.minute), b.minute, b.id) AS rn
    FROM carbs_list m JOIN boluses b ON b.patient_id = m.patient_id AND b.minute >= m.minute - 5 AND b.minute <= m.minute + 60"""


@query(
    "icr_check",
    f"""SELECT count(*) AS meals, round(quantile_cont(icr, 0.5), 6) AS median_icr,
        round(quantile_cont(icr, 0.5), 6) BETWEEN 7 AND 15 AS plausible FROM ({ICR}) WHERE rn = 1""",
)
def _(t):
    return rules.icr_check(t.carbs, t.boluses)


@query(
    "pool_cohorts",
    """SELECT cohort, count(*) AS patients, min(pid) AS first_id FROM (
       SELECT 'small' AS cohort, 'S' || id AS pid FROM patients WHERE id % 3 = 0
       UNION ALL SELECT 'medium', 'M' || id FROM patients WHERE id % 3 = 1
       UNION ALL SELECT 'large', 'L' || id FROM patients WHERE id % 3 = 2) GROUP BY 1""",
)
def _(t):
    def part(i, prefix):
        return t.patients.filter(F.col("id") % 3 == i).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("pid"))

    pooled, shared = joins.disjoint_union({"small": part(0, "S"), "medium": part(1, "M"), "large": part(2, "L")}, "pid")
    clean = pooled.join(shared, "pid", "left_anti")
    return clean.groupBy("cohort").agg(F.count(F.lit(1)).alias("patients"), F.min("pid").alias("first_id"))


# ---- runs and events -----------------------------------------------------------------------


def _islands(flag: str, source: str = "cohort", minute: str = "absolute_minute") -> str:
    return f"""SELECT *, sum(CASE WHEN ton AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER w AS run FROM (
        SELECT *, lag(ton) OVER w AS was FROM (SELECT *, coalesce({flag}, false) AS ton FROM {source})
        WINDOW w AS (PARTITION BY patient_id ORDER BY {minute}))
        WINDOW w AS (PARTITION BY patient_id ORDER BY {minute} ROWS UNBOUNDED PRECEDING)"""


@query(
    "collapse_runs",
    f"""SELECT patient_id, absolute_minute, round(CASE WHEN NOT ton THEN cho_mg_announced WHEN was IS NOT TRUE
        THEN sum(cho_mg_announced) OVER (PARTITION BY patient_id, ton, run) ELSE 0 END, 6) AS collapsed FROM ({_islands('cho_mg_announced > 0')})""",
)
def _(t):
    return events.collapse_runs(t.cohort, "cho_mg_announced").select("patient_id", "absolute_minute", "collapsed")


@query(
    "meal_events",
    f"""SELECT patient_id, absolute_minute, carbs, {MEAL.format(m='clock')} AS meal_type FROM (
        SELECT patient_id, min(absolute_minute) AS absolute_minute, arg_min(minute, absolute_minute) AS clock,
          round_even(round(sum(cho_mg_announced) / 1000.0, 9), 0) AS carbs
        FROM ({_islands('cho_mg_announced > 0')}) WHERE ton GROUP BY patient_id, run) WHERE carbs > 0""",
)
def _(t):
    return events.meal_events(cohort_source.announced_or_consumed(t.cohort))


@query(
    "bolus_events",
    f"""SELECT * FROM (SELECT patient_id, min(absolute_minute) AS absolute_minute,
          round_even(round(sum(insulin_mu_min) / 1000.0, 9), 2) AS units
        FROM ({_islands('insulin_mu_min > 100')}) WHERE ton GROUP BY patient_id, run) WHERE units > 0""",
)
def _(t):
    return events.bolus_events(t.cohort)


@query(
    "basal_events",
    """WITH s AS (SELECT patient_id, absolute_minute AS m, insulin_mu_min AS v, lag(insulin_mu_min) OVER (PARTITION BY patient_id ORDER BY absolute_minute) AS p FROM cohort),
       x AS (SELECT patient_id, m // 60 * 60 AS absolute_minute, round_even(round(sum(v) / 1000.0, 9), 2) AS units, 0 AS k FROM s WHERE v > 0 AND v <= 100 GROUP BY 1, 2
         UNION ALL SELECT patient_id, m, 0.0, 1 FROM s WHERE p > 0 AND p <= 100 AND v <= 0
         UNION ALL SELECT patient_id, m - 1, 0.0, 1 FROM s WHERE v > 0 AND v <= 100 AND p = 0)
       SELECT patient_id, absolute_minute, units FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, absolute_minute ORDER BY k) AS rn FROM x) WHERE rn = 1""",
)
def _(t):
    return events.basal_events(t.cohort)


@query(
    "run_lengths",
    f"""SELECT length, count(*) AS runs FROM (SELECT count(*) AS length FROM ({_islands('NOT valid', 'grid', 'minute')})
        WHERE ton GROUP BY patient_id, run) GROUP BY 1""",
)
def _(t):
    return events.run_bounds(t.grid, ~F.col("valid")).groupBy("length").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "run_bounds",
    f"""SELECT patient_id, min(absolute_minute) AS start, max(absolute_minute) + 1 AS "end", count(*) AS length
        FROM ({_islands("bolus_status = 'normal'")}) WHERE ton GROUP BY patient_id, run""",
)
def _(t):
    return events.run_bounds(t.cohort, F.col("bolus_status") == "normal", "absolute_minute").drop("run")


@query("derive_events")
def _(t):
    meals, boluses = events.derive_events(t.grid, lengths=t.lengths)
    return meals.select("patient_id", "minute", F.lit("meal").alias("kind"), F.col("carb_g").alias("amount")).unionByName(
        boluses.select("patient_id", "minute", F.lit("bolus").alias("kind"), F.col("units").alias("amount"))
    )


@query(
    "exercise_bouts",
    f"""SELECT patient_id, min(absolute_minute) AS absolute_minute, count(*) AS duration_minutes, 'low' AS intensity
        FROM ({_islands('exercise_type IS NOT NULL')}) WHERE ton GROUP BY patient_id, run""",
)
def _(t):
    return events.exercise_bouts(t.cohort)


@query(
    "flag_onsets",
    """WITH s AS (SELECT patient_id, absolute_minute, coalesce(bolus_status = 'missed', false) AS m, coalesce(bolus_status = 'late', false) AS l,
         lag(m) OVER w AS pm, lag(l) OVER w AS pl FROM cohort WINDOW w AS (PARTITION BY patient_id ORDER BY absolute_minute))
       SELECT patient_id, absolute_minute, 'missed_bolus' AS anomaly_type, 0.95::DOUBLE AS confidence FROM s WHERE m AND pm IS NOT TRUE
       UNION ALL SELECT patient_id, absolute_minute, 'late_bolus', 0.9::DOUBLE FROM s WHERE l AND pl IS NOT TRUE""",
)
def _(t):
    status = F.coalesce("bolus_status", F.lit(""))
    return events.flag_onsets(t.cohort, status == "missed", status == "late")


def _median_sql(width: int = 61) -> str:
    half = width // 2
    return f"""WITH n AS (SELECT patient_id, max(minute) + 1 AS T FROM grid GROUP BY 1),
        p AS (SELECT g.patient_id, minute AS pos, insulin, minute, true AS core FROM grid g
          UNION ALL SELECT g.patient_id, -1 - minute, insulin, minute, false FROM grid g WHERE minute < {half}
          UNION ALL SELECT g.patient_id, 2 * T - 1 - minute, insulin, minute, false FROM grid g JOIN n USING (patient_id) WHERE minute >= T - {half}),
        r AS (SELECT patient_id, minute, core, insulin, quantile_disc(insulin, 0.5) OVER (PARTITION BY patient_id ORDER BY pos
          ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS median FROM p)"""


LONG = "SELECT patient_id FROM grid GROUP BY 1 HAVING max(minute) + 1 >= 61"


@query(
    "rolling_median",
    _median_sql() + f" SELECT patient_id, minute, round(median, 6) AS median FROM r WHERE core AND patient_id IN ({LONG})",
)
def _(t):
    # a shorter series has a shrunken window, which the SQL twin does not know
    return series.rolling_median(t.grid, "insulin", lengths=t.lengths.filter("T >= 61")).select("patient_id", "minute", "median")


@query(
    "event_edges",
    _median_sql()
    + """, e AS (SELECT patient_id, minute, insulin - median > 1.5 AS b, lag(b) OVER (PARTITION BY patient_id ORDER BY minute) AS pb FROM r WHERE core),
       c AS (SELECT patient_id, carbs > 0 AS c, lag(c) OVER (PARTITION BY patient_id ORDER BY minute) AS pc FROM grid)
       SELECT x.patient_id, n_carb, n_insulin FROM (SELECT patient_id, count(*) FILTER (c AND pc IS NOT TRUE) AS n_carb FROM c GROUP BY 1) x
       JOIN (SELECT patient_id, count(*) FILTER (b AND pb IS NOT TRUE) AS n_insulin FROM e GROUP BY 1) y USING (patient_id)""",
)
def _(t):
    return events.event_edges(t.grid, bolus_cut=1.5, lengths=t.lengths)


@query(
    "rate_of_change",
    """WITH s AS (SELECT patient_id, minute, glucose, minute - lag(minute) OVER w AS dt, lag(glucose) OVER w AS pg FROM cgm
         WINDOW w AS (PARTITION BY patient_id ORDER BY minute)),
       m AS (SELECT patient_id, quantile_cont(dt, 0.5) AS median_dt FROM s WHERE dt > 0 GROUP BY 1)
       SELECT s.patient_id, minute, dt, round(median_dt, 6) AS median_dt, dt > 1.5 * median_dt AS is_gap,
         CASE WHEN dt <= 1.5 * median_dt THEN round(abs(glucose - pg) / dt, 6) END AS roc
       FROM s JOIN m ON m.patient_id = s.patient_id WHERE dt IS NOT NULL""",
)
def _(t):
    return events.rate_of_change(t.cgm)


@query(
    "event_sessions",
    """WITH s AS (SELECT patient_id, minute, minute - lag(minute) OVER (PARTITION BY patient_id ORDER BY minute) AS d FROM cgm WHERE event_type = 'error'),
       g AS (SELECT *, sum(CASE WHEN d <= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY patient_id ORDER BY minute ROWS UNBOUNDED PRECEDING) AS session FROM s)
       SELECT patient_id, session, min(minute) + 120 AS start_min, max(minute) + 160 AS end_min, count(*) AS windows FROM g
       GROUP BY 1, 2 HAVING max(minute) + 160 - min(minute) - 120 >= 30""",
)
def _(t):
    flagged = t.cgm.filter("event_type = 'error'").select("patient_id", F.col("minute").alias("start"))
    sessions = events.session_bounds(events.event_sessions(flagged))
    return sessions.withColumn("session", F.col("session").cast("long"))
