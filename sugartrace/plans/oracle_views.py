"""The entity views of `bindings.Tables` as SQL, for the independent check."""

import re

STATUS = """CASE WHEN {x} < 3.0 THEN 'very_low' WHEN {x} < 3.9 THEN 'low' WHEN {x} <= 10.0 THEN 'in_range'
 WHEN {x} <= 13.9 THEN 'high' ELSE 'very_high' END"""

MEAL = """CASE WHEN {m} >= 300 AND {m} < 540 THEN 'breakfast' WHEN {m} >= 660 AND {m} < 840 THEN 'lunch'
 WHEN {m} >= 1020 AND {m} < 1320 THEN 'dinner' ELSE 'snack' END"""


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


VIEWS = {
    "patients": """SELECT c_custkey AS id, printf('SIM_%06d', c_custkey) AS external_id, c_name AS name,
        make_date(CAST(1950 + c_custkey % 50 AS INTEGER), CAST(1 + c_custkey % 12 AS INTEGER),
                  CAST(1 + c_custkey % 28 AS INTEGER)) AS date_of_birth,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey % 1000) AS created_at
        FROM customer""",
    "entity": """SELECT event_id AS id, user_id AS patient_id, date_trunc('minute', ts) AS timestamp, event_type AS kind, value
        FROM events""",
    "glucoses": f"""SELECT id, patient_id, timestamp, 2.5 + value % 12.0 AS glucose_mmoll,
        {STATUS.format(x='(2.5 + value % 12.0)')} AS status FROM entity""",
    "insulins": """SELECT id, patient_id, timestamp, value % 10.0 AS units,
        CASE WHEN kind = 'purchase' THEN 'bolus' ELSE 'basal' END AS event_type
        FROM entity WHERE kind IN ('purchase', 'signup')""",
    "meals": f"""SELECT id, patient_id, timestamp, value % 90.0 AS carbs,
        CASE WHEN id % 7 = 0 THEN NULL ELSE
        {MEAL.format(m='(hour(timestamp) * 60 + minute(timestamp))')} END AS meal_type
        FROM entity WHERE kind = 'click'""",
    "exercises": """SELECT id, patient_id, timestamp, 10 + id % 50 AS duration_minutes,
        CASE id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS intensity
        FROM entity WHERE kind = 'view'""",
    "anomalies": """SELECT id, patient_id,
        CASE WHEN id % 2 = 0 THEN 'missed_bolus' ELSE 'late_bolus' END AS anomaly_type,
        value / 500.0 AS confidence,
        CASE WHEN id % 11 = 0 THEN NULL ELSE value / 10.0 END AS severity,
        CASE WHEN id % 13 = 0 THEN NULL ELSE value % 8.0 - 4.0 END AS residual_mmoll,
        30 + id % 120 AS duration_min, id % 3 = 0 AS is_acknowledged, timestamp AS detected_at
        FROM entity WHERE kind = 'error'""",
    "histories": """SELECT id, patient_id, timestamp,
        CASE WHEN kind IN ('view', 'error') THEN 2.5 + value % 12.0 END AS glucose_mmoll,
        CASE WHEN kind IN ('purchase', 'signup') THEN value % 10.0 END AS insulin_u,
        CASE WHEN kind = 'click' THEN value % 90.0 END AS cho_grams FROM entity""",
    "requests": """SELECT c_custkey AS patient_id,
        CASE c_custkey % 5 WHEN 0 THEN '24h' WHEN 1 THEN '7d' WHEN 2 THEN '2w' WHEN 3 THEN '1m' END AS last,
        CASE WHEN c_custkey % 7 < 2 THEN TIMESTAMP '2024-01-10 00:00:00' END AS req_start,
        CASE WHEN c_custkey % 7 > 0 AND c_custkey % 7 < 3 THEN TIMESTAMP '2024-01-20 00:00:00' END AS req_end
        FROM customer""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events""",
    "cgm": """SELECT user_id AS patient_id, event_id AS id,
        5 * (rn - 1) + 5 * ((rn - 1) // 29) + CASE WHEN user_id % 5 = 0 AND rn > 25 THEN 60 ELSE 0 END AS minute,
        2.5 + value % 12.0 AS glucose,
        CASE WHEN event_type = 'purchase' THEN value % 10.0 END AS units,
        CASE WHEN event_type = 'click' THEN value % 90.0 END AS carb_g, event_type
        FROM numbered""",
    "boluses": "SELECT patient_id, id, minute, units FROM cgm WHERE units > 0",
    "carbs_list": "SELECT patient_id, id, minute, carb_g FROM cgm WHERE carb_g > 0",
    "sampled": """SELECT patient_id, minute, glucose, units / 3.0 AS insulin, carb_g AS carbs,
        lead(minute) OVER w AS next_minute, lead(glucose) OVER w AS next_glucose
        FROM cgm WINDOW w AS (PARTITION BY patient_id ORDER BY minute)""",
    "grid": """SELECT patient_id, m AS minute,
        CASE WHEN m = s.minute THEN glucose
             ELSE glucose + (next_glucose - glucose) / (next_minute - s.minute) * (m - s.minute) END AS glucose,
        CASE WHEN m = s.minute THEN coalesce(insulin, 0.0) ELSE 0.0 END AS insulin,
        CASE WHEN m = s.minute THEN coalesce(carbs, 0.0) ELSE 0.0 END AS carbs,
        m = s.minute OR next_minute - s.minute <= 30 AS valid
        FROM sampled s, unnest(range(s.minute, coalesce(s.next_minute, s.minute + 1))) AS u(m)""",
    "flags": """SELECT patient_id, minute,
        CAST(id % 5 = 0 AS DOUBLE) AS f_missed, CAST(id % 5 = 1 AS DOUBLE) AS f_late,
        CAST(id % 5 = 2 AS DOUBLE) AS f_large, CAST(id % 5 = 3 AS DOUBLE) AS f_prolonged,
        CAST(id % 5 = 4 AS DOUBLE) AS f_anaerobic FROM cgm WHERE event_type = 'error'""",
    "flag_grid": """SELECT g.*, coalesce(f_missed, 0.0) AS f_missed, coalesce(f_late, 0.0) AS f_late,
        coalesce(f_large, 0.0) AS f_large, coalesce(f_prolonged, 0.0) AS f_prolonged,
        coalesce(f_anaerobic, 0.0) AS f_anaerobic
        FROM grid g LEFT JOIN flags f ON f.patient_id = g.patient_id AND f.minute = g.minute""",
    "cohort": """SELECT user_id AS patient_id, CAST(18 + user_id % 48 AS DOUBLE) AS patient_age_years,
        (rn - 1) // 1440 AS day, (rn - 1) % 1440 AS minute, rn - 1 AS absolute_minute,
        2.5 + value % 12.0 AS blood_glucose,
        CASE WHEN event_type = 'click' THEN value * 100 ELSE 0.0 END AS cho_mg_announced,
        CASE WHEN event_id % 9 <> 0 THEN (value * 10.0) % 150.0 ELSE 0.0 END AS insulin_mu_min,
        CASE WHEN event_id % 17 = 0 THEN 'missed' WHEN event_id % 17 = 1 THEN 'late'
             WHEN event_id % 17 < 8 THEN 'normal' END AS bolus_status,
        CASE WHEN event_id % 19 = 0 THEN 'large' WHEN event_id % 19 < 9 THEN 'normal' END AS meal_size,
        CASE WHEN event_id % 23 = 0 THEN 'prolonged' WHEN event_id % 23 = 1 THEN 'anaerobic'
             WHEN event_id % 23 < 4 THEN 'aerobic' END AS exercise_type,
        1 + user_id % 3 AS base_scenario
        FROM numbered""",
    "bounds": """SELECT patient_id, range_start, range_end FROM (
        SELECT r.patient_id, req_start, req_end, latest,
          CASE WHEN req_start IS NULL AND req_end IS NULL AND last IS NULL THEN '2w'
               WHEN last IS NULL THEN '2w' ELSE last END AS period,
          coalesce(req_end, latest) AS anchor,
          CASE right(period, 1) WHEN 'h' THEN to_hours(CAST(left(period, -1) AS INTEGER))
               WHEN 'd' THEN to_days(CAST(left(period, -1) AS INTEGER))
               WHEN 'w' THEN to_days(7 * CAST(left(period, -1) AS INTEGER))
               ELSE to_months(CAST(left(period, -1) AS INTEGER)) END AS span,
          CASE WHEN req_start IS NOT NULL THEN req_start ELSE anchor - span END AS range_start,
          CASE WHEN req_start IS NOT NULL AND req_end IS NOT NULL THEN req_end
               WHEN req_start IS NOT NULL THEN req_start + span ELSE anchor END AS range_end
        FROM requests r LEFT JOIN (SELECT patient_id, max(timestamp) AS latest FROM {table} GROUP BY 1) t
          ON t.patient_id = r.patient_id)""",
}
BOUNDS = VIEWS.pop("bounds")
for _table in ("glucoses", "insulins", "meals", "histories"):
    VIEWS[f"{_table}_bounds"] = BOUNDS.format(table=_table)

VIEWS |= {
    "zgrid": """SELECT g.patient_id, g.minute, (g.glucose - s.m) / s.d AS z, g.valid, s.d AS scale FROM grid g JOIN (
        SELECT patient_id, avg(glucose) AS m, greatest(stddev_pop(glucose), 1e-8) AS d FROM grid GROUP BY 1) s
        ON s.patient_id = g.patient_id""",
    "scored": """SELECT patient_id, start, score, direction FROM (
        SELECT patient_id, minute AS start, avg(z * z) OVER tail AS score, avg(z) OVER tail AS direction,
          bool_and(valid) OVER whole AS ok, count(*) OVER whole AS n FROM zgrid
        WINDOW tail AS (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN 150 FOLLOWING AND 159 FOLLOWING),
          whole AS (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN CURRENT ROW AND 159 FOLLOWING))
        WHERE n = 160 AND ok AND start % 5 = 0""",
    "horizon_flags": """SELECT * FROM (SELECT patient_id, minute AS start, count(*) OVER whole AS n,
        max(f_missed) OVER h AS f_missed, max(f_late) OVER h AS f_late, max(f_large) OVER h AS f_large,
        max(f_prolonged) OVER h AS f_prolonged, max(f_anaerobic) OVER h AS f_anaerobic FROM flag_grid
        WINDOW h AS (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN 120 FOLLOWING AND 159 FOLLOWING),
          whole AS (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN CURRENT ROW AND 159 FOLLOWING))
        WHERE n = 160 AND start % 5 = 0""",
}


def _quartiles(source: str) -> str:
    return f"""SELECT patient_id, max(total) AS total, count(*) AS n, median(score) AS median,
        greatest((quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.349, 1e-6) AS sigma FROM ({source}) GROUP BY 1"""


def _next_pass(before: str) -> str:
    kept = f"""SELECT s.*, b.total FROM scored s JOIN {before} b USING (patient_id) WHERE s.score <= b.median + 2.0 * b.sigma"""
    return f"""SELECT b.patient_id, b.total, CASE WHEN q.n >= greatest(b.total // 2, 1) THEN q.n ELSE b.n END AS n,
        CASE WHEN q.n >= greatest(b.total // 2, 1) THEN q.median ELSE b.median END AS median,
        CASE WHEN q.n >= greatest(b.total // 2, 1) THEN q.sigma ELSE b.sigma END AS sigma
        FROM {before} b LEFT JOIN ({_quartiles(kept)}) q ON q.patient_id = b.patient_id"""


VIEWS["pass0"] = _quartiles("SELECT *, count(*) OVER (PARTITION BY patient_id) AS total FROM scored")
for _i in (1, 2, 3):
    VIEWS[f"pass{_i}"] = _next_pass(f"pass{_i - 1}")
VIEWS |= {
    "robust": "SELECT patient_id, n AS kept, median, sigma, median + 2.0 * sigma AS threshold FROM pass3",
    "session_rows": """SELECT *, sum(CASE WHEN gap <= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY patient_id ORDER BY start
        ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT s.*, median, sigma,
          start - lag(start) OVER (PARTITION BY s.patient_id ORDER BY start) AS gap
        FROM scored s JOIN robust r ON r.patient_id = s.patient_id WHERE score > threshold)""",
    "detected_raw": """SELECT patient_id, session, min(start) + 120 AS start_min, max(start) + 160 AS end_min,
        max(start) + 40 - min(start) AS duration_min, max(score) AS score, first(direction ORDER BY score DESC, start) AS direction,
        (max(score) - max(median)) / max(sigma) AS severity FROM session_rows GROUP BY 1, 2 HAVING max(start) + 40 - min(start) >= 30""",
    "detected": """SELECT d.*, CASE WHEN fb IS NULL THEN CASE WHEN direction < 0 THEN NULL ELSE 'missed' END
        WHEN fb - start_min >= 15 THEN 'late' END AS rule_label FROM (
        SELECT e.*, (SELECT min(b.minute) FROM boluses b WHERE b.patient_id = e.patient_id
          AND b.minute >= e.start_min - 15 AND b.minute <= e.start_min + 75) AS fb FROM detected_raw e) d""",
}

FOLDED = (
    "events", "entity", "numbered", "cgm", "boluses", "carbs_list", "sampled", "grid", "zgrid", "scored", "pass0", "pass1", "pass2",
    "pass3", "robust", "session_rows", "detected_raw", "detected",
)


def folded(sql: str, patients: int) -> str:
    """The statement over the tables of `bindings.Merged`."""
    return re.sub(rf"\b({'|'.join(FOLDED)})\b", rf"m{patients}_\1", sql)


for _n in (4, 60):
    VIEWS |= {f"m{_n}_{name}": folded(VIEWS[name], _n) for name in FOLDED if name != "events"}
    VIEWS[f"m{_n}_events"] = f"SELECT * REPLACE (user_id % {_n} AS user_id) FROM events"
    _plain, _high = "% 12.0 AS glucose,", "% 12.0 + CASE WHEN rn % 311 < 12 THEN 9.0 ELSE 0.0 END AS glucose,"
    VIEWS[f"m{_n}_cgm"] = VIEWS[f"m{_n}_cgm"].replace(_plain, _high)
