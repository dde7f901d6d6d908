"""Labels, injected errors, artefacts, splits, detector metrics and cohort comparison."""

from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.operators import artifacts, calibrate, compare, detect, events, labels, metrics, rules, splits
from sugartrace.operators import windows as W
from sugartrace.plans.detection import FIVE_DAYS, FLAGS, LEADING, MEAL_LABELS, RENDERED, _dosed, _flat, _labels_sql, _scored
from sugartrace.plans.ingestion import _islands
from sugartrace.plans.oracle_views import folded
from sugartrace.plans.registry import query
from sugartrace.session import materialize

FLAG_LIST = ", ".join(FLAGS)

# ---- labels --------------------------------------------------------------------------------


@query(
    "clean_meals",
    """SELECT patient_id, id, minute, round(carb_g, 6) AS carb_g FROM carbs_list c WHERE carb_g >= 30 AND NOT EXISTS (
       SELECT 1 FROM grid g WHERE g.patient_id = c.patient_id AND g.minute >= c.minute - 30 AND g.minute <= c.minute AND g.glucose < 3.9)""",
)
def _(t):
    return rules.clean_meals(t.carbs, t.grid)


def _meal_labels(t):
    return rules.meal_labels(rules.classify_meals(t.carbs, t.boluses))


CAP = "CASE class WHEN 'missed' THEN 180 WHEN 'late' THEN 240 ELSE 300 END"


@query(
    "label_array",
    f"""WITH l AS (SELECT m.patient_id, x AS minute, max(CAST(class = 'missed' AS DOUBLE)) AS f_missed, max(CAST(class = 'late' AS DOUBLE)) AS f_late,
          max(CAST(class = 'large' AS DOUBLE)) AS f_large FROM ({MEAL_LABELS}) m, unnest(range(minute, minute + {CAP})) u(x) GROUP BY 1, 2)
        SELECT g.patient_id, g.minute, coalesce(f_missed, 0.0) AS f_missed, coalesce(f_late, 0.0) AS f_late, coalesce(f_large, 0.0) AS f_large
        FROM grid g LEFT JOIN l ON l.patient_id = g.patient_id AND l.minute = g.minute""",
)
def _(t):
    intervals = labels.label_intervals(_meal_labels(t), t.grid, "aligned", lengths=t.lengths)
    return labels.label_array(t.grid.select("patient_id", "minute"), intervals)


EXCURSION = f"""WITH m AS (SELECT ml.*, T, least(T, minute + {CAP} + 1) AS hi, least(T, minute + {CAP}) AS fallback FROM ({MEAL_LABELS}) ml
      JOIN (SELECT patient_id, max(minute) + 1 AS T FROM grid GROUP BY 1) n ON n.patient_id = ml.patient_id),
    b AS (SELECT m.id, m.class, avg(g.glucose) AS base FROM m JOIN grid g ON g.patient_id = m.patient_id
      AND g.minute >= m.minute - 30 AND g.minute < m.minute GROUP BY 1, 2),
    s AS (SELECT m.*, base, g.minute AS x, g.glucose AS v, min(CAST(g.glucose >= base + 1.1 AS INTEGER)) OVER w AS up, count(*) OVER w AS n
      FROM m JOIN b ON b.id = m.id AND b.class = m.class JOIN grid g ON g.patient_id = m.patient_id AND g.minute >= m.minute AND g.minute < m.hi
      WINDOW w AS (PARTITION BY m.id, m.class ORDER BY g.minute ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
    o AS (SELECT id, class, min(x) FILTER (up = 1 AND n = 10) AS onset FROM s GROUP BY 1, 2),
    p AS (SELECT s.id, s.class, onset, first(x ORDER BY v DESC, x) AS peak FROM s JOIN o ON o.id = s.id AND o.class = s.class WHERE x >= onset GROUP BY 1, 2, 3),
    d AS (SELECT s.id, s.class, s.x, min(CAST(v <= base + 0.55 AS INTEGER)) OVER w AS dn, count(*) OVER w AS n FROM s
      JOIN p ON p.id = s.id AND p.class = s.class WHERE x >= peak
      WINDOW w AS (PARTITION BY s.id, s.class ORDER BY s.x ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
    r AS (SELECT id, class, min(x) FILTER (dn = 1 AND n = 10) AS ret FROM d GROUP BY 1, 2),
    e AS (SELECT m.patient_id, m.id, m.minute, m.class, p.onset AS s, CASE WHEN p.onset IS NOT NULL
        THEN least(T, greatest(coalesce(ret, fallback), p.onset + 1)) END AS t, T, fallback
      FROM m LEFT JOIN p ON p.id = m.id AND p.class = m.class LEFT JOIN r ON r.id = m.id AND r.class = m.class)"""


@query("excursion_window", EXCURSION + ' SELECT patient_id, id, minute, class, s AS start, t AS "end" FROM e')
def _(t):
    return labels.excursion_windows(_meal_labels(t), t.grid, lengths=t.lengths)


@query(
    "label_intervals_excursion",
    EXCURSION + ' SELECT patient_id, class, coalesce(s, minute) AS start, coalesce(t, fallback) AS "end" FROM e',
)
def _(t):
    return labels.label_intervals(_meal_labels(t), t.grid, "excursion", lengths=t.lengths)


TRUE_RUNS = "SELECT *, row_number() OVER (ORDER BY patient_id, class, true_start) AS id FROM (" + " UNION ALL ".join(
    f"""SELECT patient_id, '{c}' AS class, s AS true_start, e AS true_end, greatest(s - 15, 0) AS minute FROM (
        SELECT patient_id, min(minute) AS s, max(minute) + 1 AS e FROM ({_islands(f'f_{c} > 0', 'flag_grid', 'minute')}) WHERE ton GROUP BY patient_id, run)"""
    for c in K.EXCURSION_CAP
) + ")"


@query(
    "interval_iou",
    f"WITH runs AS ({TRUE_RUNS}), "
    + EXCURSION.replace(MEAL_LABELS, "SELECT patient_id, id, minute, class FROM runs").removeprefix("WITH ")
    + """, x AS (SELECT e.class, s IS NOT NULL AS found, true_end - true_start + t - s AS total,
         greatest(0, least(t, true_end) - greatest(s, true_start)) AS o FROM e JOIN runs ON runs.id = e.id),
       i AS (SELECT class, found, CASE WHEN found THEN o::DOUBLE / (total - o) ELSE 0.0 END AS iou FROM x)
       SELECT class, count(*) AS runs, count(*) FILTER (found) AS found, round(median(iou), 6) AS median_iou,
         round(median(iou) FILTER (found), 6) AS median_iou_found, round(avg(iou), 6) AS mean_iou, round(count(*) FILTER (found) / count(*)::DOUBLE, 6) AS recall FROM i GROUP BY 1""",
)
def _(t):
    grid = materialize(t.flag_grid)  # read for the runs of each class and for the excursions
    truth = materialize(labels.true_runs(grid))
    return labels.placement_quality(materialize(labels.excursion_windows(truth, grid, lengths=t.lengths)))


INJECTED = """(SELECT b.patient_id, CASE WHEN carb_g >= 20 THEN least(T - 1, minute + 30) ELSE minute END AS minute, units, carb_g FROM
    (SELECT patient_id, minute, units, units * 8 AS carb_g FROM boluses) b JOIN (SELECT patient_id, max(minute) + 1 AS T FROM grid GROUP BY 1) n
    ON n.patient_id = b.patient_id)"""


@query("inject_bolus_list", RENDERED.format(src=INJECTED))
def _(t):
    from sugartrace.operators import series

    late = labels.inject_boluses(_dosed(t), t.lengths, "late")
    return series.render_channels(_flat(t), late).drop("basal")


@query(
    "inject_channel",
    """WITH n AS (SELECT patient_id, max(minute) + 1 AS T FROM grid GROUP BY 1),
        p AS (SELECT patient_id, minute, insulin FROM grid
          UNION ALL SELECT patient_id, x, insulin FROM grid, range(-30, 0) r(x) WHERE minute = 0
          UNION ALL SELECT g.patient_id, T + x, insulin FROM grid g JOIN n ON n.patient_id = g.patient_id, range(0, 30) r(x) WHERE minute = T - 1),
        b AS (SELECT patient_id, minute, median(insulin) OVER (PARTITION BY patient_id ORDER BY minute ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS basal FROM p),
        x AS (SELECT g.*, greatest(0.0, insulin - basal) AS bolus, count(*) FILTER (carbs <= 0) OVER (PARTITION BY g.patient_id ORDER BY g.minute) AS run
          FROM grid g JOIN (SELECT patient_id AS pid, minute AS mi, basal FROM b) ON pid = g.patient_id AND mi = g.minute),
        k AS (SELECT patient_id AS pid, run AS kept, min(minute) AS onset FROM x WHERE carbs > 0 GROUP BY 1, 2 HAVING sum(carbs) >= 20),
        m AS (SELECT x.patient_id, minute, run, onset, carbs AS c, bolus FROM x JOIN k ON pid = x.patient_id AND kept = run WHERE carbs > 0),
        f AS (WITH RECURSIVE moved AS (SELECT patient_id, minute + 30 AS minute, run, c FROM m
            UNION ALL SELECT m.patient_id, m.minute + 30, m.run, moved.c FROM moved JOIN m
              ON m.patient_id = moved.patient_id AND m.minute = moved.minute AND m.run <> moved.run) SELECT * FROM moved),
        a AS (SELECT patient_id AS pid, minute AS mi, sum(i) AS i, sum(c) AS c FROM (
            SELECT patient_id, minute + 30 AS minute, bolus AS i, 0.0 AS c FROM m
            UNION ALL SELECT patient_id, minute, 0.0, c FROM f WHERE NOT EXISTS (
              SELECT 1 FROM m WHERE m.patient_id = f.patient_id AND m.minute = f.minute AND m.run <> f.run)) GROUP BY 1, 2),
        y AS (SELECT patient_id AS pm, minute AS mm, bolus AS taken, onset FROM m)
        SELECT x.patient_id, x.minute, round(glucose, 6) AS glucose, valid,
          round(insulin - coalesce(taken, 0) + coalesce(i, 0), 6) AS insulin,
          round(CASE WHEN onset IS NULL THEN carbs ELSE 0 END + coalesce(c, 0), 6) AS carbs,
          CASE WHEN onset = x.minute THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag
        FROM x LEFT JOIN y ON pm = x.patient_id AND mm = x.minute LEFT JOIN a ON pid = x.patient_id AND mi = x.minute""",
)
def _(t):
    return labels.inject_channel(t.grid, "late", min_total=20.0, lengths=t.lengths)


def _artifact_query(name: str, build):
    @query(name)
    def _(t):
        grid = materialize(t.grid)  # read for the days and for the rows
        rows = grid.withColumn("artifact", F.lit(K.ARTEFACT_CODES["clean"]))
        cfg = artifacts.Artefacts(jumps=artifacts.Jumps(14.0), dips=artifacts.Dips(28.0))
        return build(rows, materialize(artifacts.patient_days(grid)), cfg).select(
            "patient_id", "minute", "glucose", "valid", "artifact"
        )


_artifact_query("artifact_jumps", artifacts.add_jumps)
_artifact_query("artifact_compression", artifacts.add_compressions)
_artifact_query("artifact_dropouts", artifacts.add_dropouts)


@query("apply_artifacts")
def _(t):
    return artifacts.apply_artifacts(t.grid).select("patient_id", "minute", "glucose", "valid", "artifact")


# ---- splits --------------------------------------------------------------------------------


def _drawn(seed: int, *ids: str) -> str:
    """Order of a seeded draw: the digest, then the ids."""
    return f"md5('{seed}' || {' || '.join(chr(39) + ':' + chr(39) + ' || CAST(' + i + ' AS VARCHAR)' for i in ids)}), {', '.join(ids)}"


@query(
    "patient_split",
    f"""SELECT patient_id, CASE WHEN rn < floor(n * 0.6) THEN 'train' WHEN rn < floor(n * 0.6) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT id AS patient_id, row_number() OVER (ORDER BY {_drawn(42, 'id')}) - 1 AS rn, count(*) OVER () AS n
              FROM (SELECT DISTINCT id FROM patients))""",
)
def _(t):
    return splits.patient_split(t.patients.select(F.col("id").alias("patient_id")))


@query(
    "cohort_split",
    f"""SELECT patient_id, CASE WHEN rn < 15 THEN 'train' WHEN rn < 18 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT patient_id, row_number() OVER (ORDER BY {_drawn(42, 'patient_id')}) - 1 AS rn FROM (SELECT DISTINCT patient_id FROM cohort))""",
)
def _(t):
    return splits.cohort_split(t.cohort)


@query(
    "pooled_split",
    f"""WITH c AS (SELECT id AS patient_id, CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS cohort FROM patients),
          r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY {_drawn(42, 'patient_id')}) - 1 AS rn FROM c)
        SELECT patient_id, cohort, 'test' AS split FROM r WHERE rn < CASE cohort WHEN 'a' THEN 7 ELSE 4 END
        UNION ALL SELECT patient_id, cohort, CASE WHEN row_number() OVER (ORDER BY {_drawn(43, 'patient_id')}) <= 6 THEN 'val' ELSE 'train' END
        FROM r WHERE rn >= CASE cohort WHEN 'a' THEN 7 ELSE 4 END""",
)
def _(t):
    cohort = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c")
    ids = t.patients.select(F.col("id").alias("patient_id"), cohort.alias("cohort"))
    return splits.pooled_split(ids, {"a": 7, "b": 4, "c": 4})


def _pools(t):
    return W.contrastive_pools(t.flags, t.lengths, 60, K.TRAIN_STRIDE)


@query(
    "balanced_batches",
    f"""WITH p AS (SELECT patient_id, start, greatest({FLAG_LIST}) = 0 AS is_normal FROM ({_labels_sql(60, 15)})),
          r AS (SELECT *, row_number() OVER (PARTITION BY is_normal ORDER BY {_drawn(42, 'patient_id', 'start')}) - 1 AS rn,
                count(*) FILTER (is_normal) OVER () // 7 AS b, count(*) FILTER (NOT is_normal) OVER () AS na FROM p),
          s AS (SELECT DISTINCT rn // 7 AS batch, na, i FROM r, unnest(range(0, 3)) AS u(i) WHERE is_normal AND rn // 7 < b)
        SELECT rn // 7 AS batch, patient_id, start, is_normal FROM r WHERE is_normal AND rn // 7 < b
        UNION ALL SELECT batch, patient_id, start, is_normal FROM s JOIN r ON NOT is_normal AND rn = (batch * 3 + i) % s.na""",
)
def _(t):
    return splits.balanced_batches(materialize(_pools(t)), 10)


@query(
    "cap_per_class",
    f"""SELECT patient_id, start, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {_drawn(42, 'patient_id', 'start')}) AS rn
        FROM (SELECT patient_id, start, CASE WHEN f_missed > 0 THEN 'missed' WHEN f_late > 0 THEN 'late' WHEN f_large > 0 THEN 'large'
        WHEN f_prolonged > 0 THEN 'prolonged' WHEN f_anaerobic > 0 THEN 'anaerobic' ELSE 'normal' END AS class FROM ({_labels_sql(120, 15)})))
        WHERE rn <= 50""",
)
def _(t):
    from sugartrace.functions import scalars

    rows = W.window_labels(t.flags, t.lengths, K.CONTEXT_LEN, K.TRAIN_STRIDE)
    named = rows.select("patient_id", "start", scalars.window_class([F.col(f) for f in FLAGS]).alias("class"))
    return splits.cap_per_class(named, 50)


# ---- metrics -------------------------------------------------------------------------------


def _labelled(t):
    """Scored windows with the flags of their horizon, written once."""
    return materialize(metrics.with_any(detect.score_series_flagged(t.grid, t.flags), FLAGS))


LABELLED = f"""SELECT s.*, {FLAG_LIST}, CAST(greatest({FLAG_LIST}) > 0 AS DOUBLE) AS any_class FROM scored s
    JOIN horizon_flags h ON h.patient_id = s.patient_id AND h.start = s.start"""
ALL = [*FLAGS, "any_class"]
LONG = f"WITH l AS (SELECT round(score, 9) AS score, direction, {', '.join(ALL)} FROM ({LABELLED})), u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS label, score, CAST({c} > 0 AS INTEGER) AS y FROM l" for c in ALL
) + ")"
CURVE = """, g AS (SELECT label, score, count(*) AS n, sum(y) AS p FROM u GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY label) AS tp, sum(n) OVER (PARTITION BY label) AS tn FROM g
      WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
RANKING = CURVE + """, k AS (SELECT label, CAST(max(tp) AS BIGINT) AS positives,
      CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN sum((n - p) * (cp - 0.5 * p)) / (max(tp) * (max(tn) - max(tp))) END AS auroc,
      CASE WHEN max(tp) > 0 THEN sum(p * cp / cn::DOUBLE) / max(tp) END AS auprc FROM c GROUP BY 1)"""


def _settled(t):
    return _labelled(t).withColumn("score", F.round("score", 9))


@query("auroc", LONG + RANKING + " SELECT label, positives, round(auroc, 6) AS auroc FROM k")
def _(t):
    return metrics.ranking_metrics(_settled(t), ALL).select("label", "positives", "auroc")


@query("auprc", LONG + RANKING + " SELECT label, positives, round(auprc, 6) AS auprc FROM k")
def _(t):
    return metrics.ranking_metrics(_settled(t), ALL).select("label", "positives", "auprc")


@query(
    "pr_curve",
    LONG + CURVE + " SELECT label, round(score, 6) AS threshold, round(cp / cn::DOUBLE, 6) AS precision, round(cp / tp::DOUBLE, 6) AS recall FROM c WHERE tp > 0",
)
def _(t):
    return metrics.pr_curve(_settled(t), ALL)


@query(
    "score_histogram",
    f"""WITH l AS (SELECT round(score, 9) AS score, any_class FROM ({LABELLED})), e AS (SELECT min(score) AS lo, quantile_cont(score, 0.995) AS hi FROM l),
        b AS (SELECT CAST(least(floor((score - lo) / ((hi - lo) / 79)), 78) AS BIGINT) AS bin, any_class, lo, (hi - lo) / 79 AS w FROM l, e WHERE score <= hi),
        c AS (SELECT bin, count(*) FILTER (any_class = 0) AS normal, count(*) FILTER (any_class > 0) AS anomalous, max(lo) AS lo, max(w) AS w FROM b GROUP BY 1)
        SELECT bin, round(lo + bin * w, 6) AS left_edge, normal, anomalous, round(normal / ((SELECT sum(normal) FROM c) * w), 6) AS normal_density,
          round(anomalous / ((SELECT sum(anomalous) FROM c) * w), 6) AS anomalous_density FROM c""",
)
def _(t):
    return metrics.score_histogram(_settled(t))


SWEEP_ROWS = f"""SELECT (score - median) / sigma AS severity, direction, f_missed > 0 OR f_late > 0 AS y FROM ({LABELLED}) l
    JOIN robust r ON r.patient_id = l.patient_id"""


@query(
    "severity_sweep",
    f"""WITH s AS ({SWEEP_ROWS}), k AS (SELECT c::DOUBLE AS cutoff, gated FROM (VALUES (2), (4), (6), (8), (10), (15), (20), (30)) c(c), (VALUES (false), (true)) g(gated)),
        x AS (SELECT cutoff, gated, count(severity) AS shown, count(*) FILTER (y AND severity IS NOT NULL) AS hits FROM k LEFT JOIN s
          ON severity >= cutoff AND (NOT gated OR direction >= 0) GROUP BY 1, 2), t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (y)::DOUBLE AS p FROM s)
        SELECT cutoff, gated, shown, CASE WHEN shown > 0 THEN round(hits / shown::DOUBLE, 6) END AS precision, round(hits / p, 6) AS recall,
          round(shown / (n * 5 / 1440.0), 6) AS per_day, CASE WHEN shown > 0 THEN round((hits / shown::DOUBLE) / (p / n), 6) END AS lift FROM x, t""",
)
def _(t):
    scored = _labelled(t)
    rated = calibrate.severity(scored, calibrate.robust_baseline(scored))
    return metrics.severity_sweep(rated, (F.col("f_missed") > 0) | (F.col("f_late") > 0))


@query(
    "fp_at_artifacts",
    f"""WITH l AS (SELECT round(score, 9) AS score, f_missed, f_large > 0 OR f_late > 0 AS artifact FROM ({LABELLED})),
        t AS (SELECT median(score) + 2.0 * greatest((quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.349, 1e-6) AS thr FROM l)
        SELECT round(max(thr), 6) AS threshold, count(*) FILTER (artifact AND f_missed = 0) AS artifact_windows,
          round(count(*) FILTER (artifact AND f_missed = 0 AND score > thr) / nullif(count(*) FILTER (artifact AND f_missed = 0), 0)::DOUBLE, 6) AS artifact_fp_rate,
          count(*) FILTER (NOT artifact AND f_missed = 0) AS normal_windows,
          round(count(*) FILTER (NOT artifact AND f_missed = 0 AND score > thr) / nullif(count(*) FILTER (NOT artifact AND f_missed = 0), 0)::DOUBLE, 6) AS normal_fp_rate
        FROM l, t""",
)
def _(t):
    rows = _settled(t).select(
        "score", F.col("f_missed").alias("label"), ((F.col("f_large") > 0) | (F.col("f_late") > 0)).alias("artifact")
    )
    return metrics.false_positives_at_artifacts(rows, rows.select("score"))


@query(
    "over_detection",
    folded(
        f"""WITH a AS ({LEADING}), r AS (SELECT patient_id, threshold FROM robust)
        SELECT 'leading' AS arm, count(*) AS windows, count(*) FILTER (score > threshold) AS flagged,
          round(count(*) FILTER (score > threshold) / nullif(count(*), 0)::DOUBLE, 6) AS share
        FROM scored s JOIN a ON a.patient_id = s.patient_id WHERE start >= 7200
        UNION ALL SELECT 'all', count(*), count(*) FILTER (score > threshold),
          round(count(*) FILTER (score > threshold) / nullif(count(*), 0)::DOUBLE, 6)
        FROM scored s JOIN r ON r.patient_id = s.patient_id WHERE start >= 7200""",
        4,
    ),
)
def _(t):
    scored = _scored(t.merged(4))
    held_out = scored.filter(F.col("start") >= 5 * K.MINUTES_PER_DAY)
    return metrics.over_detection(
        held_out, {"leading": calibrate.threshold_leading(scored, FIVE_DAYS), "all": calibrate.robust_baseline(scored, written=True)}
    )


@query(
    "recall_by_class",
    """WITH p AS (SELECT CAST(label AS VARCHAR) AS true_class, CAST(CASE WHEN embedding[1] > 0 THEN label ELSE vec_id % 3 END AS VARCHAR) AS pred_class,
         embedding[2]::DOUBLE AS u, embedding[3]::DOUBLE AS d FROM embeddings),
       c AS (SELECT true_class, count(*) AS n, count(*) FILTER (true_class = pred_class) / count(*)::DOUBLE AS recall, avg(u) AS u, avg(d) AS d FROM p GROUP BY 1)
       SELECT true_class, n, round(recall, 6) AS recall, round(u, 6) AS mean_uncertainty, round(d, 6) AS mean_distance,
         round((SELECT avg(recall) FROM c), 6) AS balanced_accuracy FROM c""",
)
def _(t):
    e = F.col("embedding")
    rows = t.read("embeddings").select(
        F.col("label").cast("string").alias("true_class"),
        F.when(e[0] > 0, F.col("label").cast("long")).otherwise(F.col("vec_id") % 3).cast("string").alias("pred_class"),
        e[1].cast("double").alias("uncertainty"),
        e[2].cast("double").alias("distance"),
    )
    return metrics.recall_by_class(rows)


@query(
    "model_compare",
    f"""WITH l AS (SELECT round(score, 9) AS a, round(direction, 9) AS b, {FLAG_LIST} FROM ({LABELLED})), u AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{m}' AS model, '{c}|{m}' AS label, {s} AS score, CAST({c} > 0 AS INTEGER) AS y FROM l"
        for c in FLAGS
        for m, s in (("end", "a"), ("dir", "b"))
    )
    + ")"
    + RANKING
    + """, w AS (SELECT split_part(label, '|', 1) AS label, max(auprc) FILTER (label LIKE '%|end') AS auprc_end, max(auprc) FILTER (label LIKE '%|dir') AS auprc_dir,
         max(auroc) FILTER (label LIKE '%|end') AS auroc_end, max(auroc) FILTER (label LIKE '%|dir') AS auroc_dir FROM k GROUP BY 1)
       SELECT w.label, round(auprc_end, 6) AS auprc_end, round(auprc_dir, 6) AS auprc_dir, round(auroc_end, 6) AS auroc_end, round(auroc_dir, 6) AS auroc_dir,
         round(r.prevalence, 6) AS prevalence FROM w LEFT JOIN (SELECT name AS label, avg(y) AS prevalence FROM u GROUP BY 1) r ON r.label = w.label
       UNION ALL SELECT 'mean', round(avg(auprc_end), 6), round(avg(auprc_dir), 6), round(avg(auroc_end), 6), round(avg(auroc_dir), 6), NULL FROM w""",
)
def _(t):
    rows = _settled(t).withColumn("direction", F.round("direction", 9))
    return metrics.model_compare(rows, {"end": "score", "dir": "direction"}, FLAGS)


# ---- cohorts -------------------------------------------------------------------------------

STEPS = """s AS (SELECT patient_id, CASE patient_id % 3 WHEN 0 THEN 'sim' WHEN 1 THEN 'north' ELSE 'south' END AS cohort, minute, glucose,
      minute - lag(minute) OVER w AS dt, lag(glucose) OVER w AS pg FROM cgm WINDOW w AS (PARTITION BY patient_id ORDER BY minute)),
    m AS (SELECT patient_id, median(dt) AS med FROM s WHERE dt > 0 GROUP BY 1),
    r AS (SELECT s.*, dt > 1.5 * med AS gap, CASE WHEN dt <= 1.5 * med THEN abs(glucose - pg) / dt END AS roc FROM s JOIN m USING (patient_id))"""
POOL = f"""WITH {STEPS},
    d AS (SELECT cohort, count(*) AS n_pat, avg(days) AS dpp, sum(days) AS days FROM (SELECT cohort, patient_id, (max(minute) - min(minute)) / 1440.0 AS days
      FROM r GROUP BY 1, 2) GROUP BY 1),
    i AS (SELECT CASE patient_id % 3 WHEN 0 THEN 'sim' WHEN 1 THEN 'north' ELSE 'south' END AS cohort, count(*) AS n FROM boluses GROUP BY 1),
    c AS (SELECT CASE patient_id % 3 WHEN 0 THEN 'sim' WHEN 1 THEN 'north' ELSE 'south' END AS cohort, count(*) AS n FROM carbs_list GROUP BY 1)
    SELECT cohort, d.n_pat, round(dpp, 6) AS days_per_pat, round(median(dt), 6) AS dt_min, round(100.0 * count(*) FILTER (gap) / count(dt), 6) AS gap_pct,
      round(avg(glucose), 6) AS glu_mean, round(stddev_pop(glucose), 6) AS glu_std, round(100.0 * count(*) FILTER (glucose < 3.9) / count(*), 6) AS hypo_pct,
      round(100.0 * count(*) FILTER (glucose > 10.0) / count(*), 6) AS hyper_pct, round(stddev_pop(roc), 6) AS roc_std,
      round(max(i.n) / max(days), 6) AS ins_per_day, round(max(c.n) / max(days), 6) AS carb_per_day
    FROM r JOIN d USING (cohort) JOIN i USING (cohort) JOIN c USING (cohort) GROUP BY cohort, d.n_pat, dpp"""


def _cohorts(t):
    name = F.when(F.col("patient_id") % 3 == 0, "sim").when(F.col("patient_id") % 3 == 1, "north").otherwise("south")
    return t.cgm.select("patient_id", name.alias("cohort"), "minute", "glucose")


def _counts(t):
    return t.cgm.groupBy("patient_id").agg(
        F.count_if(F.col("units") > 0).alias("n_insulin"), F.count_if(F.col("carb_g") > 0).alias("n_carb")
    )


@query("gap_assess", POOL)
def _(t):
    return compare.pool_stats(_cohorts(t), _counts(t))


@query("pool_stats", POOL.replace("CASE patient_id % 3 WHEN 0 THEN 'sim' WHEN 1 THEN 'north' ELSE 'south' END", "'all'"))
def _(t):
    return compare.pool_stats(_cohorts(t).withColumn("cohort", F.lit("all")), _counts(t))


PATIENT = f"""WITH {STEPS}, q AS (SELECT cohort, patient_id, avg(glucose) AS glu_mean, stddev_pop(glucose) AS glu_std,
      100.0 * stddev_pop(glucose) / avg(glucose) AS cv, 100.0 * count(*) FILTER (glucose >= 3.9 AND glucose <= 10.0) / count(*) AS tir_pct,
      100.0 * count(*) FILTER (glucose < 3.9) / count(*) AS hypo_pct, 100.0 * count(*) FILTER (glucose > 10.0) / count(*) AS hyper_pct,
      100.0 * count(*) FILTER (glucose > 13.9) / count(*) AS vhyper_pct, stddev_pop(roc) AS roc_std FROM r GROUP BY 1, 2 HAVING count(*) >= 100)"""


@query("patient_metrics", folded(PATIENT + f" SELECT patient_id, {', '.join(f'round({m}, 6) AS {m}' for m in compare.METRICS)} FROM q", 60))
def _(t):
    return compare.patient_metrics(t.merged(60).cgm.select("patient_id", "minute", "glucose"))


def _bands(t):
    rows = _cohorts(t.merged(60))
    per_patient = compare.patient_metrics(rows)
    return compare.cohort_bands(per_patient.join(rows.select("patient_id", "cohort").distinct(), "patient_id"))


BANDS = PATIENT + ", v AS (" + " UNION ALL ".join(
    f"SELECT cohort, '{m}' AS metric, {m} AS v FROM q" for m in compare.METRICS
) + """), b AS (SELECT cohort, metric, count(v) AS n, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90
    FROM v GROUP BY 1, 2)"""


@query(
    "cohort_bands",
    folded(BANDS + " SELECT cohort, metric, n, round(p50, 6) AS p50, round(p10, 6) AS p10, round(p90, 6) AS p90 FROM b", 60),
)
def _(t):
    return _bands(t)


@query(
    "spread_ratio",
    folded(
        BANDS
        + """ SELECT r.cohort, r.metric, round((s.p90 - s.p10) / (r.p90 - r.p10), 6) AS ratio, (s.p90 - s.p10) / (r.p90 - r.p10) < 0.6 AS too_narrow
        FROM b r JOIN b s ON s.metric = r.metric AND s.cohort = 'sim' WHERE r.cohort <> 'sim'""",
        60,
    ),
)
def _(t):
    return compare.spread_ratio(_bands(t))


STATUS_RUNS = " UNION ALL ".join(
    f"SELECT patient_id, min(absolute_minute) AS minute, '{c}' AS truth FROM ({_islands(repr(c) + ' = bolus_status')}) WHERE ton GROUP BY patient_id, run"
    for c in ("missed", "late")
)


@query(
    "detection_rule_validation",
    f"""WITH e AS ({STATUS_RUNS} UNION ALL SELECT patient_id, min(absolute_minute), 'normal' FROM ({_islands('cho_mg_announced > 0')})
          WHERE ton GROUP BY patient_id, run HAVING bool_and(coalesce(bolus_status, 'normal') = 'normal')),
        b AS (SELECT patient_id, min(absolute_minute) AS m FROM ({_islands('insulin_mu_min > 100')}) WHERE ton GROUP BY patient_id, run),
        f AS (SELECT e.*, (SELECT min(m) FROM b WHERE b.patient_id = e.patient_id AND m >= e.minute - 15 AND m <= e.minute + 75) AS fb FROM e),
        g AS (SELECT *, CASE WHEN fb IS NULL THEN 'missed' WHEN fb - minute >= 15 THEN 'late' END AS p FROM f),
        c AS (SELECT count(*) FILTER (truth = 'missed' AND p = 'missed') AS tm, count(*) FILTER (truth = 'missed' AND p IS DISTINCT FROM 'missed') AS nm,
          count(*) FILTER (truth = 'late' AND p = 'missed') AS pm, count(*) FILTER (truth = 'late' AND p = 'late') AS tl,
          count(*) FILTER (truth = 'late' AND p IS DISTINCT FROM 'late') AS nl, count(*) FILTER (truth = 'missed' AND p = 'late') AS pl,
          count(*) FILTER (truth = 'normal') AS n, count(*) FILTER (truth = 'normal' AND p IS NOT NULL) AS nf FROM g)
        SELECT CASE WHEN tm > 0 THEN round(2 * tm / (2 * tm + pm + nm)::DOUBLE, 6) ELSE 0.0 END AS f1_missed,
          CASE WHEN tl > 0 THEN round(2 * tl / (2 * tl + pl + nl)::DOUBLE, 6) ELSE 0.0 END AS f1_late, n AS normal_meals,
          round(nf / n::DOUBLE, 6) AS normal_flagged_share FROM c""",
)
def _(t):
    minute = "absolute_minute"
    status = F.coalesce("bolus_status", F.lit("normal"))

    def runs(flag):
        return events.run_bounds(t.cohort, flag, minute)

    marked = None
    for name in ("missed", "late"):
        part = runs(status == name).select("patient_id", F.col("start").alias("minute"), F.lit(name).alias("truth"))
        marked = part if marked is None else marked.unionByName(part)
    announced = events.announced_runs(t.cohort.withColumn("status", status)).filter("all_normal")
    normal = announced.select("patient_id", "minute", F.lit("normal").alias("truth"))
    boluses = runs(F.col("insulin_mu_min") > K.BASAL_BOLUS_CUT_MU).select("patient_id", F.col("start").alias("minute"))
    return metrics.detection_rule_validation(marked.unionByName(normal), boluses)
