"""Aggregates, time ranges, lists, splits, artefacts and writes on small literal tables."""

import datetime as dt
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.functions import scalars
from sugartrace.operators import aggregates as agg
from sugartrace.operators import artifacts, compare, ranking, splits, timerange
from sugartrace.session import materialize, scratch_path
from sugartrace.sources import sinks
from sugartrace.streaming import jobs

NOW = dt.datetime(2024, 5, 1, 12, 0)
READING = "id long, patient_id int, timestamp timestamp, glucose_mmoll double, status string"


def readings(table, values, patient=1, step=10):
    return table([(i, patient, NOW - dt.timedelta(minutes=step * i), v, "x") for i, v in enumerate(values)], READING)


def test_time_in_range(table):
    everyone = table([(1,), (2,)], "patient_id int")
    out = {r.patient_id: r for r in agg.time_in_range(readings(table, [5.6, 11.1]), everyone).collect()}
    assert (out[1].in_range, out[1].high, out[1].span_days) == (50.0, 50.0, 0)
    assert tuple(out[2])[1:] == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert agg.time_in_range(readings(table, [12.0, 6.0, 6.5])).collect()[0].in_range == 66.7


def test_average_and_estimates(table):
    average = agg.average_glucose(readings(table, [5.0, 7.0]))
    assert average.collect()[0].average_mmoll == 6.0
    row = agg.hba1c(average).collect()[0]
    assert row.percent == round((46.7 + 6.0 * 18.018) / 28.7, 1)
    assert row.mmol_per_mol == round((row.percent - 2.152) / 0.09148)
    assert agg.gmi(average).collect()[0].gmi == round(3.31 + 0.02392 * 6 * 18.018, 1)


def test_daily_summary(table):
    out = agg.daily_summary(readings(table, [5.0, 7.0, 9.0])).collect()
    assert [(r.average, r.min, r.max) for r in out] == [(7.0, 5.0, 9.0)]


REQUEST = "patient_id int, start timestamp, end timestamp, last string"


def test_windows(table):
    start, end = dt.datetime(2024, 1, 31, 5), dt.datetime(2024, 3, 31, 7)
    asked = table(
        [(1, start, end, "x"), (2, start, None, "1m"), (3, None, end, "1m"), (4, None, None, "2h"), (5, None, None, None),
         (6, start, None, None), (7, None, None, "0d"), (8, None, None, "7y")], REQUEST)
    anchor = table([(i, p, NOW, 1.0, "x") for i, p in enumerate(range(1, 9))], READING)
    out = {r.patient_id: (r.range_start, r.range_end) for r in timerange.resolve(asked, anchor).collect()}
    assert out[1] == (start, end)
    assert out[2] == (start, dt.datetime(2024, 2, 29, 5))
    assert out[3] == (dt.datetime(2024, 2, 29, 7), end)
    assert out[4] == (NOW - dt.timedelta(hours=2), NOW)
    assert out[5] == (NOW - dt.timedelta(days=14), NOW)
    assert out[6] == (start, start + dt.timedelta(days=14))
    assert out[7] == out[8] == (None, None)


def test_window_keeps_both_ends(table):
    rows = table([(i, 1, NOW - dt.timedelta(minutes=m), 5.0, "x") for i, m in enumerate((0, 50, 110, 120, 180))], READING)
    bounds = timerange.resolve(table([(1, None, None, "2h")], REQUEST), rows)
    assert sorted(r.id for r in timerange.in_window(rows, bounds).collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize(("dob", "day", "age"), [
    ("2000-02-29", "2023-02-28", 22), ("2000-02-29", "2023-03-01", 23), ("1990-05-02", "2024-05-01", 33), ("1990-05-01", "2024-05-01", 34)])
def test_age(table, dob, day, age):
    df = table([(dob, day)], "a string, b string").select(
        scalars.patient_age(F.col("a").cast("date"), F.col("b").cast("date")).alias("age"))
    assert df.collect()[0].age == age


def test_status_edges_differ_between_loaders(table):
    df = table([(v,) for v in (2.99, 3.0, 3.9, 10.0, 13.9, 14.0)], "v double").orderBy("v")
    out = df.select(scalars.glucose_status(F.col("v")).alias("a"), scalars.glucose_status(F.col("v"), inclusive=False).alias("b")).collect()
    assert [r.a for r in out] == ["very_low", "low", "in_range", "in_range", "high", "very_high"]
    assert [r.b for r in out] == ["very_low", "low", "in_range", "high", "very_high", "very_high"]


def test_describe_and_convert(table):
    df = table([(-2.25, 45, "late_bolus"), (None, 45, "late_bolus")], "r double, d int, t string")
    text = scalars.describe_anomaly(F.col("r"), F.col("d"), F.col("t"), "mmol/L", F.lit("stored"))
    assert sorted(r.x for r in df.select(text.alias("x")).collect()) == [
        "Glucose ran 2.3 mmol/L below forecast for 45 min · covering bolus arrived late", "stored"]
    assert df.limit(1).select(scalars.convert_glucose(F.lit(5.5), "mg/dL").alias("x")).collect()[0].x == 99.0


def test_patient_pages(table):
    people = table([(i, f"n{i % 3}", dt.date(1990 + i % 4, 1, 1), NOW) for i in range(10)],
                   "id long, name string, date_of_birth date, created_at timestamp")
    out = ranking.patients_page(people, "name", True, 2, 4).collect()
    assert [r.id for r in out] == [1, 4, 7, 2] and {(r.total, r.pages) for r in out} == {(10, 3)}
    young = ranking.patients_page(people, "age", True, 1, 3).collect()
    assert [r.id for r in young] == [7, 3, 6]


def test_insert_if_absent_first_wins_and_reruns_add_nothing(spark, table):
    keys = sinks.FACT_KEYS["glucoses"]
    schema = "patient_id int, timestamp timestamp, glucose_mmoll double, seq int"
    path = scratch_path(spark, "target")
    table([(1, NOW, 5.0, 0)], schema).drop("seq").write.parquet(path)
    later = NOW + dt.timedelta(minutes=5)
    batch = table([(1, NOW, 9.0, 0), (1, later, 6.0, 1), (1, later, 7.0, 2)], schema)
    for _ in range(2):
        sinks.append_new(batch, path, keys)
        assert sorted(r.glucose_mmoll for r in spark.read.parquet(path).collect()) == [5.0, 6.0]


def test_swap_writes_over_its_own_input(spark, table):
    path = scratch_path(spark, "swap")
    table([(1, False), (2, False)], "id int, is_acknowledged boolean").write.parquet(path)
    for _ in range(2):
        sinks.write_swapped(spark.read.parquet(path).withColumn("is_acknowledged", F.col("id") == 1), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, True), (2, False)]


def test_acknowledge_needs_the_right_patient(table):
    stored = table([(1, 10, False), (2, 20, False)], "id long, patient_id int, is_acknowledged boolean")
    acks = table([(1, 10), (2, 10)], "anomaly_id long, patient_id int")
    out = {r.id: r.is_acknowledged for r in sinks.acknowledge(stored, acks).collect()}
    assert out == {1: True, 2: False}


def test_channel_rows_spread_insulin(table):
    glucose = table([(1, 1, NOW, 5.0), (2, 1, NOW, 6.0)], "id long, patient_id int, timestamp timestamp, glucose_mmoll double")
    insulin = table([(1, NOW, 3.0, "bolus"), (1, NOW, 60.0, "basal"), (1, NOW, 0.0, "basal")],
                    "patient_id int, timestamp timestamp, units double, event_type string")
    meals = table([(1, NOW, 20.0), (1, NOW, 5.0)], "patient_id int, timestamp timestamp, carbs double")
    out = sinks.build_channel_rows(glucose, insulin, meals).orderBy("timestamp").collect()
    assert len(out) == 60 and (out[0].glucose_mmoll, out[0].insulin_u, out[0].cho_grams) == (6.0, 2.0, 25.0)
    assert [r.insulin_u for r in out[1:4]] == [2.0, 2.0, 1.0]


def test_splits_are_exact_disjoint_and_repeatable(table):
    ids = table([(i,) for i in range(50)], "patient_id long")
    once = {r.patient_id: r.split for r in splits.patient_split(ids).collect()}
    assert once == {r.patient_id: r.split for r in splits.patient_split(ids.repartition(7)).collect()}
    assert sorted(map(list(once.values()).count, ("train", "val", "test"))) == [10, 10, 30]
    assert once != {r.patient_id: r.split for r in splits.patient_split(ids, seed=7).collect()}
    fixed = [r.split for r in splits.cohort_split(ids).collect()]
    assert [fixed.count(s) for s in ("train", "val", "test")] == [15, 3, 32]
    named = ids.withColumn("cohort", F.when(F.col("patient_id") < 25, "a").when(F.col("patient_id") < 37, "b").otherwise("c"))
    out = splits.pooled_split(named, {"a": 7, "b": 4, "c": 4}).collect()
    tests = [r.cohort for r in out if r.split == "test"]
    assert sorted(map(tests.count, "abc")) == [4, 4, 7] and sum(r.split == "val" for r in out) == 6 and len(out) == 50


def test_balanced_batches_cycle_anomalies(table):
    rows = [(1, i, i % 8 != 0) for i in range(40)]
    out = splits.balanced_batches(table(rows, "patient_id int, start long, is_normal boolean"), 10).collect()
    per = {}
    for r in out:
        per.setdefault(r.batch, []).append(r.is_normal)
    assert len(per) == 5 and all(sum(b) == 7 and len(b) == 10 for b in per.values())
    used = [r.start for r in out if not r.is_normal]
    assert {used.count(s) for s in set(used)} == {3} and len(set(used)) == 5


def flat(table, days=3, patients=(1, 2)):
    return table([(p, m, 8.0, True) for p in patients for m in range(1440 * days)], "patient_id int, minute long, glucose double, valid boolean")


def test_artifacts_off_is_identity(table):
    grid = flat(table, 1)
    out = artifacts.apply_artifacts(grid, artifacts.Artefacts(on=False))
    assert out.filter("glucose <> 8.0 OR NOT valid OR artifact <> 0").count() == 0


def test_artifacts_repeat_and_hold_their_bounds(table):
    cfg = artifacts.Artefacts(jumps=artifacts.Jumps(14.0), dips=artifacts.Dips(14.0), gaps=artifacts.Gaps(0.1))
    grid = flat(table)
    rows = artifacts.apply_artifacts(grid, cfg)
    first, again = sorted(map(tuple, rows.collect())), sorted(map(tuple, artifacts.apply_artifacts(grid.repartition(5), cfg).collect()))
    assert first == again
    glucose = [r.glucose for r in rows.collect()]
    assert min(glucose) >= K.SENSOR_FLOOR
    share = rows.agg(F.avg((~F.col("valid")).cast("double"))).collect()[0][0]
    assert 0.04 < share < 0.2
    assert rows.filter("(artifact = 1) = valid").count() == 0
    assert first != sorted(map(tuple, artifacts.apply_artifacts(grid, artifacts.Artefacts(seed=1)).collect()))


def test_jumps_persist_and_dropouts_draw_a_line(table):
    cfg = artifacts.Artefacts(jumps=artifacts.Jumps(28.0))
    grid = flat(table, 3, (1,)).withColumn("artifact", F.lit(0))
    days = artifacts.patient_days(grid)
    deltas = {r.minute: r.delta for r in artifacts.jumps(days, cfg).collect()}
    out = artifacts.add_jumps(grid, days, cfg, block=100).orderBy("minute").collect()
    level = 8.0
    for r in out:
        level += deltas.get(r.minute, 0.0)
        assert r.glucose == pytest.approx(level)
    ramp = grid.withColumn("glucose", F.col("minute").cast("double"))
    dropped = artifacts.add_dropouts(ramp, days, cfg, block=77).orderBy("minute").collect()
    lost = [r.minute for r in dropped if not r.valid]
    assert lost and all(abs(r.glucose - r.minute) <= 1.0 for r in dropped if 0 < r.minute < 4319)


def test_pool_stats_and_bands(table):
    rng = np.random.default_rng(5)
    rows = [("a" if p < 5 else "b", p, 5 * i + (100 if i > 60 else 0), float(rng.normal(7 + p % 5, 1 + p % 3))) for p in range(10) for i in range(120)]
    samples = table(rows, "cohort string, patient_id int, minute long, glucose double")
    counts = table([(p, 10, 5) for p in range(10)], "patient_id int, n_insulin long, n_carb long")
    out = {r.cohort: r for r in compare.pool_stats(samples, counts).collect()}
    days = (5 * 119 + 100) / 1440
    assert out["a"].n_pat == 5 and out["a"].dt_min == 5.0 and out["a"].days_per_pat == pytest.approx(days)
    assert out["a"].gap_pct == pytest.approx(100 / 119) and out["a"].ins_per_day == pytest.approx(10 / days)
    metrics = compare.patient_metrics(samples.drop("cohort")).join(samples.select("cohort", "patient_id").distinct(), "patient_id")
    bands = compare.cohort_bands(metrics)
    row = bands.filter("cohort = 'a' AND metric = 'glu_mean'").collect()[0]
    means = [np.mean([g for _, q, _, g in rows if q == p]) for p in range(5)]
    assert np.allclose((row.p10, row.p50, row.p90), np.quantile(means, [0.1, 0.5, 0.9]))
    ratio = compare.spread_ratio(bands, simulated="a").filter("metric = 'glu_mean'").collect()[0]
    assert ratio.cohort == "b" and ratio.too_narrow == (ratio.ratio < 0.6)
    assert compare.patient_metrics(samples.drop("cohort"), least=121).count() == 0


def test_streams_over_arriving_files(spark, table):
    source, target = scratch_path(spark, "in"), scratch_path(spark, "out")
    state = scratch_path(spark, "state")
    schema = "id long, patient_id int, timestamp timestamp, glucose_mmoll double"
    at = lambda m: NOW + dt.timedelta(minutes=m)
    table([(1, 1, at(0), 5.0), (2, 1, at(0), 6.0), (3, 1, at(30), 7.0)], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    jobs.ingest(stream, target, state).awaitTermination()
    table([(4, 1, at(30), 8.0), (5, 1, at(70), 9.0)], schema).coalesce(1).write.mode("append").parquet(source)
    jobs.ingest(stream, target, state).awaitTermination()
    assert sorted(r.timestamp for r in spark.read.parquet(target).collect()) == [at(0), at(30), at(70)]
    run = partial(jobs.run_to_table, mode="complete")
    run(jobs.event_sessions(stream), target + "-s", state + "-s")
    assert [(r.first, r.last) for r in spark.read.parquet(target + "-s").orderBy("first").collect()] == [(at(0), at(30)), (at(70), at(70))]
    run(jobs.latest(stream), target + "-l", state + "-l")
    assert [r.id for r in spark.read.parquet(target + "-l").collect()] == [5]
    run(jobs.daily_summary(stream), target + "-d", state + "-d")
    assert [(r.average, r.min, r.max) for r in spark.read.parquet(target + "-d").collect()] == [(7.0, 5.0, 9.0)]


def test_dropouts_are_drawn_where_the_day_is(table, capsys):
    days = materialize(artifacts.patient_days(flat(table, 2)))
    gaps = artifacts.dropouts(days, artifacts.Artefacts())
    gaps.explain()
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan and "Exchange" not in plan
    assert gaps.count() > 0


def test_artifacts_read_their_grid_once(table, capsys):
    out = artifacts.apply_artifacts(flat(table, 2))
    out.explain()
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan and "ExistingRDD" not in plan
    assert out.count() == 2 * 2 * 1440


@pytest.mark.parametrize("missing", [False, True])
def test_jumps_count_on_rows_that_are_there(table, missing):
    cfg = artifacts.Artefacts(jumps=artifacts.Jumps(280.0))
    grid = flat(table, 2, (1,)).withColumn("artifact", F.lit(0))
    grid = grid.filter("minute % 7 <> 3") if missing else grid
    days = artifacts.patient_days(grid)
    deltas = {}
    for r in artifacts.jumps(days, cfg).collect():
        deltas[r.minute] = deltas.get(r.minute, 0.0) + r.delta
    level = 8.0
    for r in artifacts.add_jumps(grid, days, cfg, block=100).orderBy("minute").collect():
        level += deltas.get(r.minute, 0.0)
        assert r.glucose == pytest.approx(level) and (r.artifact != 0) == (r.minute in deltas)
