"""Tables changed part by part, and the streams that keep them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sugartrace.session import scratch_path
from sugartrace.sources import sinks
from sugartrace.sources.parts import PartTable
from sugartrace.streaming import jobs

NOW = dt.datetime(2026, 3, 1, 8)
SCHEMA = "id long, patient_id int, timestamp timestamp, glucose_mmoll double"


def at(minutes):
    return NOW + dt.timedelta(minutes=minutes)


def total(old, new):
    return old.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))


@pytest.fixture
def counts(spark):
    return PartTable(spark, scratch_path(spark, "parts"), "k int, v long", F.col("k") % 4)


def values(table, **which):
    return {r.k: r.v for r in table.read(**which).collect()}


def test_only_touched_parts_change(table, counts):
    rows = lambda *pairs: table(list(pairs), "k int, v long")
    assert values(counts) == {}
    assert counts.merge(rows((1, 1), (2, 2), (5, 3)), total) == ["1", "2"]
    assert counts.merge(rows((1, 10), (None, 7)), total) == ["1", "none"]
    assert values(counts) == {1: 11, 2: 2, 5: 3, None: 7}
    assert values(counts, parts=["2"]) == {2: 2}
    assert values(counts, version=1) == {1: 1, 2: 2, 5: 3}
    assert counts._pointer()["parts"] == {"1": 2, "2": 1, "none": 2}
    assert counts.merge(rows((2, 0)), lambda old, new: old.where("k > 9")) == ["2"]  # a part may become empty
    assert values(counts) == {1: 11, 5: 3, None: 7}
    assert counts.merge(rows(), total) == []
    counts.replace(counts.read().where("k = 5").withColumn("v", F.col("v") + 1))
    assert values(counts) == {5: 4}


def test_batches_count_once(table, counts):
    rows = table([(1, 1)], "k int, v long")
    assert counts.merge(rows, total, "a", 0) == ["1"] and counts.merge(rows, total, "a", 0) == []
    assert counts.merge(rows, total, "b", 0) == ["1"] and counts.merge(rows, total, "a", 1) == ["1"]
    assert values(counts) == {1: 3}


@pytest.mark.parametrize("step", ["_write", "_commit", "_point"])
def test_failures_leave_the_table(table, counts, monkeypatch, step):
    rows = table([(1, 1), (2, 2)], "k int, v long")
    counts.merge(rows, total)
    whole = getattr(counts, step)

    def fails(*args):
        if step == "_write":
            whole(*args)  # the data is there, the pointer is not
        raise OSError(step)

    monkeypatch.setattr(counts, step, fails)
    for change in (lambda: counts.merge(rows, total), lambda: counts.replace(rows)):
        with pytest.raises(OSError):
            change()
        assert values(counts) == {1: 1, 2: 2}
    monkeypatch.setattr(counts, step, whole)
    counts.merge(rows, total)
    assert values(counts) == {1: 2, 2: 4}


def test_moved_rows_and_second_writers_are_refused(table, counts):
    rows = table([(1, 1)], "k int, v long")
    with pytest.raises(ValueError):
        counts.merge(rows, lambda old, new: new.withColumn("k", F.lit(2)))
    counts.merge(rows, total)
    stale = counts._pointer()
    counts.merge(rows, total)
    with pytest.raises(OSError):
        counts._commit(stale, stale["version"] + 1, {})
    assert values(counts) == {1: 2}


def test_vacuum_keeps_what_readers_may_hold(table, counts):
    for v in range(4):
        counts.merge(table([(1, 1), (2 + v % 2, 1)], "k int, v long"), total)
    held = counts.read(version=3)
    assert counts.vacuum(keep=2) == [1] and counts.vacuum(keep=2) == []
    assert {r.k: r.v for r in held.collect()} == {1: 3, 2: 2, 3: 1}
    assert values(counts) == {1: 4, 2: 2, 3: 2} and counts.versions() == [3, 4]


class Arrivals:
    def __init__(self, spark, table):
        self.spark, self.table, self.folder = spark, table, scratch_path(spark, "arrivals")

    def add(self, *rows):
        self.table(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        return self.spark.readStream.schema(SCHEMA).parquet(self.folder)


def test_latest_over_batches_late_rows_and_replays(spark, table):
    arrivals, path, state = Arrivals(spark, table), scratch_path(spark, "latest"), scratch_path(spark, "state")
    newest = lambda t: {r.patient_id: r.id for r in t.read().collect()}
    kept = jobs.keep_latest(arrivals.add((1, 1, at(0), 5.0), (2, 2, at(0), 6.0), (3, 1, at(5), 6.5)), path, state, 8)
    assert newest(kept) == {1: 3, 2: 2}
    before = kept._pointer()["parts"]
    kept = jobs.keep_latest(arrivals.add((4, 1, at(9), 7.0)), path, state, 8)
    after = kept._pointer()["parts"]
    home = str(spark.sql("SELECT pmod(xxhash64(1), 8)").first()[0])
    assert newest(kept) == {1: 4, 2: 2} and {p for p in after if after[p] != before.get(p)} == {home}
    kept = jobs.keep_latest(arrivals.add((5, 1, at(-9000), 7.0), (6, 2, at(0), 1.0)), path, state, 8)  # late; a tie by id
    assert newest(kept) == {1: 4, 2: 6} and kept._pointer()["parts"][home] == after[home]
    assert newest(jobs.keep_latest(arrivals.add(), path, scratch_path(spark, "lost"), 8)) == {1: 4, 2: 6}  # read again


def test_daily_sums_over_a_month_with_late_rows(spark, table):
    arrivals, path, state = Arrivals(spark, table), scratch_path(spark, "daily"), scratch_path(spark, "state")
    rows = [(i, 1 + i % 2, at(180 * i), 4.0 + i % 7) for i in range(8 * 30)] + [(999, 1, None, 5.0), (998, 3, at(0), None)]
    for third in range(3):
        kept = jobs.keep_daily(arrivals.add(*rows[third::3]), path, state)
    expected = {}
    for _, p, t, g in rows:
        if t is not None:
            expected.setdefault((p, t.date()), []).extend([g] if g is not None else [])
    got = {(r.patient_id, r.day.date()): (r.average, r.min, r.max) for r in jobs.daily_view(kept.read()).collect()}
    assert set(got) == set(expected)
    for key, g in expected.items():
        assert got[key] == ((pytest.approx(sum(g) / len(g)), min(g), max(g)) if g else (None, None, None))
    before = kept._pointer()["parts"]
    kept = jobs.keep_daily(arrivals.add((1000, 2, at(0), 30.0)), path, state)  # a month late
    after = kept._pointer()["parts"]
    assert [p for p in after if after[p] != before[p]] == ["2026-03-01"]
    assert kept.read(["2026-03-01"]).where("patient_id = 2").first().max == 30.0


def test_ingest_reads_the_days_of_its_batch(spark, table):
    arrivals, path, state = Arrivals(spark, table), scratch_path(spark, "in"), scratch_path(spark, "state")
    day = 1440
    jobs.ingest(arrivals.add(*[(i, 1, at(day * i), 5.0) for i in range(6)]), path, state).awaitTermination()
    jobs.ingest(arrivals.add((10, 1, at(day * 5), 9.0), (11, 1, at(day * 6), 9.0)), path, state).awaitTermination()
    repeats = [(20, 1, at(0), 9.0), (21, 1, at(day * 5), 9.0), (22, 1, at(day * 5 + 1), 9.0)]
    late = [(23, 1, at(1), 9.0), (24, 1, at(1), 9.0), (25, 1, None, 9.0), (26, None, at(2), 9.0)]
    jobs.ingest(arrivals.add(*repeats, *late), path, state).awaitTermination()
    rows = spark.read.parquet(path)
    ids = {r.id for r in rows.collect()}
    assert ids - {23, 24} == {0, 1, 2, 3, 4, 5, 11, 22} and len(ids & {23, 24}) == 1
    known = jobs.stored(rows.drop("batch"), path, 2, [at(day * 5).date()])
    assert {r.id for r in known.collect()} == {5}
    plan = known._jdf.queryExecution().executedPlan().toString()
    folders = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_day" in folders and "batch" in folders


def test_sessions_join_over_batches_and_midnights(spark, table):
    arrivals, path, state = Arrivals(spark, table), scratch_path(spark, "runs"), scratch_path(spark, "state")
    midnight = 16 * 60
    times = [0, 10, 40, 71, 100, midnight - 20, midnight - 1, midnight + 29, midnight + 60, midnight + 1440 * 3]
    rows = [(i, 1, at(m), 5.0) for i, m in enumerate(times)] + [(90, 2, at(m), 5.0) for m in (0, 0, 31)]
    runs = lambda t: {(r.patient_id, r.first, r.last): r.flags for r in jobs.session_view(t.read()).collect()}
    for third in range(3):
        kept = jobs.keep_sessions(arrivals.add(*rows[third::3]), path, state)
    expected = {
        (1, at(0), at(40)): 3, (1, at(71), at(100)): 2, (1, at(midnight - 20), at(midnight + 29)): 3,
        (1, at(midnight + 60), at(midnight + 60)): 1, (1, at(midnight + 4320), at(midnight + 4320)): 1,
        (2, at(0), at(0)): 2, (2, at(31), at(31)): 1,
    }
    assert runs(kept) == expected
    before = kept._pointer()["parts"]
    kept = jobs.keep_sessions(arrivals.add((95, 1, at(55), 5.0)), path, state)  # late, joins two sessions
    after = kept._pointer()["parts"]
    assert [p for p in after if after[p] != before[p]] == ["2026-03-01"]
    del expected[(1, at(0), at(40))], expected[(1, at(71), at(100))]
    assert runs(kept) == {**expected, (1, at(0), at(100)): 6}


def test_stored_patients_and_anomalies(spark, table):
    known = "external_id string, name string, date_of_birth date, created_at timestamp, updated_at timestamp"
    patients = PartTable(spark, scratch_path(spark, "patients"), known, F.pmod(F.xxhash64("external_id"), F.lit(8)))
    incoming = "external_id string, name string, date_of_birth date, seq int"
    born, later = dt.date(1980, 1, 1), dt.date(1981, 1, 1)
    sinks.store_patients(patients, table([("a", "A", born, 1), ("b", "B", born, 2)], incoming), F.lit(at(0)))
    sinks.store_patients(patients, table([("a", "Z", later, 1), ("c", "C", born, 2)], incoming), F.lit(at(9)))
    got = {r.external_id: (r.name, r.date_of_birth, r.created_at, r.updated_at) for r in patients.read().collect()}
    assert got == {"a": ("A", later, at(0), at(9)), "b": ("B", born, at(0), at(0)), "c": ("C", born, at(9), at(9))}

    stored = "id long, patient_id int, detected_at timestamp, is_acknowledged boolean"
    anomalies = PartTable(spark, scratch_path(spark, "anomalies"), stored, F.pmod(F.xxhash64("patient_id"), F.lit(8)))
    anomalies.replace(table([(i, 1 + i % 3, at(i), False) for i in range(12)], stored))
    windows = table([(1, at(0), at(5)), (7, at(0), at(5))], "patient_id int, range_start timestamp, range_end timestamp")
    sinks.store_window(anomalies, windows, table([(50, 1, at(2), False), (51, 9, at(3), False)], stored))
    rest = {i for i in range(12) if i % 3 or i > 5} | {50, 51}
    assert {r.id for r in anomalies.read().collect()} == rest
    sinks.store_acknowledged(anomalies, table([(50, 1), (4, 1), (8, 3)], "anomaly_id long, patient_id int"))
    assert {r.id for r in anomalies.read().where("is_acknowledged").collect()} == {50, 8}
    assert {r.id for r in anomalies.read().collect()} == rest
