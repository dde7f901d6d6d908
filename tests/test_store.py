"""Requests read the days and row groups they ask for."""

import glob
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sugartrace.bindings import Tables
from sugartrace.operators import timerange
from sugartrace.plans import basic  # noqa: F401
from sugartrace.plans.registry import QUERIES
from sugartrace.sources.store import NAMED, EventStore

BEGIN = datetime(2024, 3, 1)
REQUESTS = "patient_id long, start timestamp, end timestamp, last string"


@pytest.fixture
def readings(spark):
    """Forty days of hourly readings of 150 patients; patient 7 stops after ten days, patient 1 holds a third of the rows."""
    hours = spark.range(40 * 24).select(F.timestamp_add("HOUR", F.col("id"), F.lit(BEGIN)).alias("timestamp"), F.col("id").alias("h"))
    rows = hours.crossJoin(spark.range(150).select(F.col("id").alias("patient_id"))).filter("patient_id <> 7 OR h < 240")
    busy = hours.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(75)))).select(
        F.timestamp_add("SECOND", F.col("k"), F.col("timestamp")).alias("timestamp"), "h", F.lit(1).cast("long").alias("patient_id")
    )
    return rows.unionByName(busy).withColumn("id", F.monotonically_increasing_id())


def requests(spark, *rows):
    return spark.createDataFrame(rows, REQUESTS)


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def scanned(df):
    """Files the executed scan opened, by its own metric."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec" and "day" in node.requiredSchema().simpleString() + node.relation().partitionSchema().simpleString():
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return sum(found)


def test_windows_read_their_days_only(spark, readings, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    store.append(readings.filter(F.col("timestamp") >= F.lit(BEGIN + timedelta(days=20))))
    store.append(readings.filter(F.col("timestamp") < F.lit(BEGIN + timedelta(days=20))))
    last = BEGIN + timedelta(hours=40 * 24 - 1)
    assert {r.patient_id: r.timestamp for r in store.latest().collect()}[2] == last
    ask = requests(spark, (2, None, None, "24h"), (3, None, None, "24h"))
    inside = store.window(store.resolve(ask))
    expected = [(p, last - timedelta(hours=k)) for p in (2, 3) for k in range(25)]
    assert sorted((r.patient_id, r.timestamp) for r in inside.collect()) == sorted(expected)
    plan = formatted(inside)
    assert re.search(r"PartitionFilters: .*day#\d+L? >= ", plan)
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(timestamp", plan)
    assert re.search(r"PushedFilters: .*In\(patient_id", plan)

    files = {n: scanned(store.window(store.resolve(requests(spark, (2, None, None, n))))) for n in ("24h", "1w", "1m")}
    everything = len(glob.glob(str(tmp_path / "s/facts/day=*/*.parquet")))
    assert files["24h"] < files["1w"] < files["1m"] < everything
    assert files["24h"] <= everything / 10

    # A patient's last day is counted back from that patient's own newest reading.
    old = store.window(store.resolve(requests(spark, (7, None, None, "24h")))).collect()
    assert (min(r.timestamp for r in old), len(old)) == (BEGIN + timedelta(hours=239 - 24), 25)


def test_odd_requests(spark, readings, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    store.append(readings.limit(0))
    assert store.latest().count() == 0
    store.append(readings.filter("patient_id < 12"))
    unknown, broken = (500, None, None, "24h"), (3, None, None, "x")
    assert store.window(store.resolve(requests(spark, unknown))).count() == 0
    assert store.window(store.resolve(requests(spark, broken))).count() == 0
    assert store.window(store.resolve(requests(spark, unknown, broken, (4, None, None, "24h")))).count() == 25
    assert store.window(store.resolve(requests(spark).limit(0))).count() == 0
    both = (5, BEGIN, BEGIN + timedelta(hours=3), None)
    assert store.window(store.resolve(requests(spark, both))).count() == 4
    many = [(p, None, None, "24h") for p in range(NAMED + 20)]
    assert store.window(store.resolve(requests(spark, *many))).groupBy("patient_id").count().count() == 12


def test_busy_days_are_split(spark, readings, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        EventStore(spark, str(tmp_path / "s")).append(readings.filter(F.col("timestamp") < F.lit(BEGIN + timedelta(days=1))))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(str(tmp_path / "s/facts/day=2024-03-01/*.parquet"))) > 1


def test_span(spark):
    row = "patient_id long, range_start timestamp, range_end timestamp"
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 2)
    bounds = spark.createDataFrame([(1, a, b), (2, None, None), (3, a - timedelta(1), a)], row)
    low, high = timerange.span(bounds)
    assert high - low == 2 * 86_400_000_000
    assert timerange.span(bounds.filter("patient_id = 2")) == (None, None)
    assert timerange.span(bounds.withColumn("_all", F.col("patient_id") == 2)) == (None, None)
    assert timerange.span(bounds.withColumn("_all", F.lit(None).cast("boolean"))) == (low, high)


def test_registered_queries_push_their_bounds(spark, tmp_path):
    folder = str(tmp_path)
    source = Tables(spark, "/root/testdata/sf0.001")
    source.read("events").write.parquet(f"{folder}/events.parquet")
    source.read("customer").limit(2).write.parquet(f"{folder}/customer.parquet")
    for name in ("time_in_range", "window_filter_glucoses", "window_filter_meals", "patients_by_tir", "patients_by_anomalies"):
        assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(ts,.*LessThan\(ts,", formatted(QUERIES[name](Tables(spark, folder)))), name


def test_tables_of_a_time(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    low, high = (int(datetime.fromisoformat(f"2024-01-{d}T00:00:00+00:00").timestamp() * 1e6) for d in ("05", "09"))
    inside = F.col("timestamp").between(F.timestamp_micros(F.lit(low)), F.timestamp_micros(F.lit(high)))
    assert tables.during(low, high).glucoses.filter(inside).count() == tables.glucoses.filter(inside).count() > 0
    assert tables.during(None, None).glucoses.count() == tables.glucoses.count()
