"""The event table replayed as a stream through the streaming operators."""

from pyspark.sql import functions as F

from sugartrace.plans.oracle_views import day, ts
from sugartrace.plans.registry import query
from sugartrace.session import scratch_path
from sugartrace.streaming import jobs


def _stream(t):
    """Glucose readings as they arrive: the table's file is read as a source of new files."""
    schema = t.read("events").schema
    rows = t.spark.readStream.schema(schema).parquet(f"{t.folder}/events.parque[t]")
    return rows.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("patient_id"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("timestamp"),
        (F.lit(2.5) + F.col("value") % 12.0).alias("glucose_mmoll"),
        "event_type",
    )


@query("stream_ingest_dedupe", f"SELECT DISTINCT patient_id, {ts('timestamp')} AS timestamp FROM glucoses")
def _(t):
    target = scratch_path(t.spark, "ingest")
    jobs.ingest(_stream(t), target, scratch_path(t.spark, "ingest-state")).awaitTermination()
    return t.spark.read.parquet(target).select("patient_id", "timestamp")


@query(
    "stream_daily_summary",
    f"""SELECT patient_id, {ts('d')} AS day, round(avg(glucose_mmoll), 6) AS average, round(min(glucose_mmoll), 6) AS min,
        round(max(glucose_mmoll), 6) AS max FROM (SELECT *, date_trunc('day', timestamp) AS d FROM glucoses) GROUP BY patient_id, d""",
)
def _(t):
    table = jobs.keep_daily(_stream(t), scratch_path(t.spark, "daily"), scratch_path(t.spark, "daily-state"))
    return jobs.daily_view(table.read())


@query(
    "stream_event_sessions",
    f"""WITH s AS (SELECT patient_id, id, timestamp, epoch(timestamp) - epoch(lag(timestamp) OVER (PARTITION BY patient_id ORDER BY timestamp, id)) AS d
          FROM glucoses), g AS (SELECT *, sum(CASE WHEN d <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY patient_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS n FROM s)
        SELECT patient_id, {ts('min(timestamp)')} AS first, {ts('max(timestamp)')} AS last, count(*) AS flags FROM g GROUP BY patient_id, n""",
)
def _(t):
    table = jobs.keep_sessions(_stream(t), scratch_path(t.spark, "sessions"), scratch_path(t.spark, "sessions-state"))
    return jobs.session_view(table.read())


@query(
    "stream_latest",
    f"""SELECT patient_id, id, {ts('timestamp')} AS timestamp, round(glucose_mmoll, 6) AS glucose_mmoll FROM (
        SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp DESC, id DESC) AS rn FROM glucoses) WHERE rn = 1""",
)
def _(t):
    return jobs.keep_latest(_stream(t), scratch_path(t.spark, "latest"), scratch_path(t.spark, "latest-state")).read()
