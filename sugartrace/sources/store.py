"""Stored events by day: requests read the days they ask for, and the newest reading of a patient is kept.

Layout under the store's folder: `facts/day=YYYY-MM-DD/` holds the rows, inside a day in order of patient and time, so the
statistics of a row group tell which patients it has; `latest/` has a row for each patient of each appended batch. Both are
only ever added to. A batch's rows go in before its newest times: what `latest` speaks of is there to be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugartrace.operators import timerange

PID = "patient_id"
DAY = "day"
NAMED = 100  # patients up to which a request names them in the scan


class EventStore:
    def __init__(self, spark: SparkSession, path: str, ts: str = "timestamp"):
        self.spark, self.path, self.ts = spark, path.rstrip("/"), ts

    @property
    def facts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/facts")

    def append(self, rows: DataFrame) -> None:
        """Add rows. A busy day is split over tasks by patient; rows are not deduplicated here (see `sinks`)."""
        dated = rows.withColumn(DAY, F.to_date(self.ts))
        ordered = dated.repartitionByRange(DAY, PID, self.ts).sortWithinPartitions(DAY, PID, self.ts)
        ordered.write.mode("append").partitionBy(DAY).parquet(f"{self.path}/facts")
        newest = rows.groupBy(PID).agg(F.max(self.ts).alias(self.ts))
        newest.write.mode("append").parquet(f"{self.path}/latest")

    def latest(self) -> DataFrame:
        """(patient, newest time), from one row per patient and batch instead of the facts."""
        return self.spark.read.parquet(f"{self.path}/latest").groupBy(PID).agg(F.max(self.ts).alias(self.ts))

    def resolve(self, requests: DataFrame) -> DataFrame:
        """Windows of requests, `last` counted back from the kept newest times."""
        return timerange.resolve(requests, self.latest(), self.ts)

    def between(self, low: int | None, high: int | None) -> DataFrame:
        """Facts between two times in microseconds: whole days are left out by their folder, row groups by their statistics."""
        facts = self.facts
        if low is None or high is None:
            return facts
        begin, end = (F.timestamp_micros(F.lit(x)) for x in (low, high))
        return facts.filter(F.col(DAY).between(F.to_date(begin), F.to_date(end)) & F.col(self.ts).between(begin, end))

    def window(self, bounds: DataFrame) -> DataFrame:
        """Facts inside their patient's window. The outer bounds of all windows reach the scan as constants, and so do the
        patients where there are at most NAMED of them."""
        facts = self.between(*timerange.span(bounds))
        named = [r[0] for r in bounds.select(PID).limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            facts = facts.filter(F.col(PID).isin(named))
        return timerange.in_window(facts, bounds, self.ts).drop(DAY)
