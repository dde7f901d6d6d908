"""The batch operators that make sense on a stream, with Structured Streaming state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from sugartrace import constants as K
from sugartrace.operators import ordered
from sugartrace.session import materialize, staging
from sugartrace.sources import sinks
from sugartrace.sources.parts import PartTable

PID = "patient_id"
DAY = "event_day"
READING = ("id", "timestamp", "glucose_mmoll")


def dedupe(events: DataFrame, keys: Sequence[str] = (PID, "timestamp"), delay: str = "1 day") -> DataFrame:
    """First arrival per key within the watermark."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(keys))


def ingest(events: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = (PID, "timestamp")):
    """Append first arrivals to a Parquet table by batch and day. Each batch writes its own folder, so a replay
    after a failure overwrites itself instead of adding rows twice. Keys that earlier batches stored are
    left out, however late a repeat comes: they are looked up among the keys of the batch's own days. No state is
    kept besides the table, so late rows with new keys are stored too. Rows that lack a part of the key are left out."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.dropna(subset=list(keys)).dropDuplicates(list(keys)).withColumn(DAY, F.to_date("timestamp")).persist()
        try:
            fresh = batch
            if number:
                days = [r[0] for r in batch.select(DAY).distinct().collect()]
                fresh = sinks.anti_existing(batch, stored(batch, target, number, days), [DAY, *keys])
            fresh.write.mode("overwrite").partitionBy(DAY).parquet(f"{target}/batch={number}")
        finally:
            batch.unpersist()

    return (
        events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stored(batch: DataFrame, target: str, number: int, days: Sequence[dt.date]) -> DataFrame:
    """Rows of these days that batches before `number` stored. Batch and day are folders: no other file is opened."""
    schema = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
    rows = batch.sparkSession.read.schema(schema).parquet(target)
    return rows.where((F.col("batch") < number) & (F.col(DAY).isin(*days) if days else F.lit(False)))


def daily_summary(readings: DataFrame, delay: str = "1 day") -> DataFrame:
    """Average, minimum and maximum per patient and UTC day."""
    return (
        readings.withWatermark("timestamp", delay)
        .groupBy(PID, F.window("timestamp", "1 day").alias("_w"))
        .agg(
            F.avg("glucose_mmoll").alias("average"),
            F.min("glucose_mmoll").alias("min"),
            F.max("glucose_mmoll").alias("max"),
        )
        .select(PID, F.col("_w.start").alias("day"), "average", "min", "max")
    )


def event_sessions(flagged: DataFrame, gap_minutes: int = K.MERGE_GAP_MIN, delay: str = "1 day") -> DataFrame:
    """Sessions of flags at most `gap_minutes` apart."""
    gap = f"{gap_minutes} minutes"  # a gap of exactly this length still merges
    return (
        flagged.withWatermark("timestamp", delay)
        .groupBy(PID, F.session_window("timestamp", gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("flags"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
        .select(PID, "first", "last", "flags")
    )


def latest(readings: DataFrame) -> DataFrame:
    """Newest reading per patient as running state."""
    newest = F.max_by(F.struct("id", "timestamp", "glucose_mmoll"), F.struct("timestamp", "id"))
    return readings.groupBy(PID).agg(newest.alias("_r")).select(PID, "_r.*")


def latest_table(spark: SparkSession, path: str, readings: T.StructType, buckets: int = 64) -> PartTable:
    """Newest reading of each patient, in buckets of patients."""
    fields = [readings[c] for c in (PID, *READING)]
    return PartTable(spark, path, T.StructType(fields), F.pmod(F.xxhash64(PID), F.lit(buckets)))


def keep_latest(readings: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> PartTable:
    """Process what is there into a table of newest readings, and stop.

    The table is the state. A batch is reduced to a row per patient and compared with the buckets of its patients; only
    buckets where a reading is newer are written again. A late reading, a repeat or a replayed batch changes nothing.
    """
    table = latest_table(readings.sparkSession, path, readings.schema, buckets)

    def write(batch: DataFrame, number: int) -> None:
        if table.done(checkpoint, number):
            return
        with staging(batch.sparkSession):
            newest = materialize(latest(batch).select(PID, *READING))
            kept = table.read(table.parts_of(newest)).select(PID, F.struct("timestamp", "id").alias("_kept"))
            newer = newest.join(kept, PID, "left").where(
                F.col("_kept").isNull() | (F.struct("timestamp", "id") > F.col("_kept"))
            )
            table.merge(materialize(newer.drop("_kept")), lambda old, new: latest(old.unionByName(new)), checkpoint, number)
            table.vacuum()

    _process(readings.writeStream.foreachBatch(write), checkpoint)
    return table


DAILY = f"{PID} {{}}, day timestamp, total double, readings long, min double, max double"


def keep_daily(readings: DataFrame, path: str, checkpoint: str) -> PartTable:
    """Process what is there into a table of sums per patient and UTC day, and stop.

    Sums, counts and extremes of a batch add to those of its days; other days are neither read nor written, and no
    state grows with the length of the stream. A reading may be late by any time: its day is added to again. A batch
    counts once, since its number is stored in the same step as its sums.
    """
    patient = readings.schema[PID].dataType.simpleString()
    table = PartTable(readings.sparkSession, path, DAILY.format(patient), F.date_format("day", "yyyy-MM-dd"))

    def add(rows: DataFrame) -> DataFrame:
        return rows.groupBy(PID, "day").agg(
            F.sum("total").alias("total"), F.sum("readings").alias("readings"), F.min("min").alias("min"), F.max("max").alias("max")
        )

    def single(batch: DataFrame) -> DataFrame:
        value = F.col("glucose_mmoll").cast("double")
        return batch.where(F.col("timestamp").isNotNull()).select(
            PID, F.date_trunc("day", "timestamp").alias("day"), value.alias("total"),
            F.when(value.isNotNull(), 1).otherwise(0).cast("long").alias("readings"), value.alias("min"), value.alias("max"),
        )

    return _keep(readings, table, checkpoint, single, add)


def _keep(stream: DataFrame, table: PartTable, checkpoint: str, single, add) -> PartTable:
    """Fold a stream into a table: `single` makes a batch's rows table rows, `add` merges table rows."""

    def write(batch: DataFrame, number: int) -> None:
        if table.done(checkpoint, number):
            return
        with staging(batch.sparkSession):
            reduced = materialize(add(single(batch)))
            table.merge(reduced, lambda old, new: add(old.unionByName(new)), checkpoint, number)
            table.vacuum()

    _process(stream.writeStream.foreachBatch(write), checkpoint)
    return table


def daily_view(sums: DataFrame) -> DataFrame:
    """The daily summary of kept sums."""
    return sums.select(PID, "day", (F.col("total") / F.nullif(F.col("readings"), F.lit(0))).alias("average"), "min", "max")


PIECES = f"{PID} {{}}, day date, first timestamp, last timestamp, flags long"


def keep_sessions(flagged: DataFrame, path: str, checkpoint: str, gap_minutes: int = K.MERGE_GAP_MIN) -> PartTable:
    """Process what is there into a table of sessions, cut at midnight (UTC), and stop.

    A batch's sessions join those of its days where at most `gap_minutes` lie between; a late flag may join two. Other
    days are neither read nor written. `session_view` puts sessions over midnight together again.
    """
    patient = flagged.schema[PID].dataType.simpleString()
    table = PartTable(flagged.sparkSession, path, PIECES.format(patient), F.date_format("day", "yyyy-MM-dd"))

    def single(batch: DataFrame) -> DataFrame:
        rows = batch.where(F.col("timestamp").isNotNull()).groupBy(PID, "timestamp").agg(F.count(F.lit(1)).alias("flags"))
        at = F.col("timestamp")
        return rows.select(PID, F.to_date(at).alias("day"), at.alias("first"), at.alias("last"), "flags")

    def join(pieces: DataFrame) -> DataFrame:
        order = Window.partitionBy(PID, "day").orderBy("first", "last")  # a day holds at most its flags
        before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
        marked = pieces.withColumn("_new", _apart(F.col("first"), before, gap_minutes))
        runs = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return _united(runs, [PID, "day", "_run"]).select(PID, "day", "first", "last", "flags")

    return _keep(flagged, table, checkpoint, single, join)


def session_view(pieces: DataFrame, gap_minutes: int = K.MERGE_GAP_MIN) -> DataFrame:
    """Sessions of kept pieces. Pieces of a patient do not overlap, so each is compared with the one before it."""
    placed = pieces.withColumn(ordered.BLOCK, ordered.floor_div(F.unix_date("day"), 28))
    near = ordered.neighbour(placed, [PID], ["first"], {"_before": F.col("last")})
    new = {"_run": _apart(F.col("first"), F.col("_before"), gap_minutes)}
    return _united(ordered.prefix_sum(near, [PID], ["first"], new), [PID, "_run"]).select(PID, "first", "last", "flags")


def _apart(first: Column, before: Column, gap_minutes: int) -> Column:
    """1 where a session starts; a gap of exactly `gap_minutes` still joins."""
    near = F.unix_micros(first) - F.unix_micros(before) <= gap_minutes * 60_000_000
    return F.when(near, 0).otherwise(1).cast("long")


def _united(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pieces.groupBy(*keys).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("flags").alias("flags")
    )


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop. `append` writes Parquet; `complete` rewrites the state's table."""
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", target)
    else:
        writer = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target))
    _process(writer.outputMode(mode), checkpoint)


def _process(writer: DataStreamWriter, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
