"""Entity views over the driver's tables: patients and their events, on one clock each."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sugartrace.functions import scalars
from sugartrace.operators import ordered, series
from sugartrace.session import materialize, tune


class Tables:
    def __init__(self, spark: SparkSession, folder: str, low: int | None = None, high: int | None = None):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")
        self.low, self.high = low, high

    def during(self, low: int | None, high: int | None) -> Tables:
        """The same tables with only the events of the minutes between two times in microseconds."""
        return Tables(self.spark, self.folder, low, high)

    def merged(self, patients: int) -> Tables:
        """The same events as those of a few patients with long series."""
        return Merged(self.spark, self.folder, patients)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        rows = self.read("events")
        if self.low is not None and self.high is not None:
            # On the column as stored and with constants, so that the scan skips row groups.
            kind = rows.schema["ts"].dataType
            low, high = (F.timestamp_micros(F.lit(x)).cast(kind) for x in (self.low, self.high + 60_000_000))
            rows = rows.filter((F.col("ts") >= low) & (F.col("ts") < high))
        return rows.select(
            "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")
        )

    @cached_property
    def patients(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            key.alias("id"),
            F.format_string("SIM_%06d", key).alias("external_id"),
            F.col("c_name").alias("name"),
            F.make_date(
                (1950 + key % 50).cast("int"), (1 + key % 12).cast("int"), (1 + key % 28).cast("int")
            ).alias("date_of_birth"),
            F.timestamp_add("MINUTE", key % 1000, F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
        )

    @cached_property
    def _entity(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("patient_id"),
            F.date_trunc("minute", "ts").alias("timestamp"),
            "event_type",
            "value",
        )

    @cached_property
    def glucoses(self) -> DataFrame:
        glucose = F.lit(2.5) + F.col("value") % 12.0
        return self._entity.select(
            "id",
            "patient_id",
            "timestamp",
            glucose.alias("glucose_mmoll"),
            scalars.glucose_status(glucose).alias("status"),
        )

    @cached_property
    def insulins(self) -> DataFrame:
        return self._entity.filter(F.col("event_type").isin("purchase", "signup")).select(
            "id",
            "patient_id",
            "timestamp",
            (F.col("value") % 10.0).alias("units"),
            F.when(F.col("event_type") == "purchase", "bolus").otherwise("basal").alias("event_type"),
        )

    @cached_property
    def meals(self) -> DataFrame:
        minute = scalars.minute_of_day(F.col("timestamp"))
        return self._entity.filter("event_type = 'click'").select(
            "id",
            "patient_id",
            "timestamp",
            (F.col("value") % 90.0).alias("carbs"),
            F.when(F.col("id") % 7 != 0, scalars.meal_type(minute)).alias("meal_type"),
        )

    @cached_property
    def exercises(self) -> DataFrame:
        return self._entity.filter("event_type = 'view'").select(
            "id",
            "patient_id",
            "timestamp",
            (10 + F.col("id") % 50).alias("duration_minutes"),
            F.when(F.col("id") % 3 == 0, "low")
            .when(F.col("id") % 3 == 1, "medium")
            .otherwise("high")
            .alias("intensity"),
        )

    @cached_property
    def anomalies(self) -> DataFrame:
        key, value = F.col("id"), F.col("value")
        return self._entity.filter("event_type = 'error'").select(
            "id",
            "patient_id",
            F.when(key % 2 == 0, "missed_bolus").otherwise("late_bolus").alias("anomaly_type"),
            (value / 500.0).alias("confidence"),
            F.when(key % 11 != 0, value / 10.0).alias("severity"),
            F.when(key % 13 != 0, value % 8.0 - 4.0).alias("residual_mmoll"),
            (30 + key % 120).alias("duration_min"),
            (key % 3 == 0).alias("is_acknowledged"),
            F.col("timestamp").alias("detected_at"),
        )

    @cached_property
    def histories(self) -> DataFrame:
        kind, value = F.col("event_type"), F.col("value")
        return self._entity.select(
            "id",
            "patient_id",
            "timestamp",
            F.when(kind.isin("view", "error"), F.lit(2.5) + value % 12.0).alias("glucose_mmoll"),
            F.when(kind.isin("purchase", "signup"), value % 10.0).alias("insulin_u"),
            F.when(kind == "click", value % 90.0).alias("cho_grams"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            key.alias("patient_id"),
            F.when(key % 5 == 0, "24h").when(key % 5 == 1, "7d").when(key % 5 == 2, "2w").when(key % 5 == 3, "1m")
            .alias("last"),
            F.when(key % 7 < 2, F.lit("2024-01-10 00:00:00").cast("timestamp")).alias("start"),
            F.when((key % 7 > 0) & (key % 7 < 3), F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("end"),
        )

    @cached_property
    def _numbered(self) -> DataFrame:
        """Events in time order per user; blocks are hours, so a busy user is many tasks.

        Written once: every series built on this clock reads it several times.
        """
        blocked = ordered.with_time_block(self.events, "ts", 3600)
        return materialize(ordered.row_number(blocked, ["user_id"], ["ts", "event_id"]).drop(ordered.BLOCK))

    def _sensor(self) -> Column:
        return F.lit(2.5) + F.col("value") % 12.0

    @cached_property
    def cgm(self) -> DataFrame:
        """5-minute sensor clock with a 10-minute gap every 29 samples and, for some, one of 65."""
        n = F.col("rn") - 1
        late = (F.col("user_id") % 5 == 0) & (F.col("rn") > 25)
        minute = 5 * n + 5 * F.floor(n / 29) + F.when(late, 60).otherwise(0)
        kind, value = F.col("event_type"), F.col("value")
        return self._numbered.select(
            F.col("user_id").alias("patient_id"),
            F.col("event_id").alias("id"),
            minute.cast("long").alias("minute"),
            self._sensor().alias("glucose"),
            F.when(kind == "purchase", value % 10.0).alias("units"),
            F.when(kind == "click", value % 90.0).alias("carb_g"),
            "event_type",
        )

    @cached_property
    def boluses(self) -> DataFrame:
        return self.cgm.filter("units > 0").select("patient_id", "id", "minute", "units")

    @cached_property
    def carbs(self) -> DataFrame:
        return self.cgm.filter("carb_g > 0").select("patient_id", "id", "minute", "carb_g")

    @cached_property
    def channels(self) -> DataFrame:
        """Channel rows: glucose sample, insulin rate and carbs of a minute."""
        return self.cgm.select(
            "patient_id",
            "id",
            "minute",
            "glucose",
            (F.col("units") / 3.0).alias("insulin"),
            F.col("carb_g").alias("carbs"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        """1-minute series with interpolated glucose and validity."""
        return series.minute_grid(self.channels)

    @cached_property
    def lengths(self) -> DataFrame:
        return series.series_lengths(self.cgm)

    @cached_property
    def flags(self) -> DataFrame:
        """Five 0/1 class flags at the minutes of `error` events."""
        code = F.col("id") % 5
        return self.cgm.filter("event_type = 'error'").select(
            "patient_id",
            "minute",
            *[(code == i).cast("double").alias(f"f_{c}") for i, c in enumerate(series.K.CLASSES)],
        )

    @cached_property
    def flag_grid(self) -> DataFrame:
        names = [f"f_{c}" for c in series.K.CLASSES]
        return self.grid.join(self.flags, ["patient_id", "minute"], "left").fillna(0.0, names)

    @cached_property
    def cohort(self) -> DataFrame:
        """1-minute simulator rows."""
        key, value = F.col("event_id"), F.col("value")
        minute = (F.col("rn") - 1).cast("long")
        return self._numbered.select(
            F.col("user_id").alias("patient_id"),
            (18 + F.col("user_id") % 48).cast("double").alias("patient_age_years"),
            F.floor(minute / 1440).cast("long").alias("day"),
            (minute % 1440).alias("minute"),
            minute.alias("absolute_minute"),
            (F.lit(2.5) + value % 12.0).alias("blood_glucose"),
            F.when(F.col("event_type") == "click", value * 100).otherwise(0.0).alias("cho_mg_announced"),
            F.when(key % 9 != 0, (value * 10.0) % 150.0).otherwise(0.0).alias("insulin_mu_min"),
            F.when(key % 17 == 0, "missed").when(key % 17 == 1, "late").when(key % 17 < 8, "normal")
            .alias("bolus_status"),
            F.when(key % 19 == 0, "large").when(key % 19 < 9, "normal").alias("meal_size"),
            F.when(key % 23 == 0, "prolonged").when(key % 23 == 1, "anaerobic").when(key % 23 < 4, "aerobic")
            .alias("exercise_type"),
            (1 + F.col("user_id") % 3).alias("base_scenario"),
        )


class Merged(Tables):
    """Users folded into a few patients, whose series run for days, with an hour of high glucose now and then."""

    def __init__(self, spark: SparkSession, folder: str, patients: int):
        super().__init__(spark, folder)
        self.count = patients

    @cached_property
    def events(self) -> DataFrame:
        return super().events.withColumn("user_id", F.col("user_id") % self.count)

    def _sensor(self) -> Column:
        return super()._sensor() + F.when(F.col("rn") % 311 < 12, F.lit(9.0)).otherwise(F.lit(0.0))
