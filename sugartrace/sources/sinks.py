"""Idempotent writes: insert if absent, upsert, overwrite a window, acknowledge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.functions import rounding
from sugartrace.operators import joins
from sugartrace.sources.parts import PartTable

PID = "patient_id"
FACT_KEYS = {
    "glucoses": (PID, "timestamp"),
    "meals": (PID, "timestamp"),
    "insulins": (PID, "timestamp", "event_type"),
}


def rows_to_insert(batch: DataFrame, target: DataFrame, keys: Sequence[str], sequence: str = "seq") -> DataFrame:
    """New rows of the batch: first per key in file order, and not yet in the target."""
    values = [c for c in batch.columns if c not in (*keys, sequence)]
    first = joins.first_by(batch, list(keys), [sequence], [sequence, *values])
    return anti_existing(first, target, keys)


def anti_existing(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    return batch.join(target.select(*keys), list(keys), "left_anti")


def append_new(batch: DataFrame, target_path: str, keys: Sequence[str], sequence: str = "seq") -> None:
    """Append to a Parquet table; a rerun of the same batch finds its rows there and adds nothing."""
    spark = batch.sparkSession
    fresh = rows_to_insert(batch, spark.read.parquet(target_path), keys, sequence)
    fresh.drop(sequence).write.mode("append").parquet(target_path)


def upsert_patients(existing: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """Known external ids take the new date of birth, unknown ones are added."""
    new = joins.first_by(incoming, ["external_id"], ["seq"], ["name", "date_of_birth"])
    new = new.select("external_id", F.col("name").alias("_name"), F.col("date_of_birth").alias("_dob"))
    merged = existing.join(new, "external_id", "full_outer")
    touched = F.col("_name").isNotNull()
    return merged.select(
        "external_id",
        F.coalesce("name", "_name").alias("name"),
        F.coalesce("_dob", "date_of_birth").alias("date_of_birth"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(touched, now).otherwise(F.col("created_at")).alias("updated_at"),
    )


def overwrite_window(anomalies: DataFrame, windows: DataFrame, detected: DataFrame) -> DataFrame:
    """Replace each patient's anomalies inside the detected window by the new ones."""
    marked = joins.lookup_join(anomalies, windows, [PID], "left")
    inside = F.col("range_start").isNotNull() & F.col("detected_at").between(F.col("range_start"), F.col("range_end"))
    kept = marked.filter(~F.coalesce(inside, F.lit(False))).drop("range_start", "range_end")
    return kept.unionByName(detected, allowMissingColumns=True)


def persistable(surfaced: DataFrame, floor: float = K.PERSIST_SEVERITY) -> DataFrame:
    """Strong enough to store; confidence is the strength as a fraction."""
    return surfaced.filter(F.col("severity") >= floor).select(
        PID,
        "anomaly_type",
        (F.col("anomaly_strength") / 100.0).alias("confidence"),
        "severity",
        "description",
        "residual_mmoll",
        "duration_min",
        F.col("start").alias("detected_at"),
        F.lit(False).alias("is_acknowledged"),
    )


def acknowledge(anomalies: DataFrame, acks: DataFrame) -> DataFrame:
    """`acks`: (patient, anomaly) pairs; a pair of the wrong patient changes nothing."""
    wanted = acks.select(F.col("anomaly_id").alias("id"), PID, F.lit(True).alias("_ack")).distinct()
    return anomalies.join(wanted, ["id", PID], "left").withColumn(
        "is_acknowledged", F.col("is_acknowledged") | F.coalesce("_ack", F.lit(False))
    ).drop("_ack")


def store_patients(table: PartTable, incoming: DataFrame, now) -> None:
    """`upsert_patients` on a stored table; only the parts of incoming patients are read and written."""
    table.merge(incoming, lambda old, new: upsert_patients(old, new, now))


def store_window(table: PartTable, windows: DataFrame, detected: DataFrame) -> None:
    """`overwrite_window` on a stored table in parts of patients."""
    patients = windows.select(PID).unionByName(detected.select(PID)).distinct()
    table.merge(patients, lambda old, _: overwrite_window(old, windows, detected))


def store_acknowledged(table: PartTable, acks: DataFrame) -> None:
    """`acknowledge` on a stored table in parts of patients."""
    table.merge(acks, acknowledge)


def upload_summary(glucoses: DataFrame, meals: DataFrame, insulins: DataFrame) -> DataFrame:
    stamps = (
        glucoses.select(PID, "timestamp", F.lit("g").alias("k"))
        .unionByName(meals.select(PID, "timestamp", F.lit("m").alias("k")))
        .unionByName(insulins.select(PID, "timestamp", F.lit("i").alias("k")))
    )
    kind = F.col("k")
    per_patient = stamps.groupBy(PID).agg(
        F.count_if(kind == "g").alias("g"), F.count_if(kind == "m").alias("m"), F.count_if(kind == "i").alias("i"),
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
    )
    return per_patient.agg(
        F.count(F.lit(1)).alias("patients_count"),
        F.sum("g").alias("glucose_count"),
        F.sum("m").alias("meal_count"),
        F.sum("i").alias("insulin_count"),
        F.min("lo").alias("date_from"),
        F.max("hi").alias("date_to"),
    )


def merge_channels(glucoses: DataFrame, meals: DataFrame, insulins: DataFrame, sequence: str = "id") -> DataFrame:
    """One row per patient and timestamp: first glucose, summed carbs, summed insulin, rounded 1 / 0 / 3."""
    long = (
        glucoses.select(PID, "timestamp", F.col("glucose_mmoll").alias("g"), F.col(sequence).alias("_seq"))
        .unionByName(meals.select(PID, "timestamp", F.col("carbs").alias("c")), allowMissingColumns=True)
        .unionByName(insulins.select(PID, "timestamp", F.col("units").alias("u")), allowMissingColumns=True)
    )
    return long.groupBy(PID, "timestamp").agg(
        rounding.half_even(F.min_by("g", "_seq"), 1).alias("glucose_mmoll"),
        rounding.half_even(rounding.settled(F.sum("u")), 3).alias("insulin_u"),
        rounding.half_even(rounding.settled(F.sum("c"))).alias("cho_grams"),
    )


def sync_histories(histories: DataFrame, merged: DataFrame) -> DataFrame:
    """New values overwrite stored ones, nulls keep them, new timestamps are added."""
    channels = ("glucose_mmoll", "insulin_u", "cho_grams")
    new = merged.select(PID, "timestamp", *[F.col(c).alias(f"_{c}") for c in channels])
    return histories.join(new, [PID, "timestamp"], "full_outer").select(
        PID, "timestamp", *[F.coalesce(f"_{c}", c).alias(c) for c in channels]
    )


def build_channel_rows(glucoses: DataFrame, insulins: DataFrame, meals: DataFrame, sequence: str = "id") -> DataFrame:
    """One row per timestamp with any channel: last glucose, insulin rate per minute, summed carbs.

    A bolus spreads over 3 minutes, an hourly basal sum over 60; zero markers carry no dose.
    """
    span = F.when(F.col("event_type") == "basal", K.BASAL_SPREAD_MIN).otherwise(K.BOLUS_SPREAD_MIN)
    rates = insulins.filter("units > 0").select(
        PID,
        F.explode(F.sequence(F.lit(0), span - 1)).alias("_k"),
        "timestamp",
        (F.col("units") / span).alias("u"),
    )
    rates = rates.select(PID, F.timestamp_add("MINUTE", F.col("_k"), F.col("timestamp")).alias("timestamp"), "u")
    long = (
        glucoses.select(PID, "timestamp", F.col("glucose_mmoll").alias("g"), F.col(sequence).alias("_seq"))
        .unionByName(rates, allowMissingColumns=True)
        .unionByName(meals.select(PID, "timestamp", F.col("carbs").alias("c")), allowMissingColumns=True)
    )
    return long.groupBy(PID, "timestamp").agg(
        F.max_by("g", "_seq").alias("glucose_mmoll"), F.sum("u").alias("insulin_u"), F.sum("c").alias("cho_grams")
    )


def write_swapped(df: DataFrame, path: str) -> None:
    """Replace a Parquet table that `df` itself reads: write beside it, then swap the folders.

    The old folder goes last, and only when the new one stands in its place. A rename that fails raises and leaves,
    or puts back, the old table; a table that a crash left aside is put back first.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, old = jvm.org.apache.hadoop.fs.Path(path + "._new"), jvm.org.apache.hadoop.fs.Path(path + "._old")
    if fs.exists(old) and not fs.exists(folder):
        fs.rename(old, folder)  # a run ended between its renames
    df.write.mode("overwrite").parquet(path + "._new")
    if fs.exists(folder) and fs.exists(old):
        fs.delete(old, True)  # the table stands, so what is beside it is a leftover
    if fs.exists(folder) and not fs.rename(folder, old):
        raise OSError(f"{path} could not be moved aside; it is unchanged")
    if not fs.rename(fresh, folder):
        if fs.exists(old):
            fs.rename(old, folder)
        raise OSError(f"{path}._new could not take the place of {path}")
    if fs.exists(old):
        fs.delete(old, True)
