"""Sorted patient and anomaly lists, pages and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.functions import scalars
from sugartrace.operators import ordered

PID = "patient_id"


def page(ranked: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return ranked.orderBy(*order).offset((number - 1) * size).limit(size)


def patient_order(sort_by: str, ascending: bool) -> list[Column]:
    """Sort columns with the id as tie-break in the same direction; age runs against date of birth."""
    column = {"name": "name", "external_id": "external_id", "age": "date_of_birth"}.get(sort_by)
    if column is None:
        return [F.desc("created_at"), F.desc("id")]
    up = ascending != (column == "date_of_birth")
    return [F.asc(column), F.asc("id")] if up else [F.desc(column), F.desc("id")]


def patients_page(patients: DataFrame, sort_by: str = "name", ascending: bool = True, number: int = 1, size: int = 20):
    return page_with_total(patients, patient_order(sort_by, ascending), number, size)


def page_with_total(ranked: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page, with the number of all rows and pages beside it (a one-row broadcast)."""
    total = ranked.agg(F.count(F.lit(1)).alias("total"))
    rows = page(ranked, order, number, size)
    return rows.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))


def by_anomalies(patients: DataFrame, anomalies: DataFrame, window: DataFrame) -> DataFrame:
    """Patients with their unacknowledged anomalies in one common window (a one-row table)."""
    inside = F.col("detected_at").between(F.col("range_start"), F.col("range_end"))
    counts = (
        anomalies.crossJoin(F.broadcast(window))
        .filter(inside & ~F.col("is_acknowledged"))
        .groupBy(F.col(PID).alias("id"))
        .agg(F.count(F.lit(1)).alias("pending"))
    )
    return patients.join(counts, "id", "left").fillna(0, ["pending"])


def by_tir(
    patients: DataFrame, readings: DataFrame, window: DataFrame, low: float = K.LOW, high: float = K.HIGH
) -> DataFrame:
    inside = F.col("timestamp").between(F.col("range_start"), F.col("range_end"))
    share = (
        readings.crossJoin(F.broadcast(window))
        .filter(inside)
        .groupBy(F.col(PID).alias("id"))
        .agg((F.count_if(F.col("glucose_mmoll").between(low, high)) / F.count(F.lit(1))).alias("tir"))
    )
    return patients.join(share, "id", "left").fillna(0.0, ["tir"])


def anomaly_order(key: str, descending: bool = True) -> list[Column]:
    severity = F.coalesce("severity", F.lit(0.0))
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    if key == "severity":
        return [turn(severity), F.asc("id")]
    if key == "excursion":
        size = scalars.excursion_size(F.col("residual_mmoll"), F.col("duration_min"))
        return [turn(size), severity.desc(), F.asc("id")]
    return [turn(F.coalesce(F.unix_seconds("detected_at"), F.lit(0))), F.asc("id")]


def severity_rank(anomalies: DataFrame, id_width: int = 100_000) -> DataFrame:
    """Stable rank of all anomalies by severity, before any filter.

    Rank = anomalies with a higher severity + position among equals by id. The first part
    runs over distinct severities in quantile blocks, the second over id blocks, so neither
    the whole table nor one popular severity is ever a single window.
    """
    keyed = anomalies.withColumn("_key", -F.coalesce("severity", F.lit(0.0)))
    counts = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    above = ordered.prefix_sum(
        ordered.with_value_block(counts, "_key"), [], ["_key"], {"_above": F.col("_n")}, inclusive=False
    ).select("_key", "_above")
    place = ordered.row_number(ordered.with_block(keyed, "id", id_width), ["_key"], ["id"], "_place")
    # many ids share a severity: salt that lookup as well
    from sugartrace.operators import joins

    out = joins.lookup_join(place, above, ["_key"])
    return out.withColumn("rank", F.col("_above") + F.col("_place")).drop("_key", "_above", "_place", ordered.BLOCK)


def top_events(events: DataFrame, k: int, key: str = PID, order: str = "severity", tie: str = "start_min") -> DataFrame:
    """Strongest k per patient, 0 = all. Spark limits every group before the shuffle."""
    if k <= 0:
        return events
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.asc(tie)))
    return events.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
