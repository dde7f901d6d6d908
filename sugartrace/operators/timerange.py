"""The shared time predicate: turn (start, end, last) requests into windows and apply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugartrace.functions import scalars
from sugartrace.operators import joins

DEFAULT_LAST = "2w"
PID = "patient_id"


def window_bounds(start: Column, end: Column, last: Column, latest: Column, default: str = DEFAULT_LAST):
    """Five rules: both ends; start + last; end - last; last back from the latest; the default period.

    A malformed period gives null bounds unless both ends are explicit.
    """
    period = scalars.parse_period(F.coalesce(last, F.lit(default)))
    anchor = F.coalesce(end, latest)
    both = start.isNotNull() & end.isNotNull()
    low = F.when(start.isNotNull(), start).otherwise(scalars.shift_by_period(anchor, period, -1))
    high = (
        F.when(both, end)
        .when(start.isNotNull(), scalars.shift_by_period(start, period, 1))
        .otherwise(anchor)
    )
    usable = both | period.isNotNull()
    return F.when(usable, low), F.when(usable, high)


def resolve(requests: DataFrame, anchor: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One window per request. `last` counts back from the newest row of `anchor` per patient."""
    latest = anchor.groupBy(PID).agg(F.max(ts).alias("_latest"))
    joined = requests.join(latest, PID, "left")
    low, high = window_bounds(F.col("start"), F.col("end"), F.col("last"), F.col("_latest"))
    return joined.select(PID, low.alias("range_start"), high.alias("range_end"))


def resolve_cohort(anchor: DataFrame, last: str | None = None, ts: str = "timestamp") -> DataFrame:
    """One window for a whole patient list, counted back from the newest row of all patients."""
    latest = anchor.agg(F.max(ts).alias("_latest"))
    none = F.lit(None).cast("timestamp")
    low, high = window_bounds(none, none, F.lit(last).cast("string"), F.col("_latest"))
    return latest.select(low.alias("range_start"), high.alias("range_end"))


def span(bounds: DataFrame) -> tuple[int | None, int | None]:
    """Earliest start and latest end of all windows in microseconds. Two numbers, for the scan that comes before the join;
    None where no window is usable, or one has no limits (a null `_all` counts as limited)."""
    free = F.max("_all") if "_all" in bounds.columns else F.lit(False)
    ends = bounds.agg(F.unix_micros(F.min("range_start")), F.unix_micros(F.max("range_end")), free).first()
    return (None, None) if ends[2] else (ends[0], ends[1])


def in_window(facts: DataFrame, bounds: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Facts inside their patient's window, both ends included."""
    return joins.lookup_join(facts, bounds, [PID]).filter(
        F.col(ts).between(F.col("range_start"), F.col("range_end"))
    )


def request_bounds(requests: DataFrame, glucoses: DataFrame) -> DataFrame:
    """Windows anchored on glucose, and whether a request has no parameter at all (`_all`)."""
    free = F.col("start").isNull() & F.col("end").isNull() & F.col("last").isNull()
    return resolve(requests, glucoses).join(requests.select(PID, free.alias("_all")), PID)


def anomalies_in_window(anomalies: DataFrame, bounds: DataFrame) -> DataFrame:
    """Without any parameter nothing is filtered; otherwise the window of `request_bounds` is."""
    joined = joins.lookup_join(anomalies, bounds, [PID])
    inside = F.col("detected_at").between(F.col("range_start"), F.col("range_end"))
    return joined.filter(F.col("_all") | inside).drop("_all", "range_start", "range_end")
