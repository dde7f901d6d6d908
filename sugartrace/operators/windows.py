"""Sliding windows over dense minute series.

Labels and starts need no window: flagged minutes meet the starts they reach as maxima of blocks,
and valid stretches are counted off. Where the values of a window are wanted, a series is cut into
tiles with a halo of one window, so every window lies inside one tile and a task holds bounded
arrays of a stretch of one patient; windows are sliced at the strided starts only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.operators import joins, ordered, series

PID = "patient_id"
FLAGS = tuple(f"f_{c}" for c in K.CLASSES)


def tiles(grid: DataFrame, columns: Sequence[str], before: int = 0, after: int = 0, tile: int = 720) -> DataFrame:
    """(patient, tile, first minute, rows): `rows` is the minute-ordered stretch incl. its halo."""
    halo = ordered.with_halo(grid.select(PID, "minute", *columns), "minute", tile, before, after)
    return (
        halo.filter(F.col(ordered.TILE) >= 0)
        .groupBy(PID, ordered.TILE)
        .agg(F.sort_array(F.collect_list(F.struct("minute", *columns))).alias("rows"))
        .withColumn("first", F.col("rows")[0]["minute"])
    )


def windows(
    grid: DataFrame, columns: Sequence[str], length: int, stride: int, offset: int = 0, tile: int = 720
) -> DataFrame:
    """Complete windows `[start, start + length)` at `offset, offset + stride, ...` as arrays per column."""
    cut = tiles(grid, columns, after=length - 1, tile=tile)
    low = F.greatest(F.col(ordered.TILE) * tile, F.col("first"), F.lit(offset))
    first = F.ceil((low - offset) / F.lit(stride)) * stride + offset
    last = F.least(
        (F.col(ordered.TILE) + 1) * tile - 1, F.col("first") + F.size("rows") - length
    )
    starts = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.lit(stride).cast("long")))
    cut = cut.filter(first <= last)

    def window(start: Column) -> Column:
        at = (start - F.col("first") + 1).cast("int")
        return F.struct(start.alias("start"), F.slice("rows", at, F.lit(length)).alias("w"))

    flat = cut.select(PID, F.inline(F.transform(starts, window)))
    return flat.select(PID, "start", *[F.col(f"w.{c}").alias(c) for c in columns])


STARTS = 4096  # starts that one row opens at most


def window_counts(lengths: DataFrame, length: int, stride: int) -> DataFrame:
    """Complete windows of dense series (patient, T) from minute 0: patient, windows."""
    return lengths.filter(F.col("T") >= length).select(
        PID, (F.floor((F.col("T") - length) / F.lit(stride)) + 1).cast("long").alias("windows")
    )


def window_index(grid: DataFrame | None, length: int, stride: int, lengths: DataFrame | None = None) -> DataFrame:
    """Starts of complete windows; a start is a strided minute far enough from the end.

    With `lengths` (patient, T) of dense series from minute 0 the starts are arithmetic and the grid is not read.
    """
    if lengths is not None:
        last = F.col("windows") - 1
        stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / STARTS))).alias("_s")
        counts = window_counts(lengths, length, stride).select(PID, "windows", stretch)
        upto = F.least((F.col("_s") + 1) * STARTS - 1, last)
        return counts.select(PID, F.explode(F.sequence(F.col("_s") * STARTS, upto)).alias("_i")).select(PID, (F.col("_i") * stride).alias("start"))
    lengths = grid.groupBy(PID).agg((F.max("minute") + 1).alias("T"))
    strided = grid.filter(F.col("minute") % stride == 0).select(PID, F.col("minute").alias("start"))
    return joins.lookup_join(strided, lengths, [PID]).filter(F.col("start") + length <= F.col("T")).drop("T")


def window_labels(
    rows: DataFrame, lengths: DataFrame, length: int, stride: int, flags: Sequence[str] = FLAGS, skip: int = 0
) -> DataFrame:
    """Largest value of each flag in minutes `[start + skip, start + length)` of every complete window.

    `rows` (patient, minute, flags) may be sparse: a minute without row, or with null, counts as 0, and flags are not negative.
    `lengths` (patient, T) are those of dense series from minute 0, so the starts are arithmetic and no window is built. Flagged minutes
    become maxima of blocks of one stride, whole and of the part that only just reaches into a window; a window is some
    whole blocks and one such part. Blocks meet the starts in one aggregation.
    """
    whole, rest = divmod(length - skip, stride)
    at = F.col("minute") - skip
    block = F.floor(at / F.lit(stride))
    part = (at - block * stride) < rest
    blocks = (
        rows.filter((at >= 0) & (F.greatest(*flags, F.lit(0.0)) > 0))
        .groupBy(PID, block.alias("_block"))
        .agg(
            *[F.max(f).alias(f"_w_{f}") for f in flags],
            *[F.max(F.when(part, F.col(f))).alias(f"_p_{f}") for f in flags],
        )
    )
    first = F.greatest(F.col("_block") - whole + (0 if rest else 1), F.lit(0).cast("long"))
    reached = blocks.filter(first <= F.col("_block")).withColumn("_i", F.explode(F.sequence(first, F.col("_block"))))
    inside = F.col("_i") > F.col("_block") - whole
    reached = reached.select(
        PID,
        (F.col("_i") * stride).alias("start"),
        *[F.when(inside, F.col(f"_w_{f}")).otherwise(F.col(f"_p_{f}")).cast("double").alias(f) for f in flags],
        F.lit(None).cast("boolean").alias("_start"),
    )
    starts = window_index(None, length, stride, lengths)
    starts = starts.select(PID, "start", *[F.lit(0.0).alias(f) for f in flags], F.lit(True).alias("_start"))
    met = starts.unionAll(reached).groupBy(PID, "start").agg(*[F.max(f).alias(f) for f in flags], F.max("_start").alias("_start"))
    return met.filter("_start").drop("_start")


def clean_windows(rows: DataFrame, lengths: DataFrame, length: int, stride: int, flags: Sequence[str] = FLAGS) -> DataFrame:
    """Windows without any flag."""
    return window_labels(rows, lengths, length, stride, flags).filter(F.greatest(*flags) == 0).select(PID, "start")


def contrastive_pools(rows: DataFrame, lengths: DataFrame, length: int, stride: int, flags: Sequence[str] = FLAGS) -> DataFrame:
    labelled = window_labels(rows, lengths, length, stride, flags)
    return labelled.select(PID, "start", (F.greatest(*flags) == 0).alias("is_normal"))


def valid_windows(
    rows: DataFrame, length: int = K.FORECAST_WINDOW, stride: int = K.SCORE_STRIDE, gap: int = K.MAX_GAP_MIN
) -> DataFrame:
    """Starts whose every minute is valid, from the glucose samples: a valid stretch holds all its windows, so its starts are
    counted off and no minute in between is looked at. Long stretches are dealt out in pieces of STARTS starts."""
    stretches = series.valid_stretches(rows, gap)
    step = F.lit(stride).cast("long")
    low, high = F.ceil(F.col("first") / step), F.floor((F.col("last") - (length - 1)) / step)
    pieces = F.explode(F.sequence(F.floor(F.col("_low") / STARTS), F.floor(F.col("_high") / STARTS))).alias("_piece")
    cut = stretches.select(PID, low.alias("_low"), high.alias("_high")).filter("_low <= _high").select(PID, "_low", "_high", pieces)
    from_ = F.greatest(F.col("_low"), F.col("_piece") * STARTS)
    to = F.least(F.col("_high"), (F.col("_piece") + 1) * STARTS - 1)
    return cut.select(PID, F.explode(F.sequence(from_, to)).alias("_i")).select(PID, (F.col("_i") * step).alias("start"))


def horizon_labels(
    rows: DataFrame, lengths: DataFrame, stride: int, context: int = K.CONTEXT_LEN, horizon: int = K.HORIZON,
    flags: Sequence[str] = FLAGS,
) -> DataFrame:
    return window_labels(rows, lengths, context + horizon, stride, flags, skip=context)


def forecast_windows(
    grid: DataFrame, stride: int = K.SCORE_STRIDE, context: int = K.CONTEXT_LEN, horizon: int = K.HORIZON,
    flags: Sequence[str] = (), valid_only: bool = True,
) -> DataFrame:
    """Forecaster inputs: glucose history, insulin and carbs through the horizon, and the target."""
    columns = ["glucose", "insulin", "carbs", *(["valid"] if valid_only else []), *flags]
    cut = windows(grid, columns, context + horizon, stride)
    if valid_only:
        cut = cut.filter(F.forall("valid", lambda v: v))
    return cut.select(
        PID,
        "start",
        F.slice("glucose", 1, context).alias("history"),
        "insulin",
        "carbs",
        F.slice("glucose", context + 1, horizon).alias("target"),
        *[F.array_max(F.slice(f, context + 1, horizon)).alias(f) for f in flags],
    )


def window_mean(
    rows: DataFrame, value: str, length: int, stride: int, offset: int = 0, end_margin: int = 0,
    flags: Sequence[str] = (),
) -> DataFrame:
    """Mean of a per-minute value and maximum of flags per window, leaving `end_margin` minutes at the end."""
    cut = windows(rows, [value, *flags], length + end_margin, stride, offset)
    total = F.aggregate(F.slice(value, 1, length), F.lit(0.0), lambda acc, x: acc + x)
    return cut.select(
        PID, "start", (total / length).alias("score"), *[F.array_max(F.slice(f, 1, length)).alias(f) for f in flags]
    )
