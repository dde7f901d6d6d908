"""Minute series: grid, interpolation, validity, scaling, on-board features, rendering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.functions import rounding
from sugartrace.operators import joins, ordered

PID = "patient_id"


def last_write_rows(rows: DataFrame, sequence: str = "id") -> DataFrame:
    """One row per patient and minute; per channel the last non-null value in arrival order."""
    return rows.groupBy(PID, "minute").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(sequence))).alias(c)
            for c in ("glucose", "insulin", "carbs")
        ]
    )


def bracket_samples(rows: DataFrame, block: int = K.MINUTES_PER_DAY) -> DataFrame:
    """Rows with the glucose sample at or before, the one at or after, and the next row's minute."""
    rows = ordered.with_block(rows, "minute", block)
    sample = F.when(F.col("glucose").isNotNull(), F.struct(F.col("minute").alias("m"), F.col("glucose").alias("g")))
    return ordered.sweep(
        rows,
        [PID],
        ["minute"],
        forward={"prev": sample},
        backward={"next": sample, "next_minute": F.col("minute")},
        strict=["next", "next_minute"],
    )


def minute_grid(rows: DataFrame, block: int = K.MINUTES_PER_DAY, sequence: str = "id") -> DataFrame:
    """Dense minutes from first to last row: interpolated glucose, validity, insulin, carbs.

    Each row expands to the minutes up to the next row, so the grid needs no calendar join.
    Outside the samples glucose is held flat and the minute is invalid; inside, a minute is
    valid on a sample or in a gap of at most `MAX_GAP_MIN`.
    """
    rows = bracket_samples(last_write_rows(rows, sequence), block)
    until = F.coalesce(F.col("next_minute") - 1, F.col("minute"))
    grid = rows.withColumn("_m", F.explode(F.sequence(F.col("minute"), until)))
    m = F.col("_m")
    prev, nxt = F.col("prev"), F.col("next")
    slope = (nxt["g"] - prev["g"]) / (nxt["m"] - prev["m"])
    glucose = (
        F.when(prev.isNull(), nxt["g"])
        .when(nxt.isNull() | (m == prev["m"]), prev["g"])
        .otherwise(prev["g"] + slope * (m - prev["m"]))
    )
    valid = prev.isNotNull() & ((m == prev["m"]) | (nxt.isNotNull() & (nxt["m"] - prev["m"] <= K.MAX_GAP_MIN)))
    on_row = m == F.col("minute")
    return grid.select(
        PID,
        m.alias("minute"),
        glucose.alias("glucose"),
        F.when(on_row, F.coalesce("insulin", F.lit(0.0))).otherwise(0.0).alias("insulin"),
        F.when(on_row, F.coalesce("carbs", F.lit(0.0))).otherwise(0.0).alias("carbs"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def patient_stats(grid: DataFrame, channels=("glucose", "insulin", "carbs")) -> DataFrame:
    return grid.groupBy(PID).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in channels],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in channels],
    )


def _scaled(channel: str) -> Column:
    spread = F.greatest(F.col(f"std_{channel}"), F.lit(K.STD_FLOOR))
    return (F.col(channel) - F.col(f"mean_{channel}")) / spread


def zscore_patient(grid: DataFrame, channels=("glucose", "insulin", "carbs")) -> DataFrame:
    """Scale by the patient's own mean and population deviation over every minute."""
    out = joins.lookup_join(grid, patient_stats(grid, channels), [PID])
    return out.withColumns({c: _scaled(c) for c in channels})


def global_stats(grid: DataFrame, channels=("glucose", "insulin", "carbs")) -> DataFrame:
    """One row of scalers from sums, sums of squares and counts."""
    sums = grid.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s_{c}") for c in channels],
        *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in channels],
    )
    mean = {c: F.col(f"s_{c}") / F.col("n") for c in channels}
    return sums.select(
        *[mean[c].alias(f"mean_{c}") for c in channels],
        *[
            F.sqrt(F.greatest(F.col(f"q_{c}") / F.col("n") - mean[c] * mean[c], F.lit(0.0))).alias(f"std_{c}")
            for c in channels
        ],
    )


def zscore_global(grid: DataFrame, train: DataFrame, channels=("glucose", "insulin", "carbs")) -> DataFrame:
    """Scale every split by the training split's scalers (a one-row broadcast)."""
    out = grid.crossJoin(F.broadcast(global_stats(train, channels)))
    return out.withColumns({c: _scaled(c) for c in channels})


def normalize(grid: DataFrame, mode: str, train: DataFrame | None = None) -> DataFrame:
    if mode == "per_patient":
        return zscore_patient(grid)
    if mode == "global":
        return zscore_global(grid, grid if train is None else train)
    raise ValueError(f"unknown normalisation mode: {mode}")


# Time constants after which an input is below double precision of any sum it was part of.
ON_BOARD_AGES = 64


def on_board(
    grid: DataFrame, inputs: dict[str, tuple[str, float, float]], block: int = K.MINUTES_PER_DAY
) -> DataFrame:
    """Amount still active: two leaky integrators in a row, one step behind the input.

    `inputs`: output name to (rate column, tau, gain). With r = 1 - 1/tau, a = 1/tau and k the
    minute in its block, the states are sums over earlier inputs u at j:
    s1 = sum u r^(k-1-j) and s2 = a sum u (k-1-j) r^(k-2-j), that is prefix sums of u r^-j and
    j u r^-j. A block hands (S1, S2) on; after t more minutes they are S1 r^t and
    S2 r^t + a S1 t r^(t-1). All inputs share one window, one block summary and one join.
    """
    k = F.col("_k")
    size = float(block)
    df = ordered.with_block(grid, "minute", block).withColumn(
        "_k", (F.col("minute") - F.col(ordered.BLOCK) * block).cast("double")
    )
    weighted = {
        name: F.col(rate) * F.lit(gain) * F.pow(F.lit(1.0 - 1.0 / tau), -k) for name, (rate, tau, gain) in inputs.items()
    }
    df = df.withColumns({f"_w_{n}": e for n, e in weighted.items()})
    df = df.withColumns({f"_v_{n}": F.col(f"_w_{n}") * k for n in inputs})
    totals = df.groupBy(PID, ordered.BLOCK).agg(
        *[F.sum(f"_{x}_{n}").alias(f"_{x}_{n}") for n in inputs for x in "wv"]
    )
    reach = math.ceil(ON_BOARD_AGES * max(tau for _, tau, _ in inputs.values()) / block) + 1
    earlier = Window.partitionBy(PID).orderBy(ordered.BLOCK).rowsBetween(-reach, -1)
    here = F.col(ordered.BLOCK)

    def carried(name: str, tau: float) -> Column:
        a, r = 1.0 / tau, 1.0 - 1.0 / tau
        s1 = F.col(f"_w_{name}") * r ** (size - 1)
        s2 = a * r ** (size - 2) * ((size - 1) * F.col(f"_w_{name}") - F.col(f"_v_{name}"))
        ends = F.collect_list(F.struct(here.alias("b"), s1.alias("s1"), s2.alias("s2"))).over(earlier)

        def add(acc, x):
            t = (here - x["b"] - 1).cast("double") * size
            decay = F.pow(F.lit(r), t)
            lag = F.when(t > 0, a * x["s1"] * t * F.pow(F.lit(r), t - 1)).otherwise(0.0)
            return F.struct(
                (acc["s1"] + x["s1"] * decay).alias("s1"), (acc["s2"] + x["s2"] * decay + lag).alias("s2")
            )

        zero = F.struct(F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))
        return F.aggregate(ends, zero, add).alias(f"_c_{name}")

    carry = totals.select(PID, ordered.BLOCK, *[carried(n, tau) for n, (_, tau, _) in inputs.items()])
    local = Window.partitionBy(PID, ordered.BLOCK).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    sums = [
        F.coalesce(F.sum(f"_{x}_{n}").over(local), F.lit(0.0)).alias(f"_{x}s_{n}") for n in inputs for x in "wv"
    ]
    df = df.select(*grid.columns, ordered.BLOCK, "_k", *sums).join(carry, [PID, ordered.BLOCK])

    def active(name: str, tau: float) -> Column:
        a, r = 1.0 / tau, 1.0 - 1.0 / tau
        w, v, c = F.col(f"_ws_{name}"), F.col(f"_vs_{name}"), F.col(f"_c_{name}")
        power = lambda e: F.pow(F.lit(r), e)
        s1 = F.when(k > 0, w * power(k - 1)).otherwise(0.0) + c["s1"] * power(k)
        own = F.when(k > 1, a * power(k - 2) * ((k - 1) * w - v)).otherwise(0.0)
        return s1 + own + c["s2"] * power(k) + F.when(k > 0, a * c["s1"] * k * power(k - 1)).otherwise(0.0)

    return df.select(*grid.columns, *[active(n, tau).alias(n) for n, (_, tau, _) in inputs.items()])


def iob_cob(grid: DataFrame, block: int = K.MINUTES_PER_DAY) -> DataFrame:
    """Insulin and carbs on board from the delivery rates."""
    inputs = {
        "iob": ("insulin", K.TAU_INSULIN, 1.0),
        "cob": ("carbs", K.TAU_CARB, K.CARB_BIOAVAILABILITY),
    }
    return on_board(grid, inputs, block)


def basal_hold(grid: DataFrame, entries: DataFrame, block: int = K.MINUTES_PER_DAY) -> DataFrame:
    """Basal rate held from each entry to the next; zero before the first.

    `entries`: patient, minute, rate, seq. Entries before minute 0 hold from minute 0.
    """
    placed = joins.last_by(
        entries.withColumn("_raw", F.col("minute")).withColumn("minute", F.greatest("minute", F.lit(0))),
        [PID, "minute"],
        ["_raw", "seq"],
        ["rate"],
    )
    merged = grid.join(placed, [PID, "minute"], "left")
    merged = ordered.sweep(
        ordered.with_block(merged, "minute", block), [PID], ["minute"], forward={"_held": F.col("rate")}
    )
    return merged.withColumn("basal", F.coalesce("_held", F.lit(0.0))).drop("rate", "_held", ordered.BLOCK)


def temp_basal_override(grid: DataFrame, overrides: DataFrame) -> DataFrame:
    """Minutes in `[begin, end]` take the override's rate; a later override wins.

    `overrides`: patient, begin, end, rate, seq. Intervals are spread to minutes, so one
    patient's minutes are many keys.
    """
    minutes = overrides.filter("begin <= end").select(
        PID, "rate", "seq", F.explode(F.sequence(F.greatest("begin", F.lit(0)).cast("long"), F.col("end").cast("long"))).alias("minute")
    )
    chosen = joins.last_by(minutes, [PID, "minute"], ["seq"], ["rate"])
    return grid.join(chosen, [PID, "minute"], "left").withColumn("basal", F.coalesce("rate", "basal")).drop("rate")


def render_channels(grid: DataFrame, boluses: DataFrame) -> DataFrame:
    """Insulin = basal + bolus over 3 minutes; carbs = announced carbs over 20; cut at the grid's end.

    `grid`: patient, minute, basal. `boluses`: patient, minute, units, carb_g.
    """
    def spread(column: str, length: int, name: str) -> DataFrame:
        return boluses.filter(F.col(column) != 0).select(
            PID,
            F.explode(F.sequence(F.col("minute"), F.col("minute") + length - 1)).alias("minute"),
            (F.col(column) * 1000.0 / length).alias(name),
        )

    delivered = (
        spread("units", K.BOLUS_DURATION, "bolus_rate")
        .unionByName(spread("carb_g", K.ANNOUNCE_DURATION, "carb_rate"), allowMissingColumns=True)
        .groupBy(PID, "minute")
        .agg(F.sum("bolus_rate").alias("bolus_rate"), F.sum("carb_rate").alias("carb_rate"))
    )
    return (
        grid.join(delivered, [PID, "minute"], "left")
        .withColumn("insulin", F.col("basal") + F.coalesce("bolus_rate", F.lit(0.0)))
        .withColumn("carbs", F.coalesce("carb_rate", F.lit(0.0)))
        .drop("bolus_rate", "carb_rate")
    )


def series_lengths(rows: DataFrame) -> DataFrame:
    """(patient, T) of a series that starts at minute 0; the channel rows give the same as the grid."""
    return rows.groupBy(PID).agg((F.max("minute") + 1).alias("T"))


def valid_stretches(rows: DataFrame, gap: int = K.MAX_GAP_MIN, block: int = K.MINUTES_PER_DAY) -> DataFrame:
    """(patient, first, last) of the longest stretches whose minutes are all valid: samples at most `gap` minutes apart.

    Stretches of a block of minutes come first, from one shuffle of the samples; what meets at the borders of
    blocks is joined over those stretches, one row a block and gap.
    """
    samples = rows.filter("glucose IS NOT NULL").select(PID, "minute")
    inside = Window.partitionBy(PID, ordered.BLOCK).orderBy("minute")
    opens = F.coalesce((F.col("minute") - F.lag("minute").over(inside) > gap).cast("int"), F.lit(0))
    cut = ordered.with_block(samples, "minute", block).withColumn("_opens", opens)
    cut = cut.withColumn("_part", F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut.groupBy(PID, ordered.BLOCK, "_part").agg(F.min("minute").alias("first"), F.max("minute").alias("last"))
    across = Window.partitionBy(PID).orderBy("first")
    opens = F.coalesce((F.col("first") - F.lag("last").over(across) > gap).cast("long"), F.lit(0))
    parts = parts.withColumn("_opens", opens)
    parts = parts.withColumn("_run", F.sum("_opens").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(PID, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def rolling_median(
    grid: DataFrame, column: str, name: str = "median", window: int = K.BASAL_MEDIAN_WINDOW,
    edge: str = "reflect", tile: int = 720, lengths: DataFrame | None = None,
) -> DataFrame:
    """Centred median over `window` minutes of a dense series starting at minute 0.

    `reflect` mirrors the ends with the edge sample repeated, `nearest` repeats the edge
    sample; a shorter series shrinks the window to its largest odd length when reflecting.
    `lengths` (patient, T) saves a second look at the series.
    """
    columns = [c for c in grid.columns if c != PID]
    half = window // 2
    rows = joins.lookup_join(grid, series_lengths(grid) if lengths is None else lengths, [PID])
    T, m = F.col("T"), F.col("minute")
    odd = F.when(T % 2 == 1, T).otherwise(F.greatest(T - 1, F.lit(1)))
    rows = rows.withColumn("_half", F.least(F.lit(window), odd).cast("long") if edge == "reflect" else F.lit(window))
    rows = rows.withColumn("_half", F.floor(F.col("_half") / 2).cast("long"))
    h = F.col("_half")
    if edge == "reflect":
        left = F.when(m < h, F.array(-1 - m)).otherwise(F.array().cast("array<bigint>"))
        right = F.when(m >= T - h, F.array(2 * T - 1 - m)).otherwise(F.array().cast("array<bigint>"))
    elif edge == "nearest":
        empty = F.array().cast("array<bigint>")
        left = F.when(m == 0, F.sequence(-h, F.lit(-1).cast("long"))).otherwise(empty)
        right = F.when(m == T - 1, F.sequence(T, T + h - 1)).otherwise(empty)
    else:
        raise ValueError(f"unknown edge mode: {edge}")
    padded = rows.withColumn("_pos", F.explode(F.concat(F.array(m), left, right)))
    tiled = ordered.with_halo(padded, "_pos", tile, half, half)
    real = (F.col(ordered.CORE) & (F.col("_pos") == m)).alias("_real")
    # a tile holds at most tile + 2 * half values of one patient; each frame is a slice of it
    cut = tiled.groupBy(PID, ordered.TILE).agg(
        F.sort_array(F.collect_list(F.struct("_pos", real, "_half", *columns))).alias("_rows")
    )
    cut = cut.withColumns({"_values": F.col("_rows")[column], "_first": F.col("_rows")[0]["_pos"]})
    values, first = F.col("_values"), F.col("_first")

    def middle(row: Column) -> Column:
        at, reach = row["_pos"], row["_half"]
        frame = F.slice(values, (at - first - reach + 1).cast("int"), (2 * reach + 1).cast("int"))
        median = F.element_at(F.sort_array(frame), (reach + 1).cast("int"))
        return F.struct(*[row[c].alias(c) for c in columns], median.alias(name))

    kept = F.filter("_rows", lambda row: row["_real"])
    return cut.select(PID, F.inline(F.transform(kept, middle)))


def consolidate(grid: DataFrame, boluses: DataFrame, meals: DataFrame, step: int = 5) -> DataFrame:
    """`step`-minute grid: sample glucose and basal, sum boluses and carbs; the last bin takes the tail.

    `grid`: patient, minute, glucose, basal (mU/min).
    """
    bins = grid.filter(F.col("minute") % step == 0).select(
        PID,
        ordered.floor_div("minute", step).alias("bin"),
        rounding.half_even(rounding.settled(F.col("glucose")), 2).alias("glucose"),
        F.round(F.col("basal") / 1000.0 * 60.0, 4).alias("basal_rate"),
    )
    last = grid.groupBy(PID).agg(F.max(ordered.floor_div("minute", step)).alias("_last"))

    def summed(events: DataFrame, value: str, name: str) -> DataFrame:
        part = events.groupBy(PID, ordered.floor_div("minute", step).alias("bin")).agg(F.sum(value).alias("_s"))
        part = joins.lookup_join(part, last, [PID])
        return part.groupBy(PID, F.least("bin", "_last").alias("bin")).agg(F.sum("_s").alias(name))

    out = bins.join(summed(boluses, "units", "bolus"), [PID, "bin"], "left")
    out = out.join(summed(meals, "carb_g", "carbs"), [PID, "bin"], "left")
    return out.select(
        PID,
        (F.col("bin") * step).alias("minute"),
        "glucose",
        "basal_rate",
        rounding.half_even(rounding.settled(F.coalesce("bolus", F.lit(0.0))), 3).alias("bolus"),
        rounding.half_even(rounding.settled(F.coalesce("carbs", F.lit(0.0))), 1).alias("carbs"),
    )
