"""Where labels lie on the series: fixed windows, glucose excursions, injected errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.operators import events, joins, ordered, series
from sugartrace.operators import windows as W
from sugartrace.session import materialize

PID = "patient_id"


def _cap(column: Column, caps: dict[str, int] = K.EXCURSION_CAP) -> Column:
    names = list(caps)
    chain = F.when(column == names[0], caps[names[0]])
    for name in names[1:]:
        chain = chain.when(column == name, caps[name])
    return chain


def sustained(mask: Column, need: int) -> Column:
    """0-based position of the first `need` consecutive true values, null if there is none."""
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), none.alias("found"))

    def step(acc: Column, ok: Column) -> Column:
        run = F.when(ok, acc["run"] + 1).otherwise(0)
        found = F.coalesce(acc["found"], F.when(run >= need, acc["i"] - need + 1))
        return F.struct((acc["i"] + 1).alias("i"), run.alias("run"), found.alias("found"))

    return F.aggregate(mask, start, step, lambda acc: acc["found"])


def excursion_windows(
    meals: DataFrame, grid: DataFrame, rise: float = K.EXCURSION_RISE, sustain: int = K.EXCURSION_SUSTAIN,
    back: float = K.EXCURSION_RETURN, pre: int = K.EXCURSION_PRE, tile: int = 1440, lengths: DataFrame | None = None,
) -> DataFrame:
    """Bracket the glucose excursion after each labelled meal; null start and end where none is found.

    `meals`: patient, minute, class. `grid`: dense minutes with glucose (null = dropout). Each
    meal reads its stretch of at most pre + cap + 1 minutes from the tile it lies in.
    """
    longest = max(K.EXCURSION_CAP.values())
    cut = W.tiles(grid, ["glucose"], before=pre, after=longest, tile=tile)
    lengths = series.series_lengths(grid) if lengths is None else lengths
    spots = meals.select(PID, "minute", "class").distinct().withColumn(ordered.TILE, ordered.floor_div("minute", tile))
    spots = joins.lookup_join(spots, lengths, [PID])
    rows = spots.filter("minute >= 0 AND minute < T").join(cut, [PID, ordered.TILE])
    m, T = F.col("minute"), F.col("T")

    def stretch(low: Column, high: Column) -> Column:
        """Glucose of minutes [low, high)."""
        return F.slice(F.col("rows")["glucose"], (low - F.col("first") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))

    finite = lambda x: x.isNotNull() & ~F.isnan(x)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    rows = rows.withColumn("_pre", stretch(F.greatest(m - pre, F.lit(0)), m))
    known = F.filter("_pre", finite)
    usable = (F.size("_pre") > 0) & (F.size(known) / F.nullif(F.size("_pre"), F.lit(0)) >= 0.5)
    rows = rows.withColumn("_base", F.when(usable, add(known) / F.size(known)))
    rows = rows.withColumn("_hi", F.least(T, m + _cap(F.col("class")) + 1)).withColumn("_seg", stretch(m, F.col("_hi")))
    above = F.transform("_seg", lambda x: F.coalesce(finite(x) & (x >= F.col("_base") + rise), F.lit(False)))
    rows = rows.withColumn("_on", sustained(above, sustain))
    post = F.slice("_seg", (F.col("_on") + 1).cast("int"), F.size("_seg"))
    rows = rows.withColumn("_post", F.transform(post, lambda x: F.when(finite(x), x)))
    rows = rows.withColumn("_peak", (F.array_position("_post", F.array_max("_post")) - 1).cast("int"))
    rows = rows.withColumn("_tail", F.slice("_post", F.col("_peak") + 1, F.size("_post")))
    near = F.transform("_tail", lambda x: F.coalesce(x <= F.col("_base") + back * rise, F.lit(False)))
    rows = rows.withColumn("_ret", sustained(near, sustain))
    start = m + F.col("_on")
    end = F.coalesce(start + F.col("_peak") + F.col("_ret"), F.least(T, m + _cap(F.col("class"))))
    found = rows.select(
        PID, "minute", "class", start.alias("start"),
        F.when(F.col("_on").isNotNull(), F.least(T, F.greatest(end, start + 1))).alias("end"),
    )
    return meals.join(found, [PID, "minute", "class"], "left")


def label_intervals(
    meals: DataFrame, grid: DataFrame, mode: str = "flat", drop_no_excursion: bool = False,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """(patient, class, start, end) of each labelled meal, cut at the end of the series."""
    lengths = series.series_lengths(grid) if lengths is None else lengths
    sized = joins.lookup_join(meals, lengths, [PID])
    m = F.col("minute")
    if mode == "flat":
        return sized.select(PID, "class", m.alias("start"), F.least("T", m + K.FLAT_LABEL_MIN).alias("end"))
    fixed = F.least(F.col("T"), m + _cap(F.col("class")))
    if mode == "aligned":
        return sized.select(PID, "class", m.alias("start"), fixed.alias("end"))
    if mode != "excursion":
        raise ValueError(f"unknown label mode: {mode}")
    placed = excursion_windows(sized, grid, lengths=lengths)
    if drop_no_excursion:
        placed = placed.filter("start IS NOT NULL")
    return placed.select(PID, "class", F.coalesce("start", m).alias("start"), F.coalesce("end", fixed).alias("end"))


def label_array(grid: DataFrame, intervals: DataFrame) -> DataFrame:
    """The grid with 0/1 flags of the three meal classes from their intervals."""
    classes = list(K.EXCURSION_CAP)
    minutes = intervals.filter(F.col("start") < F.col("end")).select(
        PID, "class", F.explode(F.sequence(F.col("start").cast("long"), (F.col("end") - 1).cast("long"))).alias("minute")
    )
    flags = minutes.groupBy(PID, "minute").agg(
        *[F.max((F.col("class") == c).cast("double")).alias(f"f_{c}") for c in classes]
    )
    return grid.join(flags, [PID, "minute"], "left").fillna(0.0, [f"f_{c}" for c in classes])


def iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    overlap = F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))
    union = (end_a - start_a) + (end_b - start_b) - overlap
    return F.when(union != 0, overlap / union).otherwise(0.0)


def placement_quality(pairs: DataFrame) -> DataFrame:
    """Per class: true runs, how many were placed, the median and mean IoU over all (0 where not placed), the median over those placed.

    `pairs`: class, start, end (placed or null), true_start, true_end.
    """
    rows = pairs.withColumn(
        "iou",
        F.coalesce(iou(F.col("start"), F.col("end"), F.col("true_start"), F.col("true_end")), F.lit(0.0)),
    )
    counts = rows.groupBy("class").agg(F.count(F.lit(1)).alias("runs"), F.count("start").alias("found"), F.avg("iou").alias("mean_iou"))
    median = ordered.grouped_quantiles(rows, ["class"], "iou", {"median_iou": 0.5}).drop("n")
    placed = rows.filter("start IS NOT NULL")
    found = ordered.grouped_quantiles(placed, ["class"], "iou", {"median_iou_found": 0.5}).drop("n")
    return counts.join(median, "class").join(found, "class", "left").withColumn("recall", F.col("found") / F.col("runs"))


def true_runs(grid: DataFrame, before: int = 15) -> DataFrame:
    """Runs of the meal-class flags and the meal minute before each."""
    out = None
    for name in K.EXCURSION_CAP:
        part = events.run_bounds(grid, F.col(f"f_{name}") > 0).select(
            PID,
            F.lit(name).alias("class"),
            F.greatest(F.col("start") - before, F.lit(0)).alias("minute"),
            F.col("start").alias("true_start"),
            F.col("end").alias("true_end"),
        )
        out = part if out is None else out.unionByName(part)
    return out


# ---- injected errors -----------------------------------------------------------------------


def inject_boluses(
    boluses: DataFrame, lengths: DataFrame, cls: str, delay: int = 30, keep: float = 0.7, min_carb_g: float = 20.0
) -> DataFrame:
    """Bolus list with every meal bolus missed, late or under-reported; `flag_minute` marks the change.

    `lengths`: patient, T. Missed boluses stay as rows without dose, for their flag.
    """
    meal = F.col("carb_g") >= min_carb_g
    flagged = boluses.withColumn("flag_minute", F.when(meal, F.col("minute")))
    if cls == "missed":
        return flagged.withColumns({c: F.when(meal, 0.0).otherwise(F.col(c)) for c in ("units", "carb_g")})
    if cls == "late":
        moved = joins.lookup_join(flagged, lengths, [PID])
        later = F.least(F.col("T") - 1, F.col("minute") + delay)
        return moved.withColumn("minute", F.when(meal, later).otherwise(F.col("minute"))).drop("T")
    if cls == "large":
        return flagged.withColumn("carb_g", F.when(meal, F.col("carb_g") * keep).otherwise(F.col("carb_g")))
    raise ValueError(f"unknown class: {cls}")


def inject_channel(
    grid: DataFrame, cls: str, delay: int = 30, keep: float = 0.7, min_total: float = 20_000.0,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """The same on rate channels: bolus = insulin above the rolling basal, meals = carb runs.

    Adds `flag` at each changed meal's onset; glucose is untouched. A late meal whose carbs
    land on a later changed meal moves on with that one, as if meals were handled in order: carbs go to the end of a
    chain of minutes `delay` apart, found by carrying the chains' ends back along every `delay`-th minute.
    """
    base = series.rolling_median(grid, "insulin", "_basal", edge="nearest", lengths=lengths).withColumn(
        "_bolus", F.greatest(F.lit(0.0), F.col("insulin") - F.col("_basal"))
    )
    base = ordered.materialize(base)  # the medians are read for the runs, their summary and the result
    boxed = ordered.islands(ordered.with_block(base, "minute", K.MINUTES_PER_DAY), [PID], "minute", F.col("carbs") > 0)
    runs = boxed.groupBy(PID, "run").agg(F.sum("carbs").alias("_total"), F.min("minute").alias("_onset"))
    meals = materialize(
        boxed.join(runs.filter(F.col("_total") >= min_total), [PID, "run"]).select(
            PID, "minute", "run", "_onset", F.col("carbs").alias("_c"), "_bolus"
        )
    )
    marked = base.drop("_bolus").join(meals, [PID, "minute"], "left")
    inside = F.col("run").isNotNull()
    onset = F.when(inside & (F.col("minute") == F.col("_onset")), 1.0).otherwise(0.0)
    marked = marked.withColumn("flag", onset)
    keepers = ["glucose", "valid"]
    keepers = [c for c in keepers if c in grid.columns]
    if cls == "large":
        out = marked.withColumn("carbs", F.when(inside, F.col("carbs") * keep).otherwise(F.col("carbs")))
        return out.select(PID, "minute", *keepers, "insulin", "carbs", "flag")
    removed = marked.withColumns(
        {
            "insulin": F.col("insulin") - F.coalesce("_bolus", F.lit(0.0)),
            "carbs": F.when(inside, 0.0).otherwise(F.col("carbs")),
        }
    )
    if cls == "missed":
        return removed.select(PID, "minute", *keepers, "insulin", "carbs", "flag")
    if cls != "late":
        raise ValueError(f"unknown class: {cls}")
    insulin = meals.select(PID, (F.col("minute") + delay).alias("minute"), F.col("_bolus").alias("_i"))
    after = meals.select(PID, (F.col("minute") - delay).alias("minute"), F.col("run").alias("_other"))
    met = meals.join(after, [PID, "minute"], "left")
    stops = F.col("_other").isNull() | (F.col("_other") == F.col("run"))
    lines = ordered.with_block(met.withColumn("_line", F.pmod("minute", F.lit(max(delay, 1)))), "minute", K.MINUTES_PER_DAY)
    ends = ordered.sweep(lines, [PID, "_line"], ["minute"], backward={"_end": F.when(stops, F.col("minute"))})
    landed = ends.select(PID, (F.col("_end") + delay).alias("minute"), "_c")
    added = (
        insulin.unionByName(landed, allowMissingColumns=True)
        .groupBy(PID, "minute")
        .agg(F.sum("_i").alias("_i"), F.sum("_c").alias("_d"))
    )
    out = removed.drop("_c").join(added, [PID, "minute"], "left")
    return out.select(
        PID, "minute", *keepers,
        (F.col("insulin") + F.coalesce("_i", F.lit(0.0))).alias("insulin"),
        (F.col("carbs") + F.coalesce("_d", F.lit(0.0))).alias("carbs"),
        "flag",
    )
