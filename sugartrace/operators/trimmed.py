"""Quartiles of repeatedly trimmed values, from two passes over them.

The first pass counts each key's values in fine bins. Bins merge, so copies and neighbours meet before the
shuffle, and a key has at most some 40,000 of them between 1e-6 and 1e12 however many values it has. From the
bins alone every trim is followed with bounds instead of numbers: bounds of the kept count give bounds of the
quartiles, these give bounds of the threshold, and so on. The bins those bounds touch, a few dozen of a key, are
the only ones whose values matter. The second pass fetches just those values, and the same steps run again, now
with exact numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from sugartrace import constants as K
from sugartrace.session import materialize

BIN = "_bin"
PER_E_FOLD = 1024  # bins while a value grows by the factor e
FINEST = 1e-6  # below this size bins have equal widths
ROUNDING = 1e-9  # bounds are widened by this share, above any rounding of the arithmetic
SIDES = ("lo", "hi", "n")


def value_bin(value: Column, per_e_fold: int = PER_E_FOLD) -> Column:
    """Number of a value's bin. Bins are disjoint and in the order of the values; infinities and NaN (the largest
    value, as Spark sorts it) have their own. Null stays null."""
    steps = F.least(F.floor(F.log1p(F.abs(value) / FINEST) * per_e_fold), F.lit(2**60))
    special = F.when(F.isnan(value), F.lit(2**62)).when(F.abs(value) == math.inf, F.lit(2**61))
    size = F.coalesce(special, steps)
    return F.when(value < 0, -size - 1).when(value.isNotNull(), size).cast("long")


def _quantile(lo: np.ndarray, hi: np.ndarray, ends: np.ndarray, p: float, least: int, most: int):
    """Bounds of a quantile of the first `least` to `most` values, whether they are exact, and the bins that decide it."""
    low, high = (least - 1) * p, (most - 1) * p
    first = int(np.searchsorted(ends, math.floor(low), side="right"))
    last = int(np.searchsorted(ends, math.ceil(high), side="right"))
    if least == most and not (lo[first] < hi[first] or lo[last] < hi[last]):
        exact = lo[first] + (lo[last] - lo[first]) * (low - math.floor(low))
        return exact, exact, True, slice(first, last + 1)
    return lo[first], hi[last], False, slice(first, last + 1)


def follow(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, k: float, passes: int):
    """Trim the values of one key `passes` times at median + k sigma, never below half of them.

    Bins come in order, with least and largest value and count. Returns the bounds of (median, sigma, threshold,
    kept) and a mask of the bins with different values that any step depends on. Without such a bin both bounds
    are the exact result.
    """
    ends = np.cumsum(n)
    total = int(ends[-1])
    half = max(total // 2, 1)
    wide = lo < hi
    touched = np.zeros(len(n), bool)
    least = most = total
    with np.errstate(all="ignore"):
        for step in range(passes + 1):
            bounds, exact = [], True
            for p in (0.25, 0.5, 0.75):
                below, above, settled, bins = _quantile(lo, hi, ends, p, least, most)
                touched[bins] |= wide[bins]
                bounds.append((below, above))
                exact &= settled
            (q1, q1_up), (mid, mid_up), (q3, q3_up) = bounds
            sigma = np.maximum((q3 - q1_up) / K.IQR_PER_SIGMA, K.SIGMA_FLOOR)
            sigma_up = np.maximum((q3_up - q1) / K.IQR_PER_SIGMA, K.SIGMA_FLOOR)
            cut, cut_up = mid + k * sigma, mid_up + k * sigma_up
            if step == passes:
                break
            if not exact:
                slack = ROUNDING * np.nanmax(np.abs([*bounds, (cut, cut_up), (0.0, 0.0)]))
                cut = -math.inf if np.isnan(cut - slack) else cut - slack
                cut_up = cut_up + slack
            inside = np.full(len(n), True) if np.isnan(cut) else hi <= cut
            reached = np.full(len(n), True) if np.isnan(cut_up) else lo <= cut_up
            touched |= wide & reached & ~inside
            fewest, largest = int(n[inside].sum()), int(n[reached].sum())
            if fewest >= half:
                least, most = fewest, largest
            elif largest >= half:  # this trim may or may not take place
                least, most = min(least, half), max(most, largest)
    return (mid, mid_up), (sigma, sigma_up), (cut, cut_up), (least, most), touched


def _sorted(rows: pa.Table) -> pa.Table:
    """Bins of one key in order; NaN is the largest."""
    lo = rows.column("lo").to_numpy()
    return rows.take(pa.array(np.argsort(lo, kind="stable")))


def _columns(rows: pa.Table):
    return tuple(rows.column(c).to_numpy() for c in SIDES)


def _mark(k: float, passes: int) -> Callable:
    def mark(rows: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        return rows.append_column("fine", pa.array(follow(*_columns(rows), k, passes)[-1]))

    return mark


def _settle(keys: Sequence[str], k: float, passes: int) -> Callable:
    def settle(rows: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        *results, touched = follow(*_columns(rows), k, passes)
        if touched.any():
            raise ValueError("scores changed between the two passes; write them before")
        names = ("median", "sigma", "threshold", "kept")
        values = {name: pa.array([bounds[0]]) for name, bounds in zip(names, results)}
        return pa.table({**{c: rows.column(c).slice(0, 1) for c in keys}, **values})

    return settle


def _fields(df: DataFrame, keys: Sequence[str]) -> list[StructField]:
    return [df.schema[c] for c in keys]


def trimmed_quartiles(
    df: DataFrame, keys: Sequence[str], value: str, k: float, passes: int, per_e_fold: int = PER_E_FOLD
) -> DataFrame:
    """Median, sigma (from the quartiles), threshold and kept count of each key after `passes` trims.

    `df` is read twice and must give the same values both times. Null values take no part.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    values = df.select(*keys, x.alias("_x")).filter("_x IS NOT NULL").withColumn(BIN, value_bin(F.col("_x"), per_e_fold))
    bins = values.groupBy(*keys, BIN).agg(
        F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    sides = [StructField("lo", DoubleType()), StructField("hi", DoubleType()), StructField("n", LongType())]
    marked = StructType([*_fields(df, keys), StructField(BIN, LongType()), *sides, StructField("fine", BooleanType())])
    staged = materialize(bins.groupBy(*keys).applyInArrow(_mark(k, passes), marked))
    wanted = staged.filter("fine").select(*keys, BIN)
    exact = (
        values.join(wanted, [*keys, BIN])
        .groupBy(*keys, "_x")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("_x").alias("lo"), F.col("_x").alias("hi"), "n")
    )
    rows = staged.filter("NOT fine").select(*keys, *SIDES).unionByName(exact)
    out = StructType(
        [*_fields(df, keys), *[StructField(c, DoubleType()) for c in ("median", "sigma", "threshold")], StructField("kept", LongType())]
    )
    return rows.groupBy(*keys).applyInArrow(_settle(keys, k, passes), out)
