"""Trimming by bins against trimming the values themselves."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.operators import calibrate, trimmed

SCORED = "patient_id int, start long, score double"


def plainly(values, k=2.0, passes=3):
    """The rule on sorted values, NaN last and above everything."""
    s = np.sort(np.asarray(values, float))
    least = max(len(s) // 2, 1)

    def quantile(n, p):
        at = (n - 1) * p
        a, b = s[math.floor(at)], s[math.ceil(at)]
        return a + (b - a) * (at - math.floor(at))

    n = len(s)
    with np.errstate(all="ignore"):
        for step in range(passes + 1):  # the last step only reads the result
            sigma = np.maximum((quantile(n, 0.75) - quantile(n, 0.25)) / K.IQR_PER_SIGMA, K.SIGMA_FLOOR)
            cut = quantile(n, 0.5) + k * sigma
            kept = len(s) if np.isnan(cut) else int((s <= cut).sum())
            if step < passes and kept >= least:
                n = kept
        return quantile(n, 0.5), sigma, cut, n


def in_bins(values, edges):
    s = np.sort(np.asarray(values, float))
    place = np.searchsorted(edges, s, side="right")
    place[np.isnan(s)] = len(edges) + 1
    groups = [s[place == b] for b in np.unique(place)]
    return [(g[0], g[-1], len(g)) for g in groups]


def refined(bins, touched, values):
    s = np.sort(np.asarray(values, float))
    out, at = [], 0
    for (lo, hi, n), fine in zip(bins, touched):
        part = s[at : at + n]
        out += [(v, v, int(c)) for v, c in zip(*np.unique(part, return_counts=True))] if fine else [(lo, hi, n)]
        at += n
    return out


def check(values, edges, k, passes):
    bins = in_bins(values, edges)
    touched = trimmed.follow(*map(np.array, zip(*bins)), k, passes)[-1]
    *results, rest = trimmed.follow(*map(np.array, zip(*refined(bins, touched, values))), k, passes)
    assert not rest.any()
    got = tuple(r[0] for r in results)
    assert all(a == b or (np.isnan(a) and np.isnan(b)) for a, b in zip(got, plainly(values, k, passes))), (got, plainly(values, k, passes))
    return touched, bins


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.floats(-1e6, 1e6) | st.sampled_from([0.0, 1.0, 2.0, math.inf, -math.inf, math.nan]), min_size=1, max_size=60),
    st.lists(st.floats(-1e3, 1e3), min_size=0, max_size=6),
    st.sampled_from([0.1, 0.5, 2.0, 5.0]),
    st.integers(0, 4),
)
def test_bounds_hold_whatever_the_bins(values, edges, k, passes):
    check(values, np.sort([-1e300, *edges, 1e300]), k, passes)


@pytest.mark.parametrize("shape", ["skewed", "heavy", "two humps", "tied"])
def test_few_bins_of_many_are_read(shape):
    rng = np.random.default_rng(7)
    values = {
        "skewed": rng.exponential(1.0, 200_000) ** 2,
        "heavy": np.abs(rng.standard_cauchy(200_000)),
        "two humps": np.r_[rng.normal(5, 0.5, 110_000), rng.normal(9, 0.5, 90_000)],
        "tied": rng.integers(0, 50, 200_000).astype(float),
    }[shape]
    edges = np.exp(np.arange(-14 * 1024, 20 * 1024) / 1024)
    touched, bins = check(values, edges, K.THRESHOLD_K, 3)
    assert sum(n for (*_, n), fine in zip(bins, touched) if fine) < 0.05 * len(values)


def test_bins_keep_the_order(spark):
    special = [-math.inf, -1e308, -3.5, -1e-9, 0.0, 1e-9, 1e-6, 0.5, 0.5001, 1.0, 1e12, 1e308, math.inf, math.nan]
    rng = np.random.default_rng(1)
    values = np.sort(np.r_[special, rng.normal(size=500), rng.exponential(size=500) ** 9])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = [r.b for r in df.select("i", trimmed.value_bin(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)
    assert len({got[0], got[1]}) == 2 and len(set(got[-3:])) == 3
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS v").select(trimmed.value_bin(F.col("v"))).first()[0] is None


def test_baseline_of_odd_scores(table):
    series = {
        1: [1.0], 2: [0.0] * 7, 3: [1.0, 2.0, 3.0, math.inf, math.inf, math.inf], 4: [math.nan] * 3,
        5: [1.0, 1.0, 2.0, math.nan], 6: [-4.0, -3.0, -2.5, -1.0, 0.0, 90.0],
    }
    rows = [(p, i, v) for p, s in series.items() for i, v in enumerate(s)] + [(1, 9, None), (7, 0, None)]
    got = {r.patient_id: r for r in calibrate.robust_baseline(table(rows, SCORED)).collect()}
    assert set(got) == set(series)
    for p, s in series.items():
        found = (got[p]["median"], got[p]["sigma"], got[p]["threshold"], got[p]["kept"])
        assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(found, plainly(s))), (p, found, plainly(s))


def test_width_of_bins_does_not_matter(table):
    rng = np.random.default_rng(0)
    rows = [(1 + i % 3, i, float(x)) for i, x in enumerate(rng.normal(size=900) ** 3)]
    results = [
        sorted(map(tuple, trimmed.trimmed_quartiles(table(rows, SCORED), ["patient_id"], "score", 2.0, 3, width).collect()))
        for width in (1, 40, trimmed.PER_E_FOLD)
    ]
    assert results[0] == results[1] == results[2]
    assert [r[0] for r in results[0]] == [1, 2, 3]
    for p, *found in results[0]:
        assert found == list(plainly([x for q, _, x in rows if q == p]))


def test_scores_are_scanned_twice_and_ranks_never_joined(spark, table):
    rows = [(1 + i % 3, i, float(i % 71)) for i in range(900)]
    plan = calibrate.robust_baseline(table(rows, SCORED))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1
