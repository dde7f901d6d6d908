import numpy as np
import pytest
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.operators import events, series
from sugartrace.operators import windows as W

ROWS = "patient_id int, id long, minute long, glucose double, insulin double, carbs double"
GRID = "patient_id int, minute long, glucose double, insulin double, carbs double"


def grid_of(table, rows, block=1440):
    full = [(1, i, *r) for i, r in enumerate(rows)]
    return series.minute_grid(table(full, ROWS), block).orderBy("minute").collect()


@pytest.mark.parametrize("block", [4, 1440])
def test_five_minute_samples_interpolate_and_are_valid(table, block):
    out = grid_of(table, [(5 * i, 5.0 + i, None, None) for i in range(12)], block)
    assert [r.minute for r in out] == list(range(56)) and all(r.valid for r in out)
    assert np.allclose([r.glucose for r in out], np.interp(range(56), range(0, 60, 5), [5.0 + i for i in range(12)]))


def test_long_gap_is_invalid_inside_only(table):
    out = {r.minute: r for r in grid_of(table, [(0, 5.0, None, None), (90, 8.0, None, None), (120, 7.0, None, None)], 10)}
    assert out[0].valid and out[90].valid and not out[1].valid and not out[89].valid
    assert out[91].valid  # a gap of exactly 30 is bridged


def test_outside_samples_flat_and_invalid_and_last_write_wins(table):
    rows = [(0, None, 0.5, None), (3, 6.0, None, None), (3, 7.0, None, None), (8, None, None, 12.0)]
    out = grid_of(table, rows, 2)
    assert [r.glucose for r in out] == [7.0] * 9
    assert [r.valid for r in out] == [m == 3 for m in range(9)]
    assert out[0].insulin == 0.5 and out[8].carbs == 12.0 and out[5].insulin == 0.0


def test_zscore_is_by_patient_over_every_minute(table):
    rows = [(p, m, float(m * p), 1.0, 0.0) for p in (1, 2) for m in range(10)]
    out = series.zscore_patient(table(rows, GRID))
    stats = out.groupBy("patient_id").agg(F.avg("glucose").alias("m"), F.stddev_pop("glucose").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in stats)
    assert {r.insulin for r in out.collect()} == {0.0}  # constant channel: floored deviation
    with pytest.raises(ValueError):
        series.normalize(table(rows, GRID), "nonsense")


def recursion(u, tau, gain=1.0):
    a, s1, s2, out = 1 / tau, 0.0, 0.0, []
    for i in range(len(u)):
        if i:
            s1, s2 = (1 - a) * s1 + gain * u[i - 1], (1 - a) * s2 + a * s1
        out.append(s1 + s2)
    return out


@pytest.mark.parametrize("block", [500, 1440])
def test_on_board_equals_the_recursion(table, block):
    rng = np.random.default_rng(0)
    u, d = rng.random(4000), rng.random(4000) * 50
    rows = [(1, m, 0.0, float(u[m]), float(d[m])) for m in range(4000)]
    out = series.iob_cob(table(rows, GRID), block).orderBy("minute").collect()
    assert np.allclose([r.iob for r in out], recursion(u, K.TAU_INSULIN), atol=1e-7)
    assert np.allclose([r.cob for r in out], recursion(d, K.TAU_CARB, K.CARB_BIOAVAILABILITY), atol=1e-6)


def median_filter(x, size, edge):
    if edge == "reflect":
        size = min(size, len(x) if len(x) % 2 else max(len(x) - 1, 1))
    half = size // 2
    padded = np.pad(x, half, mode="symmetric" if edge == "reflect" else "edge")
    return [float(np.median(padded[i : i + 2 * half + 1])) for i in range(len(x))]


@pytest.mark.parametrize("edge", ["reflect", "nearest"])
@pytest.mark.parametrize("length", [1, 20, 61, 150])
def test_rolling_median(table, edge, length):
    x = np.random.default_rng(length).random(length)
    rows = [(1, m, 0.0, float(x[m]), 0.0) for m in range(length)]
    out = series.rolling_median(table(rows, GRID), "insulin", edge=edge, tile=64).orderBy("minute").collect()
    assert np.allclose([r["median"] for r in out], median_filter(x, 61, edge))


def test_derive_events_sums_carb_runs_and_spikes(table):
    rows = [(1, m, 6.0, 0.02 + (1.0 if m in (150, 151, 152) else 0.0), 2.0 if 100 <= m < 130 else 0.0) for m in range(300)]
    meals, boluses = events.derive_events(table(rows, GRID), block=11)
    assert [(r.minute, r.carb_g) for r in meals.collect()] == [(100, 60.0)]
    assert [(r.minute, round(r.units, 6)) for r in boluses.collect()] == [(150, 3.0)]


def test_basal_hold_and_override(table):
    grid = table([(1, m) for m in range(10)], "patient_id int, minute long")
    entries = table([(1, 2, 5.0, 0), (1, 6, 7.0, 1)], "patient_id int, minute long, rate double, seq long")
    held = series.basal_hold(grid, entries, block=3)
    over = table([(1, 4, 7, 1.0, 0), (1, 7, 8, 2.0, 1)], "patient_id int, begin long, end long, rate double, seq long")
    out = series.temp_basal_override(held, over).orderBy("minute").collect()
    assert [r.basal for r in out] == [0.0, 0.0, 5.0, 5.0, 1.0, 1.0, 1.0, 2.0, 2.0, 7.0]


def test_render_spreads_and_cuts_at_the_end(table):
    grid = table([(1, m, 1.0) for m in range(10)], "patient_id int, minute long, basal double")
    boluses = table([(1, 8, 3.0, 40.0)], "patient_id int, minute long, units double, carb_g double")
    out = series.render_channels(grid, boluses).orderBy("minute").collect()
    assert [r.insulin for r in out] == [1.0] * 8 + [1001.0] * 2
    assert [r.carbs for r in out] == [0.0] * 8 + [2000.0] * 2


def test_consolidate_last_bin_takes_the_tail(table):
    grid = table([(1, m, 6.0 + m, 60.0) for m in range(11)], "patient_id int, minute long, glucose double, basal double")
    boluses = table([(1, 4, 1.0), (1, 99, 2.0)], "patient_id int, minute long, units double")
    meals = table([(1, 10, 30.0)], "patient_id int, minute long, carb_g double")
    out = series.consolidate(grid, boluses, meals).orderBy("minute").collect()
    assert [(r.minute, r.glucose, r.basal_rate, r.bolus, r.carbs) for r in out] == [
        (0, 6.0, 3.6, 1.0, 0.0), (5, 11.0, 3.6, 0.0, 0.0), (10, 16.0, 3.6, 2.0, 30.0)]


@pytest.mark.parametrize("tile", [7, 720])
def test_windows_are_complete_and_strided(table, tile):
    grid = table([(1, m, float(m)) for m in range(50)], "patient_id int, minute long, glucose double")
    out = W.windows(grid, ["glucose"], 12, 5, offset=3, tile=tile).orderBy("start").collect()
    assert [r.start for r in out] == list(range(3, 39, 5))
    assert all(r.glucose == [float(x) for x in range(r.start, r.start + 12)] for r in out)


@pytest.mark.parametrize("block", [3, 1440])
def test_collapse_runs(table, block):
    rows = [(1, m, v) for m, v in enumerate([0.0, 0.0, 3.0, 3.0, 3.0, 0.0, 4.0])]
    out = events.collapse_runs(table(rows, "patient_id int, absolute_minute long, c double"), "c", block=block)
    assert [r.collapsed for r in out.orderBy("absolute_minute").collect()] == [0.0, 0.0, 9.0, 0.0, 0.0, 0.0, 4.0]


def test_basal_markers(table):
    values = [50.0, 50.0, 0.0, 0.0, 60.0, 150.0, 60.0]
    rows = [(1, 58 + m, v) for m, v in enumerate(values)]
    out = events.basal_events(table(rows, "patient_id int, absolute_minute long, insulin_mu_min double"), block=3)
    # hourly sums at 0 and 60; the stop marker at 60 loses to the hourly sum, the resume marker is at 61
    assert [(r.absolute_minute, r.units) for r in out.orderBy("absolute_minute").collect()] == [(0, 0.1), (60, 0.12), (61, 0.0)]
