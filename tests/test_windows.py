"""Labels and valid starts of windows against windows taken one by one."""

import numpy as np
import pytest

from sugartrace.operators import series
from sugartrace.operators import windows as W

LENGTHS = "patient_id int, T long"
FLAGS = ("f_a", "f_b")
SPARSE = "patient_id int, minute long, f_a double, f_b double"
SAMPLES = "patient_id int, id long, minute long, glucose double, insulin double, carbs double"


def flag_series(rng):
    """Dense flags of four patients: sparse ones, none, all, and a series shorter than a window."""
    return {
        1: (rng.random((3000, 2)) < 0.004).astype(float),
        2: np.zeros((400, 2)),
        3: np.ones((500, 2)),
        4: np.ones((20, 2)),
    }


@pytest.mark.parametrize("length,stride,skip", [(120, 15, 0), (160, 15, 0), (160, 5, 120), (37, 10, 4), (9, 10, 0), (12, 10, 11), (30, 7, 29)])
def test_labels(table, length, stride, skip):
    data = flag_series(np.random.default_rng(length))
    lengths = table([(p, len(x)) for p, x in data.items()], LENGTHS)
    rows = [(p, m, float(a), float(b)) for p, x in data.items() for m, (a, b) in enumerate(x) if a or b or m % 50 == 0]
    expected = {
        (p, s): tuple(x[s + skip : s + length].max(0)) for p, x in data.items() for s in range(0, len(x) - length + 1, stride)
    }
    got = W.window_labels(table(rows, SPARSE), lengths, length, stride, FLAGS, skip).collect()
    assert len(got) == len(expected)
    assert {(r.patient_id, r.start): (r.f_a, r.f_b) for r in got} == expected
    clean = W.clean_windows(table(rows, SPARSE), lengths, length, stride, FLAGS).collect()
    whole = {(p, s) for p, x in data.items() for s in range(0, len(x) - length + 1, stride) if not x[s : s + length].any()}
    assert {tuple(r) for r in clean} == whole


def test_labels_without_flags_or_series(table):
    none = table([], SPARSE)
    assert W.window_labels(none, table([], LENGTHS), 10, 5, FLAGS).collect() == []
    rows = W.window_labels(none, table([(1, 15)], LENGTHS), 10, 5, FLAGS).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 0.0, 0.0), (1, 5, 0.0, 0.0)]
    null = table([(1, 3, None, 1.0)], SPARSE)
    assert sorted(tuple(r) for r in W.window_labels(null, table([(1, 10)], LENGTHS), 10, 5, FLAGS).collect()) == [(1, 0, 0.0, 1.0)]


def test_labels_build_no_window(table):
    labels = W.window_labels(table([(1, 3, 1.0, 0.0)], SPARSE), table([(1, 500)], LENGTHS), 120, 15, FLAGS)
    plan = labels._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "slice" not in plan and "Join" not in plan and "Window" not in plan


def sample_rows(rng):
    """Samples with gaps below, at and above the limit, at the borders of days, repeated and missing."""
    out, number = [], 0
    for patient, n in ((1, 2500), (2, 40), (3, 1), (4, 600)):
        minute = 0
        for _ in range(n):
            out.append((patient, number, minute, 5.0 if rng.random() < 0.9 else None, None, 1.0))
            number += 1
            minute += int(rng.choice([0, 1, 5, 29, 30, 31, 400], p=[0.02, 0.1, 0.8, 0.02, 0.02, 0.02, 0.02]))
    return out


@pytest.mark.parametrize("length,stride", [(160, 5), (30, 7), (1, 1)])
def test_valid_starts(table, length, stride):
    rows = table(sample_rows(np.random.default_rng(3)), SAMPLES)
    valid = {}
    for r in series.minute_grid(rows).filter("valid").collect():
        valid.setdefault(r.patient_id, set()).add(r.minute)
    expected = {
        (p, s) for p, m in valid.items() for s in range(0, max(m) + 1, stride) if all(s + k in m for k in range(length))
    }
    got = W.valid_windows(rows, length, stride).collect()
    assert len(got) == len(expected) and {(r.patient_id, r.start) for r in got} == expected


def test_valid_stretches(table):
    rows = [(1, i, m, 5.0, None, None) for i, m in enumerate([0, 30, 61, 1439, 1441, 4000, 4000])]
    got = series.valid_stretches(table(rows, SAMPLES)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 30), (1, 61, 61), (1, 1439, 1441), (1, 4000, 4000)]


def test_long_stretches_open_in_pieces(table):
    rows = [(1, i, 30 * i, 5.0, None, None) for i in range(1000)]
    got = W.valid_windows(table(rows, SAMPLES), 10, 1).collect()
    assert sorted(r.start for r in got) == list(range(30 * 999 + 1 - 9))
