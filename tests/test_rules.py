import numpy as np
import pytest
from pyspark.sql import functions as F

from sugartrace.operators import labels, rules

MEALS = "patient_id int, id long, minute long, carb_g double"
BOLUS = "patient_id int, minute long, units double"


def classify(table, meals, boluses):
    out = rules.classify_meals(
        table([(1, i, m, c) for i, (m, c) in enumerate(meals)], MEALS), table([(1, m, u) for m, u in boluses], BOLUS)
    )
    return {r.minute: (r.timing, r.is_large) for r in out.collect()}


@pytest.mark.parametrize(
    ("boluses", "want"),
    [([(995, 4.0)], None), ([], "missed"), ([(1040, 4.0)], "late"), ([(1090, 4.0)], "missed"), ([(995, 0.0)], "missed"),
     ([(990, 1.0)], None), ([(989, 1.0)], "missed"), ([(1060, 1.0)], "late"), ([(1029, 1.0)], None)],
)
def test_meal_timing(table, boluses, want):
    assert classify(table, [(1000, 50.0)], boluses) == {1000: (want, False)}


def test_snacks_are_skipped(table):
    assert classify(table, [(1000, 5.0)], []) == {}


def test_large_needs_history_and_strictly_earlier_meals(table):
    daily = [(1440 * d + 700, 40.0) for d in range(6)]
    assert classify(table, [*daily, (1440 * 6 + 700, 120.0)], [])[1440 * 6 + 700][1]
    assert not classify(table, [*daily, (1440 * 6 + 700, 42.0)], [])[1440 * 6 + 700][1]
    assert not classify(table, [*daily[:2], (1440 * 2 + 700, 120.0)], [])[1440 * 2 + 700][1]
    # the week looks back 7 days, the same minute does not count
    assert not classify(table, [*daily[:3], (1440 * 12 + 700, 120.0)], [])[1440 * 12 + 700][1]


@pytest.mark.parametrize(
    ("minute", "want"),
    [(995, None), (1000, None), (1014, None), (1015, "late"), (1043, "late"), (1050, "late"), (1075, "late"), (1076, "missed"),
     (985, None), (984, "missed")],
)
def test_detection_rule(table, minute, want):
    events = table([(1, 1000, None)], "patient_id int, start_min long, direction double")
    out = rules.classify_detection(events, table([(1, minute, 2.0)], BOLUS))
    assert [r.rule_label for r in out.collect()] == [want]


@pytest.mark.parametrize(("direction", "want"), [(-0.5, None), (0.0, "missed"), (0.5, "missed"), (None, "missed")])
def test_direction_gates_missed_only(table, direction, want):
    events = table([(1, 1000, direction)], "patient_id int, start_min long, direction double")
    assert [r.rule_label for r in rules.classify_detection(events, table([(2, 1000, 1.0)], BOLUS)).collect()] == [want]
    late = rules.classify_detection(events, table([(1, 1050, 1.0)], BOLUS))
    assert [r.rule_label for r in late.collect()] == ["late"]


def test_clean_meals_drops_snacks_and_rescues(table):
    grid = table([(1, m, 3.5 if m == 80 else 6.0) for m in range(300)], "patient_id int, minute long, glucose double")
    meals = table([(1, 0, 50, 40.0), (1, 1, 100, 40.0), (1, 2, 200, 20.0), (1, 3, 111, 40.0)], MEALS)
    assert sorted(r.minute for r in rules.clean_meals(meals, grid).collect()) == [50, 111]


# ---- excursions: the reference semantics spelled out minute by minute ------------------------


def expected_excursion(g, m, cap):
    T, lo = len(g), max(0, m - 30)
    pre = [x for x in g[lo:m] if x is not None]
    if m == lo or len(pre) / (m - lo) < 0.5:
        return None
    base, hi = sum(pre) / len(pre), min(T, m + cap + 1)

    def first_run(test, a):
        return next((i for i in range(a, hi - 9) if all(g[j] is not None and test(g[j]) for j in range(i, i + 10))), None)

    on = first_run(lambda x: x >= base + 1.1, m)
    if on is None:
        return None
    peak = max((j for j in range(on, hi) if g[j] is not None), key=lambda j: (g[j], -j))
    back = first_run(lambda x: x <= base + 0.55, peak)
    return on, min(T, max(back if back is not None else min(T, m + cap), on + 1))


def traces():
    base = [7.0] * 600
    ramp = base[:]
    for i in range(60):
        ramp[210 + i] = 7.0 + 4.0 * i / 60
    for i in range(60):
        ramp[270 + i] = 11.0 - 4.0 * i / 60
    step = base[:200] + [12.0] * 400
    noise = [7.0 + 0.3 * float(x) for x in np.random.default_rng(1).standard_normal(600)]
    holes = [None if 215 <= i < 225 or i % 37 == 0 else x for i, x in enumerate(ramp)]
    blind = [None if 170 <= i < 190 else x for i, x in enumerate(ramp)]
    return {"ramp": ramp, "flat": base, "step": step, "noise": noise, "holes": holes, "blind": blind}


@pytest.mark.parametrize("name", list(traces()))
@pytest.mark.parametrize("tile", [97, 1440])
def test_excursion(table, name, tile):
    g = traces()[name]
    grid = table([(1, m, x) for m, x in enumerate(g)], "patient_id int, minute long, glucose double")
    meals = [(1, m, c) for m in (0, 10, 200, 430, 590) for c in ("missed", "late", "large")]
    out = labels.excursion_windows(table(meals, "patient_id int, minute long, class string"), grid, tile=tile)
    caps = {"missed": 180, "late": 240, "large": 300}
    got = {(r.minute, r["class"]): (r.start, r.end) if r.start is not None else None for r in out.collect()}
    assert got == {(m, c): expected_excursion(g, m, caps[c]) for _, m, c in meals}


def test_label_array_and_iou(table):
    grid = table([(1, m, 7.0) for m in range(100)], "patient_id int, minute long, glucose double")
    meals = table([(1, 90, "missed"), (1, 10, "late")], "patient_id int, minute long, class string")
    out = labels.label_array(grid, labels.label_intervals(meals, grid, "flat")).orderBy("minute").collect()
    assert [r.minute for r in out if r.f_missed] == list(range(90, 100))
    assert [r.minute for r in out if r.f_late] == list(range(10, 70))
    kept = labels.label_intervals(meals, grid, "excursion", drop_no_excursion=True)
    assert kept.count() == 0
    value = grid.limit(1).select(labels.iou(F.lit(0), F.lit(10), F.lit(5), F.lit(15)).alias("x")).collect()[0].x
    assert value == pytest.approx(1 / 3)


# ---- injected errors ------------------------------------------------------------------------


def test_inject_bolus_list(table):
    boluses = table([(1, 10, 4.0, 30.0), (1, 50, 2.0, 5.0), (1, 95, 3.0, 20.0)], "patient_id int, minute long, units double, carb_g double")
    lengths = table([(1, 100)], "patient_id int, T long")
    late = sorted((r.minute, r.flag_minute) for r in labels.inject_boluses(boluses, lengths, "late").collect())
    assert late == [(40, 10), (50, None), (99, 95)]
    missed = sorted((r.minute, r.units, r.carb_g) for r in labels.inject_boluses(boluses, lengths, "missed").collect())
    assert missed == [(10, 0.0, 0.0), (50, 2.0, 5.0), (95, 0.0, 0.0)]
    large = sorted(r.carb_g for r in labels.inject_boluses(boluses, lengths, "large").collect())
    assert large == [5.0, 14.0, 21.0]


def sequential(insulin, carbs, cls, delay, keep, least):
    insulin, carbs, T = list(insulin), list(carbs), len(insulin)
    padded = np.pad(np.array(insulin), 30, mode="edge")
    basal = [float(np.median(padded[i : i + 61])) for i in range(T)]
    bolus = [max(0.0, insulin[i] - basal[i]) for i in range(T)]
    runs, i = [], 0
    while i < T:
        j = i
        while j < T and carbs[j] > 0:
            j += 1
        if j > i and sum(carbs[i:j]) >= least:
            runs.append((i, j))
        i = j + 1
    flags = [0.0] * T
    for s, e in runs:
        flags[s] = 1.0
        if cls == "large":
            carbs[s:e] = [c * keep for c in carbs[s:e]]
            continue
        moved_i, moved_c = bolus[s:e], carbs[s:e]
        for k in range(s, e):
            insulin[k] -= bolus[k]
            carbs[k] = 0.0
        if cls == "late":
            for k in range(e - s):
                if s + delay + k < T:
                    insulin[s + delay + k] += moved_i[k]
                    carbs[s + delay + k] += moved_c[k]
    return insulin, carbs, flags


@pytest.mark.parametrize("cls", ["missed", "late", "large"])
def test_inject_channel_equals_meal_by_meal(table, cls):
    T = 260
    insulin = [1.0 + (9.0 if 40 <= m < 43 or 75 <= m < 78 or m in (200, 201) else 0.0) for m in range(T)]
    # the second box lies where the first one lands, the last one runs over the end
    carbs = [5.0 if 40 <= m < 60 or 75 <= m < 95 or 200 <= m < 204 or 240 <= m < 258 else 0.0 for m in range(T)]
    rows = [(1, m, 6.0, insulin[m], carbs[m]) for m in range(T)]
    grid = table(rows, "patient_id int, minute long, glucose double, insulin double, carbs double")
    out = labels.inject_channel(grid, cls, 30, 0.7, 30.0).orderBy("minute").collect()
    want = sequential(insulin, carbs, cls, 30, 0.7, 30.0)
    assert np.allclose([r.insulin for r in out], want[0])
    assert np.allclose([r.carbs for r in out], want[1])
    assert [r.flag for r in out] == want[2]


@pytest.mark.parametrize("delay", [7, 30, 45])
def test_late_meals_move_on_through_long_chains(table, monkeypatch, delay):
    rng = np.random.default_rng(delay)
    T = 3200  # over three blocks of a day; most meals land on the next one
    carbs = [0.0] * T
    at = 20
    while at < T - 60:
        length = int(rng.integers(12, 22))
        carbs[at : at + length] = [float(x) for x in rng.integers(2, 9, length)]
        at += length + int(rng.integers(1, 14))
    insulin = [1.0 + (4.0 if c > 0 and m % 3 else 0.0) * (m % 40 < 5) for m, c in enumerate(carbs)]
    written = []
    plain = labels.materialize
    monkeypatch.setattr(labels, "materialize", lambda df: written.append(1) or plain(df))
    rows = [(p, m, 6.0, insulin[m], carbs[m]) for p in (1, 2) for m in range(T)]
    grid = table(rows, "patient_id int, minute long, glucose double, insulin double, carbs double")
    out = labels.inject_channel(grid, "late", delay, 0.7, 30.0).orderBy(labels.PID, "minute").collect()
    want = sequential(insulin, carbs, "late", delay, 0.7, 30.0)
    for p in (1, 2):
        mine = [r for r in out if r.patient_id == p]
        assert np.allclose([r.insulin for r in mine], want[0]) and np.allclose([r.carbs for r in mine], want[1])
    assert len(written) == 1  # no step a link of the chain


def test_inject_channel_takes_the_medians_once(table, capsys):
    rows = [(1, m, 6.0, 1.0 + (m % 50 == 0), 5.0 if m % 90 < 9 else 0.0) for m in range(300)]
    grid = table(rows, "patient_id int, minute long, glucose double, insulin double, carbs double")
    labels.inject_channel(grid, "late", 30, 0.7, 30.0).explain()
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan and "collect_list" not in plan
