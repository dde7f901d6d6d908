"""Blocked primitives against plain Python, with blocks far smaller than the data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sugartrace.operators import joins, ordered


def sample(seed, keys=3, rows=120, hot=0.6):
    rng = random.Random(seed)
    out = set()
    while len(out) < rows:
        out.add((0 if rng.random() < hot else rng.randrange(1, keys), rng.randrange(0, 400)))
    return [(k, t, rng.choice([None, 1.0, 2.0, 5.0]), rng.random() < 0.6) for k, t in sorted(out)]


SCHEMA = "k long, t long, v double, on boolean"


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("width", [7, 50, 10_000])
def test_prefix_sum_and_row_number(table, width):
    rows = sample(1)
    df = ordered.with_block(table(rows, SCHEMA), "t", width)
    df = ordered.prefix_sum(df, ["k"], ["t"], {"s": F.col("v"), "rn": F.lit(1)})
    got = {(r.k, r.t): (r.s, r.rn) for r in df.collect()}
    for key, group in by_key(rows).items():
        total = 0.0
        for i, (_, t, v, _) in enumerate(group, 1):
            total += v or 0.0
            assert got[key, t] == (total, i)


@pytest.mark.parametrize("width", [7, 50, 10_000])
def test_sweep(table, width):
    rows = sample(2)
    df = ordered.with_block(table(rows, SCHEMA), "t", width)
    df = ordered.sweep(
        df, ["k"], ["t"],
        forward={"f": F.col("v"), "p": F.col("t")}, backward={"b": F.col("v"), "n": F.col("v")}, strict=["p", "n"],
    )
    got = {(r.k, r.t): (r.f, r.p, r.b, r.n) for r in df.collect()}
    known = lambda xs: next((x for x in xs if x is not None), None)
    for key, group in by_key(rows).items():
        values = [g[2] for g in group]
        for i, (_, t, _, _) in enumerate(group):
            assert got[key, t] == (
                known(reversed(values[: i + 1])), group[i - 1][1] if i else None, known(values[i:]), known(values[i + 1 :])
            )


@pytest.mark.parametrize("width", [7, 10_000])
def test_islands(table, width):
    rows = sample(3)
    df = ordered.islands(ordered.with_block(table(rows, SCHEMA), "t", width), ["k"], "t", F.col("on"))
    got = sorted((r.k, r.lo, r.hi, r.n) for r in df.groupBy("k", "run").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).collect())
    want = []
    for key, group in by_key(rows).items():
        run = []
        for row in [*group, (key, None, None, False)]:
            if row[3]:
                run.append(row[1])
            elif run:
                want.append((key, run[0], run[-1], len(run)))
                run = []
    assert got == sorted(want)


@pytest.mark.parametrize("blocks", [2, 64])
def test_grouped_quantiles(table, blocks):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(1, 4), rng.choice([1.0, 1.0, rng.gauss(0, 3)])) for _ in range(300)]
    df = ordered.grouped_quantiles(table(rows, "k int, v double"), ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.995}, blocks)
    for row in df.collect():
        values = [v for k, v in rows if k == row.k]
        assert row.n == len(values)
        assert np.allclose([row.a, row.b, row.c], np.quantile(values, [0.1, 0.5, 0.995]))


def test_global_quantile_of_one_value(table):
    df = ordered.grouped_quantiles(table([(3.5,)], "v double"), [], "v", {"m": 0.5})
    assert [tuple(r) for r in df.collect()] == [(1, 3.5)]


@pytest.mark.parametrize("block", [5, 40, 5000])
def test_nearest_join(table, block):
    rng = random.Random(5)
    left = [(rng.randrange(2), rng.randrange(200), i) for i in range(60)]
    right = [(rng.randrange(2), rng.randrange(200), i, float(i)) for i in range(40)]
    df = joins.nearest_join(
        table(left, "k int, m long, s long"), table(right, "k int, m long, s long, g double"), "k", "m", "s", ["g"], 6, block
    )
    got = {r.s: r.g for r in df.collect()}
    for k, m, s in left:
        near = sorted((abs(r[1] - m), r[1], r[2], r[3]) for r in right if r[0] == k and abs(r[1] - m) <= 6)
        assert got[s] == (near[0][3] if near else None)


@pytest.mark.parametrize("width", [3, 25])
def test_interval_join_meets_each_pair_once(table, width):
    rng = random.Random(6)
    probes = [(rng.randrange(2), rng.randrange(100), i) for i in range(30)]
    points = [(k, t) for k in range(2) for t in rng.sample(range(100), 30)]
    df = joins.interval_join(
        table(probes, "k int, t long, i int"), table(points, "k int, p long"), ["k"], F.col("t") - 4, F.col("t") + 9, "p", width, "inner"
    )
    got = sorted((r.i, r.p) for r in df.collect())
    assert got == sorted((i, p) for k, t, i in probes for q, p in points if q == k and t - 4 <= p <= t + 9)


def test_lookup_join_keeps_unmatched_on_left_join(table):
    facts = table([(1, 10), (1, 11), (2, 12)], "k int, i int")
    out = joins.lookup_join(facts, table([(1, "a")], "k int, x string"), ["k"], "left")
    assert sorted((r.k, r.i, r.x or "") for r in out.collect()) == [(1, 10, "a"), (1, 11, "a"), (2, 12, "")]


def test_disjoint_union_reports_shared_ids(table):
    _, shared = joins.disjoint_union({"a": table([("x",), ("y",)], "pid string"), "b": table([("y",)], "pid string")}, "pid")
    assert [r.pid for r in shared.collect()] == ["y"]


def test_no_single_task_window_on_a_patient(table):
    """The plan windows by patient only over one row per block, never over the facts."""
    df = ordered.with_block(table(sample(7), SCHEMA), "t", 10)
    out = ordered.prefix_sum(df, ["k"], ["t"], {"s": F.col("v")})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert sum("_block" in line.split("], [")[1] for line in windows) == 1 and len(windows) == 2
