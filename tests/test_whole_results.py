"""Results do not depend on tuning, and odd or empty input gives a defined result."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.operators import artifacts, calibrate, detect, metrics, ordered, ranking, series
from sugartrace.session import materialize, staging
from sugartrace.sources import sinks, thresholds

GRID = "patient_id int, minute long, glucose double, insulin double, carbs double"
SCORED = "patient_id int, start long, score double"


def test_on_board_does_not_depend_on_the_block(table):
    rows = [(1, m, 0.0, 1.0 if m == 0 else 0.0, 30.0 if m in (0, 40) else 0.0) for m in range(300)]
    whole = series.iob_cob(table(rows, GRID), 1440).orderBy("minute").collect()
    for block in (2, 7, 100):
        out = series.iob_cob(table(rows, GRID), block).orderBy("minute").collect()
        assert np.allclose([r.iob for r in out], [r.iob for r in whole], atol=1e-9)
        assert np.allclose([r.cob for r in out], [r.cob for r in whole], atol=1e-9)
    assert whole[90].iob > 0


@pytest.mark.parametrize("rate", [0.2, 3.0, 20.0])
def test_counts_follow_their_rate(spark, rate):
    draws = spark.range(20_000).select(artifacts.uniform(1, "n", F.col("id")).alias("u"))
    counts = draws.select(artifacts._poisson(F.col("u"), F.lit(rate), rate).alias("n"))
    mean, variance, most = counts.agg(F.mean("n"), F.variance("n"), F.max("n")).first()
    assert abs(mean - rate) < 5 * math.sqrt(rate / 20_000) and abs(variance / rate - 1) < 0.1
    assert most > rate


def test_value_blocks(table):
    for values in ([], [None, None], [float("inf")] * 3, [1.0] * 5, [1.0, float("inf"), float("-inf"), float("nan"), None, 2.0]):
        df = table([(i, v) for i, v in enumerate(values)], "id int, value double")
        placed = ordered.with_value_block(df, "value").filter(F.col(ordered.BLOCK).isNotNull()).count()
        assert placed == len([v for v in values if v is not None])


def test_nothing_scored(table):
    empty = table([], SCORED)
    assert calibrate.robust_baseline(empty).collect() == []
    assert calibrate.threshold_leading(empty, 20).collect() == []
    assert ranking.severity_rank(table([], "id long, severity double")).collect() == []
    flagged = table([], "patient_id int, start long, score double, label double")
    assert metrics.pr_curve(flagged, ["label"]).collect() == []


def test_short_series_have_no_events(table):
    rows = [(1, m, 7.0, 0.0, 0.0, True) for m in range(100)]
    grid = table(rows, GRID + ", valid boolean")
    scored = detect.score_series(grid)
    assert scored.count() == 0


def test_order_statistics_do_not_depend_on_blocks(table, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(1 + i % 3, i, float(x)) for i, x in enumerate(rng.normal(size=900))]
    whole = sorted(map(tuple, calibrate.robust_baseline(table(rows, SCORED)).collect()))
    single = ordered.with_value_block
    monkeypatch.setattr(ordered, "with_value_block", lambda df, value, blocks=None: single(df, value, 1))
    assert sorted(map(tuple, calibrate.robust_baseline(table(rows, SCORED)).collect())) == whole


def test_thresholds_without_configuration(spark):
    schema = "very_low double, low double, high double, very_high double"
    asked = spark.createDataFrame([(1, None, 4.0, None, None)], "patient_id int, " + schema)
    row = thresholds.resolve(asked, spark.createDataFrame([], schema)).collect()
    assert [(r.very_low, r.low, r.high, r.very_high) for r in row] == [(K.VERY_LOW, 4.0, K.HIGH, K.VERY_HIGH)]


def test_staged_tables_go_with_their_block(spark):
    with staging(spark):
        staged = materialize(spark.range(3).toDF("x"))
        folder = staged.inputFiles()[0]
        assert staged.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(folder.rsplit("/", 1)[0]).count()


def test_swap_recovers_what_a_crash_left(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path + "._old")
    sinks.write_swapped(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t._old").exists()
