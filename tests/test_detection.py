import numpy as np
import pytest
from pyspark.sql import functions as F

from sugartrace.operators import calibrate, detect, embedding, events, forecast, metrics, ranking
from sugartrace.operators import windows as W

SCORED = "patient_id int, start long, score double"


def baseline(scores, k=2.0, passes=3):
    s = np.asarray(scores)
    spread = lambda x: max((np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.349, 1e-6)
    kept, mu, sd = s, np.median(s), spread(s)
    for _ in range(passes):
        new = s[s <= mu + k * sd]
        if len(new) < max(len(s) // 2, 1) or len(new) == len(kept):
            break
        kept, mu, sd = new, np.median(new), spread(new)
    return mu, sd, mu + k * sd


def test_robust_baseline_ignores_where_anomalies_lie(table):
    rng = np.random.default_rng(0)
    normal = rng.standard_normal(1000)
    series = {
        1: np.r_[normal[:30] + 25, normal[30:]],
        2: np.r_[normal[:970], normal[970:] + 25],
        3: rng.exponential(1.0, 400) ** 3,
        4: np.r_[np.zeros(5), rng.random(4) * 9],
        5: np.array([4.2]),
        6: np.ones(40),
    }
    rows = [(p, 5 * i, float(x)) for p, s in series.items() for i, x in enumerate(s)]
    got = {r.patient_id: (r.median, r.sigma, r.threshold) for r in calibrate.robust_baseline(table(rows, SCORED)).collect()}
    for p, s in series.items():
        assert np.allclose(got[p], baseline(s)), p


def test_leading_threshold_uses_first_windows_or_all(table):
    rows = [(1, 5 * i, float(i % 7)) for i in range(50)] + [(2, 0, 1.0), (2, 5, 3.0)]
    out = {r.patient_id: r for r in calibrate.threshold_leading(table(rows, SCORED), 10).collect()}
    first = [float(i % 7) for i in range(10)]
    iqr = np.quantile(first, 0.75) - np.quantile(first, 0.25)
    assert out[1].n == 10 and out[1].threshold == pytest.approx(np.median(first) + 2 * iqr / 1.349)
    assert out[2].n == 2 and out[2]["median"] == 2.0


def ramp_grid(table):
    T = 160 + 5 * 5
    rows = [(1, m, 0.05 * (m - 120) if m > 120 else 0.0, 0.0, 0.0, m != 184) for m in range(T)]
    return table(rows, "patient_id int, minute long, glucose double, insulin double, carbs double, valid boolean")


def test_zero_forecaster_on_a_ramp(table):
    cut = W.forecast_windows(ramp_grid(table))
    assert sorted(r.start for r in cut.collect()) == [0, 5, 10, 15, 20]  # the last window holds an invalid minute
    out = forecast.score_windows(cut, forecast.zero, "end").orderBy("start").collect()
    tail = np.array([0.05 * (m - 120) for m in range(150, 160)])
    assert out[0].score == pytest.approx((tail**2).mean()) and out[0].direction == pytest.approx(tail.mean())
    assert all(a.score < b.score for a, b in zip(out, out[1:]))


def test_score_modes_and_loss(table):
    cut = table([(1, 0, [0.0], [0.0] * 6 + [3.0, -4.0], [0.0] * 8, [0.5] * 8)],
                "patient_id int, start long, history array<double>, target array<double>, mean array<double>, logvar array<double>")
    r = forecast.residuals(F.col("target"), F.col("mean"))
    got = cut.select(*[forecast.window_score(r, m).alias(m) for m in ("sym", "signed", "peak", "end")]).collect()[0]
    assert tuple(got) == pytest.approx((25 / 8, 3 / 8, 16.0, 12.5))
    nll = 0.5 * (25 * np.exp(-0.5) / 8 + 0.5)
    assert forecast.forecast_loss(cut).collect()[0].loss == pytest.approx(nll)
    assert forecast.forecast_loss(cut.drop("logvar")).collect()[0].loss == pytest.approx(25 / 8)
    with pytest.raises(ValueError):
        forecast.window_score(r, "other")


def test_ridge_equals_the_closed_form(table):
    rng = np.random.default_rng(2)
    x, noise = rng.standard_normal((200, 4)), rng.standard_normal((200, 2))
    y = x @ rng.standard_normal((4, 2)) + 3 + 0.1 * noise
    df = table([([float(v) for v in a], [float(v) for v in b]) for a, b in zip(x, y)], "x array<double>, y array<double>")
    beta, intercept = forecast.arx_fit(df, alpha=1.0)
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
    assert np.allclose(beta, want) and np.allclose(intercept, y.mean(0) - x.mean(0) @ want)
    fitted = forecast.linear(df, beta, intercept).select("mean").collect()
    assert len(fitted) == 200


@pytest.mark.parametrize("block", [20, 1440])
def test_sessions_merge_at_thirty_minutes(table, block):
    rows = [(1, s) for s in (0, 30, 60, 91, 300)]
    numbered = events.event_sessions(table(rows, "patient_id int, start long"), block=block)
    out = events.session_bounds(numbered).orderBy("start_min").collect()
    assert [(r.start_min, r.end_min) for r in out] == [(120, 220), (211, 251), (420, 460)]


def test_events_surface_and_strength(table):
    rows = [(1, 5 * i, 1.0 + 0.01 * (i % 5), 0.1) for i in range(60)]
    rows += [(1, 400, 9.0, 0.5), (1, 405, 9.0, -0.7), (1, 600, 5.0, -0.5), (1, 900, 7.0, 0.2)]
    scored = table(rows, "patient_id int, start long, score double, direction double")
    boluses = table([(1, 1040, 2.0)], "patient_id int, minute long, units double")
    found = detect.detect_events(scored, boluses).orderBy("start_min").collect()
    got = [(r.start_min, r.duration_min, r.score, r.direction, r.rule_label) for r in found]
    assert got == [(520, 45, 9.0, 0.5, "missed"), (720, 40, 5.0, -0.5, None), (1020, 40, 7.0, 0.2, "late")]
    origins = table([(1, "2024-01-01 00:00:00", 2.0)], "patient_id int, t0 string, glucose_scale double")
    out = detect.surface(detect.detect_events(scored, boluses), origins.withColumn("t0", F.col("t0").cast("timestamp"))).collect()
    assert [(r.anomaly_type, r.residual_mmoll, r.above_forecast) for r in out] == [("missed_bolus", 1.0, True), ("late_bolus", 0.4, True)]
    assert out[0].anomaly_strength == 100.0 and out[1].anomaly_strength < 100.0
    assert out[0].description == "glucose ran 1.0 mmol/L above forecast for 45 min; no bolus logged around the rise"
    assert str(out[0].start) == "2024-01-01 08:40:00"


def test_top_events(table):
    df = table([(1, 5, 2.0), (1, 9, 8.0), (2, 1, 1.0)], "patient_id int, start_min long, severity double")
    assert ranking.top_events(df, 0).count() == 3
    assert sorted(r.severity for r in ranking.top_events(df, 1).collect()) == [1.0, 8.0]


def test_ranking_metrics(table):
    rows = [(float(i), 1.0 if i >= 6 else 0.0, 0.0, float(i % 2)) for i in range(10)]
    rows += [(3.0, 1.0, 0.0, 1.0), (3.0, 0.0, 0.0, 0.0)]  # ties
    df = table(rows, "score double, a double, none double, b double")
    out = {r.label: r for r in metrics.ranking_metrics(df, ["a", "none", "b"]).collect()}
    assert out["none"].auroc is None and out["none"].auprc is None

    def auc(y, s):
        pos, neg = [x for x, f in zip(s, y) if f], [x for x, f in zip(s, y) if not f]
        return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))

    def ap(y, s):
        total, area, seen = sum(y), 0.0, 0.0
        for cut in sorted(set(s), reverse=True):
            hit = sum(f for x, f in zip(s, y) if x >= cut)
            area += (hit - seen) / total * hit / sum(x >= cut for x in s)
            seen = hit
        return area

    scores = [r[0] for r in rows]
    for i, name in ((1, "a"), (3, "b")):
        truth = [r[i] for r in rows]
        assert out[name].auroc == pytest.approx(auc(truth, scores)) and out[name].auprc == pytest.approx(ap(truth, scores))
    perfect = {r.label: r for r in metrics.ranking_metrics(df.filter("a = 0 OR score >= 6"), ["a"]).collect()}["a"]
    assert (perfect.auroc, perfect.auprc) == (1.0, 1.0)


def test_severity_rank_of_a_popular_severity(table):
    rows = [(i, 5.0 if i % 3 else None if i % 2 else float(i)) for i in range(60)]
    got = {r.id: r["rank"] for r in ranking.severity_rank(table(rows, "id long, severity double"), id_width=7).collect()}
    order = sorted(rows, key=lambda r: (-(r[1] or 0.0), r[0]))
    assert got == {r[0]: i for i, r in enumerate(order, 1)}


def test_ood_and_mixture(table):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((300, 3)) @ np.diag([1.0, 2.0, 0.5])
    df = table([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id int, embedding array<double>")
    mean, inverse = embedding.ood_fit(df)
    assert np.allclose(mean, points.mean(0))
    assert np.allclose(inverse, np.linalg.inv(np.cov(points, rowvar=False) + 1e-3 * np.eye(3)))
    distance = embedding.ood_distance(mean, inverse)
    plain = embedding.distance_expression(mean, inverse)
    both = df.select(distance("embedding").alias("a"), plain(F.col("embedding")).alias("b")).collect()
    assert np.allclose([r.a for r in both], [r.b for r in both])
    radius = embedding.ood_radius(df, distance)
    assert radius == pytest.approx(np.quantile([r.a for r in both], 0.99))
    fitted = embedding.mixture_fit(df, ks=(2,), max_iter=5)
    scored = embedding.mixture_score(df.unionByName(table([(-1, [40.0, 40.0, 40.0])], df.schema)), *fitted)
    assert scored.orderBy(F.desc("score")).first().id == -1


def test_mean_embedding_diary(table):
    scored = table([(1, s, 9.0 if s in (500, 505) else 1.0 + s % 7 / 10, 0.0) for s in range(0, 1000, 5)],
                   "patient_id int, start long, score double, direction double")
    vectors = table([(1, s, [float(s)], [0.2, 0.8] if s == 500 else [0.4, 0.6]) for s in range(0, 1000, 5)],
                    "patient_id int, start long, embedding array<double>, probs array<double>")
    labels = table([(1, 600, "late"), (1, 610, "large")], "patient_id int, minute long, class string")
    out = detect.diary(scored, calibrate.threshold_leading(scored, 100), vectors, labels,
                       lambda z: F.get(z, F.lit(0)), 1000.0, ["normal", "missed"]).collect()
    assert [tuple(r) for r in out] == [(1, 620, 665, 9.0, "missed", 502.5, False, True, "late")]


def test_gmm_score_tries_all_sizes_of_the_operator(table):
    from types import SimpleNamespace

    from sugartrace.plans import detection  # noqa: F401
    from sugartrace.plans.registry import QUERIES

    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(60, 2)) + centre for centre in ([0, 0], [30, 0], [0, 30], [30, 30], [70, 80])])
    df = table([(i, 0, p.tolist()) for i, p in enumerate(points)], "vec_id int, label int, embedding array<double>")
    got = {r.vec_id: r.score for r in QUERIES["gmm_score"](SimpleNamespace(read=lambda name: df)).collect()}
    expected = {r.vec_id: r.score for r in embedding.mixture_score(df, *embedding.mixture_fit(df)).collect()}
    few = {r.vec_id: r.score for r in embedding.mixture_score(df, *embedding.mixture_fit(df, ks=(2, 3), max_iter=10)).collect()}
    assert np.allclose([got[i] for i in range(300)], [expected[i] for i in range(300)], atol=1e-9)
    assert np.mean(list(got.values())) < np.mean(list(few.values())) - 0.1


def test_mixture_does_not_depend_on_where_rows_lie(spark):
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(size=(80, 3)) + centre for centre in ([0, 0, 0], [9, 0, 4], [0, 8, 0])])
    rows = [(i, p.tolist()) for i, p in enumerate(np.concatenate([points, np.repeat(points[:1], 150, 0)]))]
    scores = []
    for order, parts in ((1, 2), (-1, 7), (1, 1)):
        df = spark.createDataFrame(rows[::order], "vec_id int, embedding array<double>").repartition(parts)
        fitted = embedding.mixture_fit(df, ks=(2, 3, 4))
        scores.append([r.score for r in embedding.mixture_score(df, *fitted).orderBy("vec_id").collect()])
    assert np.allclose(scores[0], scores[1], atol=1e-9) and np.allclose(scores[0], scores[2], atol=1e-9)


def test_mixture_of_components_with_fewer_rows_than_dimensions(table):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(300, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    df = table([(i, p.tolist()) for i, p in enumerate(points)], "vec_id int, embedding array<double>")
    fitted = embedding.mixture_fit(df, ks=(3, 8), max_iter=60)  # some components keep fewer rows than there are dimensions
    scores = np.array([r.score for r in embedding.mixture_score(df, *fitted).collect()])
    assert np.isfinite(scores).all() and len(scores) == 300
    assert all(np.linalg.eigvalsh(c).min() > 0.9e-4 for c in fitted[1].covariances)


def test_em_raises_the_likelihood_and_splits_rows_over_tasks(table):
    rng = np.random.default_rng(11)
    points = np.concatenate([rng.normal(size=(200, 2)) * [1, 2] + c for c in ([0, 0], [9, 3])])
    df = table([(x.tobytes(), np.ones(len(x)).tobytes()) for x in np.array_split(points, 12)], "x binary, weight binary")
    start = embedding.Mixture(np.array([0.5, 0.5]), points[[0, -1]], np.stack([np.eye(2)] * 2))
    steps = [embedding.expectation_maximization(df, {2: start}, most, 0.01, 1e-4, grouped)[2] for most, grouped in ((1, False), (2, False), (90, False), (90, True))]
    assert steps[0][0] < steps[1][0] < steps[2][0] == pytest.approx(steps[3][0])
    model = steps[3][1]
    assert np.allclose(model.weights, 0.5, atol=0.02) and np.allclose(model.means, [points[:200].mean(0), points[200:].mean(0)], atol=0.1)
    assert np.allclose(model.covariances, [np.cov(x.T, bias=True) for x in (points[:200], points[200:])], atol=0.2)


@pytest.mark.parametrize("conditional", [True, False])
def test_packed_features_give_the_fit_and_residuals_of_rows(table, conditional):
    rng = np.random.default_rng(5)
    lengths = {1: 1500, 2: 14, 3: 13, 4: 733}  # 13 minutes hold no anchor
    rows = [(p, m, *rng.normal(size=3).tolist()) for p, size in lengths.items() for m in range(size)]
    grid = table(rows, "patient_id int, minute long, glucose double, insulin double, carbs double")
    single, packed = (forecast.arx_features(grid, 6, 7, conditional, packed=x) for x in (False, True))
    assert single.count() == sum(max(0, n - 13) for n in lengths.values()) and packed.count() == 5
    fitted, again = forecast.arx_fit(single), forecast.arx_fit(packed)
    assert np.allclose(fitted[0], again[0], atol=1e-12) and np.allclose(fitted[1], again[1], atol=1e-12)
    want, got = ({(r.patient_id, r.minute): r.residual for r in forecast.arx_residual(f, *fitted).collect()} for f in (single, packed))
    assert want.keys() == got.keys() and all(want[k] == pytest.approx(got[k], abs=1e-10) for k in want)
    with pytest.raises(ValueError):
        forecast.arx_features(grid, 6, 7, conditional, stride=5, packed=True)


def test_arx_residual_keeps_inputs_once(table, monkeypatch):
    from types import SimpleNamespace

    from sugartrace.plans import detection
    from sugartrace.plans.registry import QUERIES

    kept = []
    monkeypatch.setattr(detection, "materialize", lambda df: kept.append(df) or df)
    rows = [(1, m, float(m % 17), float(m % 5), float(m % 29 == 0), True) for m in range(900)]
    grid = table(rows, "patient_id int, minute long, glucose double, insulin double, carbs double, valid boolean")
    out = QUERIES["arx_residual"](SimpleNamespace(grid=grid)).orderBy("minute").collect()
    assert [r.minute for r in out] == list(range(900)) and {r.minute for r in out if r.residual > 0} <= set(range(30, 860))
    assert any("glucose" in df.columns and df.count() == 2 for df in kept)  # two stretches, no row for each anchor
