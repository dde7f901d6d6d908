"""Forecasters and the scores of their residuals.

A forecaster is a function from forecast windows to the same rows with an array column
`mean` (and optionally `logvar`) of the horizon's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sugartrace import constants as K
from sugartrace.operators import windows as W

PID = "patient_id"
Forecaster = Callable[[DataFrame], DataFrame]


def zero(cut: DataFrame) -> DataFrame:
    return cut.withColumn("mean", F.transform("target", lambda x: F.lit(0.0)))


def persistence(cut: DataFrame) -> DataFrame:
    last = F.element_at("history", -1)
    return cut.withColumn("mean", F.transform("target", lambda x: last))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def tail(values: Column) -> Column:
    """Last quarter of the horizon, at least one value."""
    n = F.greatest(F.lit(1), F.floor(F.size(values) / 4).cast("int"))
    return F.slice(values, -n, n)


def residuals(target: Column, mean: Column) -> Column:
    return F.zip_with(target, mean, lambda t, m: t - m)


def element_scores(resid: Column, logvar: Column | None = None) -> tuple[Column, Column]:
    """Per element: symmetric score (squared error or Gaussian NLL) and its above-forecast part."""
    if logvar is None:
        return F.transform(resid, lambda r: r * r), F.transform(resid, lambda r: F.greatest(r, F.lit(0.0)))
    nll = F.zip_with(resid, logvar, lambda r, v: 0.5 * (r * r * F.exp(-v) + v))
    above = F.zip_with(resid, logvar, lambda r, v: F.greatest(r * F.exp(-0.5 * v), F.lit(0.0)))
    return nll, above


def window_score(resid: Column, mode: str = "end", logvar: Column | None = None) -> Column:
    symmetric, above = element_scores(resid, logvar)
    if mode == "sym":
        return _mean(symmetric)
    if mode == "signed":
        return _mean(above)
    if mode == "peak":
        return F.array_max(symmetric)
    if mode == "end":
        return _mean(tail(symmetric))
    raise ValueError(f"unknown score mode: {mode}")


def direction(resid: Column) -> Column:
    """Mean observed minus forecast over the horizon's tail."""
    return _mean(tail(resid))


def score_windows(cut: DataFrame, forecaster: Forecaster = zero, mode: str = "end") -> DataFrame:
    """(patient, start, score, direction) of forecast windows, keeping any label columns."""
    forecast = forecaster(cut)
    logvar = F.col("logvar") if "logvar" in forecast.columns else None
    labels = [c for c in cut.columns if c.startswith("f_")]
    forecast = forecast.withColumn("_resid", residuals(F.col("target"), F.col("mean")))
    return forecast.select(
        PID,
        "start",
        window_score(F.col("_resid"), mode, logvar).alias("score"),
        direction(F.col("_resid")).alias("direction"),
        *labels,
    )


def forecast_loss(forecast: DataFrame) -> DataFrame:
    """Mean element score over all windows: MSE, or Gaussian NLL with a log-variance."""
    logvar = F.col("logvar") if "logvar" in forecast.columns else None
    elements, _ = element_scores(residuals(F.col("target"), F.col("mean")), logvar)
    per_window = forecast.select(
        F.aggregate(elements, F.lit(0.0), lambda acc, x: acc + x).alias("s"), F.size("target").alias("n")
    )
    return per_window.agg((F.sum("s") / F.sum("n")).alias("loss"))


# ---- linear forecaster ---------------------------------------------------------------------


def arx_features(
    grid: DataFrame, lag: int, horizon: int, conditional: bool = True, stride: int = 1, packed: bool = False
) -> DataFrame:
    """Anchor t with glucose[t-lag:t], insulin and carbs [t-lag:t+horizon) and target glucose[t+horizon].

    `packed` (stride 1 only) gives one row for a stretch of anchors instead: its first anchor and the channels as arrays, from
    `lag` before that to `horizon` after the last. `arx_fit` and `arx_residual` take either form; neighbouring anchors share
    all inputs but a few, so the packed form holds each value once where rows hold it `lag` + `horizon` times.
    """
    channels = ["glucose", "insulin", "carbs"]
    if packed:
        if stride != 1:
            raise ValueError("packed features have every anchor")
        cut = W.tiles(grid, channels, after=lag + horizon).filter(F.size("rows") > lag + horizon)
        kept = channels if conditional else channels[:1]
        sizes = [F.lit(lag).alias("lag"), F.lit(horizon).alias("horizon")]
        return cut.select(PID, (F.col("first") + lag).alias("anchor"), *sizes, *[F.col(f"rows.{c}").alias(c) for c in kept])
    cut = W.windows(grid, channels, lag + horizon + 1, stride)
    inputs = [F.slice("glucose", 1, lag)]
    if conditional:
        inputs += [F.slice("insulin", 1, lag + horizon), F.slice("carbs", 1, lag + horizon)]
    return cut.select(
        PID,
        (F.col("start") + lag).alias("anchor"),
        F.concat(*inputs).alias("x"),
        F.array(F.element_at("glucose", lag + horizon + 1)).alias("y"),
    )


def _is_packed(features: DataFrame) -> bool:
    return "x" not in features.columns


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    """Row, lag, horizon and channels of the packed stretches of a batch; a null value is NaN."""
    names = [c for c in ("glucose", "insulin", "carbs") if c in batch.schema.names]
    columns = [batch.column(c) for c in names]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    ends = np.cumsum([len(x) for x in columns[0]])
    lags, horizons = batch.column("lag").to_pylist(), batch.column("horizon").to_pylist()
    for i, (low, high) in enumerate(zip([0, *ends[:-1]], ends)):
        yield i, lags[i], horizons[i], [c[low:high] for c in flat]


def _packed_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for _, lag, horizon, (glucose, *others) in _stretches(batch):
            n = len(glucose) - lag - horizon
            inputs = [np.lib.stride_tricks.sliding_window_view(glucose, lag)[:n]]
            inputs += [np.lib.stride_tricks.sliding_window_view(c, lag + horizon)[:n] for c in others]
            z = np.hstack([np.ones((n, 1)), *inputs, glucose[lag + horizon :, None]])
            part = z[:, :-1].T @ z
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "moments"]
        )


def horizon_features(cut: DataFrame, lag: int, conditional: bool = True) -> DataFrame:
    """Forecast windows with inputs `x` near the anchor; the outputs are the whole target."""
    inputs = [F.slice("history", -lag, lag)]
    if conditional:
        reach = lag + K.HORIZON
        inputs += [F.slice("insulin", -reach, reach), F.slice("carbs", -reach, reach)]
    return cut.withColumn("x", F.concat(*inputs)).withColumn("y", F.col("target"))


def _moment_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        if len(batch):
            x, y = np.stack(batch["x"].to_numpy()), np.stack(batch["y"].to_numpy())
            z = np.hstack([np.ones((len(x), 1)), x, y]).astype(np.float64)
            part = z[:, : 1 + x.shape[1]].T @ z
            total = part if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"i": np.arange(len(total)), "moments": list(total)})


def moments(rows: DataFrame) -> np.ndarray:
    """[1 x]' [1 x y] summed over all rows: partial products per partition, summed by Spark.

    What reaches the driver is one matrix of the feature width, whatever the row count.
    """
    schema = "i int, moments array<double>"
    if _is_packed(rows):
        parts = rows.mapInArrow(_packed_sums, schema)
    else:
        parts = rows.select("x", "y").mapInPandas(_moment_sums, schema)
    summed = (
        parts.select("i", F.posexplode("moments").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    )
    cells = summed.toPandas()
    out = np.zeros((cells["i"].max() + 1, cells["j"].max() + 1))
    out[cells["i"], cells["j"]] = cells["v"]
    return out


def ridge_from_moments(m: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients [p, outputs], intercepts) of ridge regression with a free intercept."""
    p = len(m) - 1
    n, sx, sy = m[0, 0], m[0, 1 : p + 1], m[0, p + 1 :]
    xx = m[1:, 1 : p + 1] - np.outer(sx, sx) / n
    xy = m[1:, p + 1 :] - np.outer(sx, sy) / n
    beta = np.linalg.solve(xx + alpha * np.eye(p), xy)
    return beta, sy / n - sx / n @ beta


def arx_fit(features: DataFrame, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    return ridge_from_moments(moments(features), alpha)


def weights_frame(spark: SparkSession, beta: np.ndarray, intercept: np.ndarray) -> DataFrame:
    full = np.vstack([intercept[None, :], beta])
    rows = [(i, j, float(full[i, j])) for i in range(full.shape[0]) for j in range(full.shape[1])]
    return spark.createDataFrame(rows, "feature int, output int, weight double")


def linear(features: DataFrame, beta: np.ndarray, intercept: np.ndarray) -> DataFrame:
    """Predictions `mean` of rows with inputs `x`, one matrix product per Arrow batch."""
    schema = T.StructType([*features.schema.fields, T.StructField("mean", T.ArrayType(T.DoubleType()))])

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                yield batch.assign(mean=list(x @ beta + intercept))

    return features.mapInPandas(predict, schema)


def arx(beta: np.ndarray, intercept: np.ndarray, lag: int, conditional: bool = True) -> Forecaster:
    return lambda cut: linear(horizon_features(cut, lag, conditional), beta, intercept)


def arx_residual(features: DataFrame, beta: np.ndarray, intercept: np.ndarray) -> DataFrame:
    """Squared forecast residual at each anchor minute."""
    if _is_packed(features):
        schema = features.select(PID, F.col("anchor").alias("minute"), F.lit(0.0).alias("residual")).schema
        return features.mapInArrow(_packed_residuals(beta[:, 0], float(intercept[0])), schema)
    fitted = linear(features, beta, intercept)
    error = F.col("y")[0] - F.col("mean")[0]
    return fitted.select(PID, F.col("anchor").alias("minute"), (error * error).alias("residual"))


def _packed_residuals(beta: np.ndarray, intercept: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def residuals_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, minutes, errors = [], [], []
            anchors = batch.column("anchor").to_numpy()
            for i, lag, horizon, (glucose, *others) in _stretches(batch):
                n = len(glucose) - lag - horizon
                mean, used = np.convolve(glucose[: n + lag - 1], beta[lag - 1 :: -1], "valid") + intercept, lag
                for channel in others:
                    weights = beta[used : used + lag + horizon]
                    mean += np.convolve(channel[: n + lag + horizon - 1], weights[::-1], "valid")
                    used += lag + horizon
                owners.append(np.full(n, i))
                minutes.append(anchors[i] + np.arange(n))
                errors.append((glucose[lag + horizon :] - mean) ** 2)
            if owners:
                columns = [batch.column(PID).take(pa.array(np.concatenate(owners))), pa.array(np.concatenate(minutes)), pa.array(np.concatenate(errors))]
                yield pa.RecordBatch.from_arrays(columns, [PID, "minute", "residual"])

    return residuals_of


def residual_series(grid: DataFrame, anchored: DataFrame) -> DataFrame:
    """The residual on every minute of the grid, zero where there is no anchor."""
    return grid.join(anchored, [PID, "minute"], "left").withColumn("residual", F.coalesce("residual", F.lit(0.0)))
