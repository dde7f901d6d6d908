"""Distance of embeddings from the normal cluster: Mahalanobis and mixture likelihood."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugartrace.operators import forecast, ordered
from sugartrace.session import materialize


def ood_fit(normal: DataFrame, column: str = "embedding", reg: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, inverse covariance): the moments are summed by Spark, only their matrix is inverted here."""
    rows = normal.select(F.col(column).cast("array<double>").alias("x"), F.array(F.lit(0.0)).alias("y"))
    m = forecast.moments(rows)
    n, sums = m[0, 0], m[0, 1:-1]
    cov = (m[1:, 1:-1] - np.outer(sums, sums) / n) / (n - 1)
    return sums / n, np.linalg.inv(cov + reg * np.eye(len(sums)))


def ood_distance(mean: np.ndarray, inverse: np.ndarray):
    """Function from an embedding column to its Mahalanobis distance."""

    @F.pandas_udf("double")
    def distance(z: pd.Series) -> pd.Series:
        d = np.stack(z.to_numpy()).astype(np.float64) - mean if len(z) else np.empty((0, len(mean)))
        return pd.Series(np.sqrt(np.einsum("ij,jk,ik->i", d, inverse, d)))

    return distance


def ood_radius(normal: DataFrame, distance, column: str = "embedding", p: float = 0.99) -> float:
    """The distance below which a share `p` of the normal rows lies (one number to the driver)."""
    distances = normal.select(distance(F.col(column)).alias("d"))
    return ordered.grouped_quantiles(distances, [], "d", {"radius": p}).collect()[0]["radius"]


def distance_expression(mean: Sequence[float], inverse) -> Callable[[Column], Column]:
    """The same distance without Python, for small dimensions: sqrt(sum_i d_i (sum_j C_ij d_j))."""
    centre = F.array(*[F.lit(float(x)) for x in mean])
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in inverse])

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    def distance(z: Column) -> Column:
        d = F.zip_with(z, centre, lambda x, c: x - c)
        return F.sqrt(dot(d, F.transform(rows, lambda row: dot(row, d))))

    return distance


PART_ROWS = 200_000
PIECE_ROWS = 1_000
TASKS = 8  # sums of at most so many tasks go to the driver one by one
TINY = 1e-20  # shares of a row below this change no sum


class Mixture(NamedTuple):
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray


def mixture_fit(
    normal: DataFrame, column: str = "embedding", ks: Sequence[int] = (2, 3, 5, 8, 10, 15, 20, 30, 40),
    variance: float = 0.95, max_iter: int = 200, seed: int = 42, max_rows: int = 0, reg: float = 1e-4, tol: float = 0.01,
):
    """PCA to the wanted variance, then the mixture size with the lowest BIC. EM runs on all rows;
    `max_rows` > 0 fits on about that many, chosen by a hash of the vector.

    EM's seeded start takes rows by their place. Equal vectors become one weighted row, and rows are dealt by
    hash and sorted, so their places, the start and the order of summation inside a task depend on the vectors alone,
    not on the files they came from. All sizes take their steps of EM together, each until its log-likelihood
    changes by `tol` at most.
    """
    rows = normal.filter(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("x"))
    if max_rows:
        total = rows.count()
        if total > max_rows:
            rows = rows.filter(F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    weighted = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    places, n, width = weighted.agg(F.count(F.lit(1)), F.sum("weight"), F.max(F.size("x"))).first()
    vectors = rows.select(array_to_vector("x").alias("features"))
    full = PCA(k=width, inputCol="features", outputCol="reduced").fit(vectors)
    dims = int(np.searchsorted(np.cumsum(full.explainedVariance.toArray()), variance) + 1)
    pca = PCA(k=min(dims, width), inputCol="features", outputCol="reduced").fit(vectors)

    def dealt(parts: int) -> DataFrame:
        placed = weighted.repartition(parts, F.xxhash64("x")).sortWithinPartitions("x")
        return pca.transform(placed.withColumn("features", array_to_vector("x"))).select("reduced", "weight")

    large = max(1, -(-places // PART_ROWS))
    reduced = dealt(large).persist()
    starts = {k: _start(reduced, k, seed, reg) for k in ks}
    reduced.unpersist()
    count = min(max(1, -(-places // PIECE_ROWS)), max(64, large))
    pieces = materialize(dealt(count).select(vector_to_array("reduced").alias("x"), "weight").mapInArrow(_packed, "x binary, weight binary"))
    fitted = expectation_maximization(pieces, starts, max_iter, tol, reg, count > TASKS)
    best = None
    for k in ks:
        likelihood, model = fitted[k]
        free = k * dims + k * dims * (dims + 1) / 2 + k - 1
        bic = free * np.log(n) - 2 * likelihood
        if best is None or bic < best[0]:
            best = (bic, model)
    return pca, best[1]


def _start(reduced: DataFrame, k: int, seed: int, reg: float) -> Mixture:
    """Spark's seeded start: the means and variances of five rows for each component."""
    model = GaussianMixture(k=k, featuresCol="reduced", weightCol="weight", maxIter=0, seed=seed).fit(reduced)
    gaussians = model.gaussiansDF.collect()  # k rows
    means, covariances = (np.stack([r[c].toArray() for r in gaussians]) for c in ("mean", "cov"))
    return Mixture(np.array(model.weights), means, floored(covariances, reg))


def floored(covariances: np.ndarray, reg: float) -> np.ndarray:
    """Covariances with at least the variance `reg` in every direction. These are the likeliest of all that have it, so a
    component of too few or equal rows has an inverse, and no likelihood grows without bound."""
    values, axes = np.linalg.eigh(covariances)
    lifted = (axes * np.maximum(values, reg)[:, None, :]) @ axes.transpose(0, 2, 1)
    return np.where((values[:, :1] < reg)[:, :, None], lifted, covariances)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(0).flatten(), batch.column(1)]
            packed = [pa.array([c.to_numpy().astype(np.float64).tobytes()]) for c in columns]
            yield pa.RecordBatch.from_arrays(packed, ["x", "weight"])


def expectation_maximization(
    pieces: DataFrame, starts: dict[int, Mixture], max_iter: int, tol: float, reg: float, grouped: bool
) -> dict[int, tuple[float, Mixture]]:
    """(log-likelihood, mixture) of every start after EM over packed rows. A step is one pass for all that still change; what
    reaches the driver are sums of a component's size, added up by Spark first if `grouped`."""
    found = {name: (-np.inf, start) for name, start in starts.items()}
    todo = list(starts)
    for _ in range(max_iter):
        if not todo:
            break
        sent = pieces.sparkSession.sparkContext.broadcast(_scaled({name: found[name][1] for name in todo}))
        sums = pieces.mapInArrow(_responsibilities(sent), SUMS)
        if grouped:
            sums = sums.groupBy("mixture").applyInArrow(_added, SUMS)
        table = _added(sums.toArrow())
        sent.destroy()  # its file too, or every step would leave one
        steps = dict(zip(table["mixture"].to_pylist(), table["sums"]))
        for name in list(todo):
            before, old = found[name]
            likelihood, new = _maximized(old, np.frombuffer(steps[name].as_buffer()), reg)
            found[name] = (likelihood, new)
            if abs(likelihood - before) <= tol:
                todo.remove(name)
    return found


SUMS = "mixture int, sums binary"


def _scaled(mixtures: dict[int, Mixture]) -> dict[int, tuple[np.ndarray, ...]]:
    """Means, axes scaled to unit variance and the constant part of the log-density of every component."""
    scaled = {}
    for name, (weights, means, covariances) in mixtures.items():
        values, axes = np.linalg.eigh(covariances)
        with np.errstate(divide="ignore"):
            constant = np.log(weights) - 0.5 * (np.log(values).sum(1) + means.shape[1] * np.log(2 * np.pi))
        scaled[name] = (means, axes / np.sqrt(values)[:, None, :], constant)
    return scaled


def _responsibilities(mixtures: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Log-likelihood and, for each component, the sums of shares, of shares times distances from its mean and of their
    products, over the rows of a task. Densities stay logarithms: in many dimensions they are beyond what a double holds."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for x, weight in zip(*(c.to_pylist() for c in batch.columns)):
                weight = np.frombuffer(weight)
                x = np.frombuffer(x).reshape(len(weight), -1)
                for name, model in mixtures.value.items():
                    part = _sums(x, weight, *model)
                    totals[name] = totals[name] + part if name in totals else part
        if totals:
            columns = [pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["mixture", "sums"])

    return sums


def _sums(x: np.ndarray, weight: np.ndarray, means: np.ndarray, scales: np.ndarray, constant: np.ndarray) -> np.ndarray:
    k, dims = means.shape
    density = np.empty((len(x), k))
    for j in range(k):
        z = (x - means[j]) @ scales[j]
        density[:, j] = constant[j] - 0.5 * np.einsum("ij,ij->i", z, z)
    top = density.max(axis=1)
    total = top + np.log(np.exp(density - top[:, None]).sum(axis=1))
    share = np.exp(density - total[:, None])
    counts, firsts, seconds = np.zeros(k), np.zeros((k, dims)), np.zeros((k, dims, dims))
    for j in range(k):
        on = share[:, j] > TINY
        apart, part = x[on] - means[j], share[on, j] * weight[on]
        counts[j], firsts[j], seconds[j] = part.sum(), part @ apart, (apart * part[:, None]).T @ apart
    return np.concatenate([[weight @ total], counts, firsts.ravel(), seconds.ravel()])


def _added(table: pa.Table) -> pa.Table:
    """One row a mixture, its sums added in an order that does not depend on which task ended first."""
    parts: dict[int, list[bytes]] = {}
    for name, sums in zip(table["mixture"].to_pylist(), table["sums"].to_pylist()):
        parts.setdefault(name, []).append(sums)
    totals = [np.sum([np.frombuffer(p) for p in sorted(x)], axis=0).tobytes() for x in parts.values()]
    return pa.table({"mixture": pa.array(list(parts), pa.int32()), "sums": pa.array(totals, pa.binary())})


def _maximized(old: Mixture, sums: np.ndarray, reg: float) -> tuple[float, Mixture]:
    """Log-likelihood of a mixture and the next one. A component without rows keeps its place and weighs nothing."""
    k, dims = old.means.shape
    counts, firsts, seconds = sums[1 : k + 1], sums[k + 1 : k + 1 + k * dims].reshape(k, dims), sums[k + 1 + k * dims :].reshape(k, dims, dims)
    held = counts > 0
    moved = np.divide(firsts, counts[:, None], out=np.zeros_like(firsts), where=held[:, None])
    spread = seconds[held] / counts[held, None, None] - moved[held, :, None] * moved[held, None, :]
    covariances = old.covariances.copy()
    covariances[held] = floored(spread, reg)
    return float(sums[0]), Mixture(counts / counts.sum(), old.means + moved, covariances)


def mixture_score(df: DataFrame, pca, model: Mixture, column: str = "embedding", reg: float = 1e-4) -> DataFrame:
    """Add `score` = -log likelihood under the mixture."""
    parts = []
    for w, mean, cov in zip(*model):
        if w == 0:
            continue
        cov = cov + reg * np.eye(len(mean))
        sign, logdet = np.linalg.slogdet(cov)
        parts.append((np.log(w), mean, np.linalg.inv(cov), logdet))

    @F.pandas_udf("double")
    def score(z: pd.Series) -> pd.Series:
        if not len(z):
            return pd.Series([], dtype="float64")
        x = np.stack(z.to_numpy())
        terms = []
        for logw, mean, inverse, logdet in parts:
            d = x - mean
            mahalanobis = np.einsum("ij,jk,ik->i", d, inverse, d)
            terms.append(logw - 0.5 * (mahalanobis + logdet + len(mean) * np.log(2 * np.pi)))
        return pd.Series(-np.logaddexp.reduce(np.stack(terms), axis=0))

    reduced = pca.transform(df.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))))
    return reduced.withColumn("score", score(vector_to_array("reduced"))).drop("features", "reduced")
