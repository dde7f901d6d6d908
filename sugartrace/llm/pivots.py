"""Exact top-k by inner product through a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it; the distances of a pivot are cut in annuli. For a
query at distance D of a pivot and an annulus [low, high] of it, no vector inside is nearer than
max(0, low - D, D - high) (triangle inequality), and q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 turns that into the
highest score the annulus can hold. A query first visits its best annuli; those whose bound cannot reach the
k-th score found so far are never visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sugartrace.llm.common import small_batches
from sugartrace.session import materialize

MOST_PIVOTS = 256
MOST_ANNULI = 64  # a pivot
ROWS = 1024  # vectors, and queries, that are multiplied at a time
FIRST = 128  # candidates of the first visit at least
EXACT = float(2**53)
SLACK = 1e-9
WIDE = 2.0**62


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal-length arrays of long as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows: by floats where those are exact, else by 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    fa, fb = a.astype(np.float64), b.astype(np.float64)
    if np.sqrt((fa**2).sum(1).max() * (fb**2).sum(1).max()) < EXACT:
        return (fa @ fb.T).astype(np.int64)
    return a @ b.T


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, dim, vec): floor(scale * x) of vectors without null or non-finite components; null ids take no part."""
    clean = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = clean.where(~F.coalesce(bad, F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return clean.select(F.col(key).cast("long").alias("id"), F.size(vector).alias("dim"), whole.alias("vec"))


def top_k(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """Rows (query_id, rank, `key`, score): each query's k highest scores among all rows with another id, ties to
    the smaller id. Only vectors of the query's length are compared. A repeated row is a candidate as often as it occurs,
    and a query once. `is_query` is a condition on `key`.
    """
    spark = vectors.sparkSession
    small_batches(spark, 64)
    rows = materialize(whole_numbers(vectors, key, vector, scale))
    count, dim = rows.agg(F.count("*"), F.max("dim")).first()
    out = f"query_id long, rank int, {key} long, score long"
    if not count:
        return spark.createDataFrame([], out)
    rows = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.col("dim"))))

    # A sample of fixed size: it decides how much is pruned, never the result.
    wanted = min(MOST_PIVOTS, max(1, int(count**0.5 / 8)))
    sample = rows.orderBy(F.xxhash64("id", "vec"), "id").limit(wanted).select("vec").collect()
    pivots = np.array([r.vec for r in sample], np.int64).reshape(len(sample), dim).astype(np.float64)
    pivot_squares = (pivots**2).sum(1)

    def distances(vecs: np.ndarray) -> np.ndarray:
        vecs = vecs.astype(np.float64)
        squares = (vecs**2).sum(1)[:, None] + pivot_squares - 2 * vecs @ pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = matrix(batch.column(2))
            away = distances(vecs)
            nearest = away.argmin(1)
            norm = (vecs.astype(np.float64) ** 2).sum(1)
            extra = [pa.array(nearest.astype(np.int32)), pa.array(away[np.arange(len(vecs)), nearest]), pa.array(norm)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["id", "dim", "vec", "pivot", "dist", "norm"])

    keyed = materialize(rows.mapInArrow(assign, "id long, dim int, vec array<long>, pivot int, dist double, norm double"))
    annuli = int(min(MOST_ANNULI, max(1, count / len(pivots) / ROWS)))
    cuts = keyed.groupBy("dim", "pivot").agg(F.percentile_approx("dist", [i / annuli for i in range(1, annuli)] or [1.0]).alias("cuts"))
    annulus = F.size(F.filter("cuts", lambda c: c < F.col("dist"))) if annuli > 1 else F.lit(0)
    keyed = keyed.join(cuts, ["dim", "pivot"]).withColumn("annulus", annulus).drop("cuts")
    index = materialize(keyed)
    # The directory has at most MOST_PIVOTS * MOST_ANNULI rows for each length of vectors.
    directory = index.groupBy("dim", "pivot", "annulus").agg(
        F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm").alias("norm")
    )
    rings = directory.orderBy("dim", "pivot", "annulus").toPandas()
    ring_dim, ring_pivot = rings["dim"].to_numpy(), rings["pivot"].to_numpy()
    low, high, norm, n = (rings[c].to_numpy(np.float64) for c in ("low", "high", "norm", "n"))
    pieces = np.ceil(n / ROWS).astype(np.int64)

    # Vectors of an annulus in pieces of about ROWS.
    numbers = spark.createDataFrame(
        [(int(d), int(p), int(a), i, int(m)) for i, (d, p, a, m) in enumerate(zip(ring_dim, ring_pivot, rings["annulus"], pieces))],
        "dim int, pivot int, annulus int, ring int, pieces int",
    )
    placed = index.join(F.broadcast(numbers), ["dim", "pivot", "annulus"])
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    stored = materialize(placed.groupBy("ring", "piece").agg(F.collect_list(F.struct("id", "vec")).alias("rows")))

    def bounds(vecs: np.ndarray, dims: np.ndarray) -> np.ndarray:
        """Highest score each annulus can hold for each query; -inf for vectors of another length."""
        squares = (vecs.astype(np.float64) ** 2).sum(1)[:, None]
        away = distances(vecs)[:, ring_pivot]
        gap = np.maximum(0, np.maximum(low - away, away - high)) * (1 - SLACK)
        by_triangle = (squares + norm - gap**2) / 2
        best = np.minimum(by_triangle, np.sqrt(squares * norm)) + SLACK * (squares + norm) + 1
        return np.where(dims[:, None] == ring_dim, best, -np.inf)

    def visits(first: bool):
        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                best = bounds(matrix(batch.column(2)), batch.column(1).to_numpy())
                order = np.argsort(-best, axis=1, kind="stable")
                reached = np.cumsum(n[order], axis=1) - n[order] < FIRST
                near = np.zeros(best.shape, bool)
                np.put_along_axis(near, order, reached, axis=1)
                near &= best > -np.inf
                wanted = near if first else ~near & (best >= batch.column(3).to_numpy(zero_copy_only=False)[:, None]) & (best > -np.inf)
                query, ring = np.nonzero(wanted)
                again = pieces[ring]
                piece = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
                query, ring = np.repeat(query, again), np.repeat(ring, again)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ring.astype(np.int32)), pa.array(piece.astype(np.int32)), batch.column(0).take(pa.array(query)), batch.column(2).take(pa.array(query))],
                    ["ring", "piece", "id", "vec"],
                )

        return plan

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mine, theirs = batch.column(0)[i].values, batch.column(1)[i].values
                query_ids, ids = mine.field(0).to_numpy(), theirs.field(0).to_numpy()
                scores = product(matrix(mine.field(1)), matrix(theirs.field(1)))
                by_id = np.argsort(ids, kind="stable")
                ids, scores = ids[by_id], scores[:, by_id]
                order = np.argsort(-scores, axis=1, kind="stable")
                open_ = ids[order] != query_ids[:, None]
                keep = open_ & (np.cumsum(open_, axis=1) <= k)
                query, place = np.nonzero(keep)
                at = order[query, place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[query]), pa.array(ids[at]), pa.array(scores[query, at])], ["query_id", "id", "score"]
                )

    def search(queries: DataFrame, first: bool) -> DataFrame:
        asked = queries.mapInArrow(visits(first), "ring int, piece int, id long, vec array<long>")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
        asked = asked.groupBy("ring", "piece", "part").agg(F.collect_list(F.struct("id", "vec")).alias("asked"))
        pairs = asked.join(stored, ["ring", "piece"]).select("asked", "rows")
        small_batches(spark, 8)
        return pairs.mapInArrow(multiply, "query_id long, id long, score long")

    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    queries = index.where(is_query(F.col("id"))).select("id", "dim", "vec").dropDuplicates()
    parts = max(1, queries.count() // ROWS)
    near = materialize(search(queries.withColumn("least", F.lit(-WIDE)), True))
    least = near.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
    least = least.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    bounded = queries.join(least, "id", "left").select("id", "dim", "vec", F.coalesce("least", F.lit(-WIDE)).alias("least"))
    far = search(bounded, False)
    best = near.union(far).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def hundredths(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, lambda vec_id: vec_id % 100 == 0)
