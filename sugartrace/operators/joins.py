"""Join shapes that stay balanced: lookups by key, bucketed ranges, nearest match by fill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugartrace.operators import ordered
from sugartrace.operators.ordered import lookup_join  # noqa: F401  (part of this module's interface)

def interval_join(
    probes: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    low: Column,
    high: Column,
    position: str,
    width: int,
    how: str = "left",
) -> DataFrame:
    """Points with `low <= position <= high`, as an equi-join on key and bucket.

    Probes are copied to the buckets their interval touches, points live in one bucket, so
    a pair meets once. A left join may repeat an unmatched probe per bucket: aggregate by
    the probe's id after it. Pass points that are unique per position to bound the partners.
    """
    left = probes.withColumn("_low", low).withColumn("_high", high)
    left = left.withColumn(
        "_bucket",
        F.explode(F.sequence(ordered.floor_div("_low", width), ordered.floor_div("_high", width))),
    )
    right = points.withColumn("_bucket", ordered.floor_div(position, width))
    left_alias, right_alias = left.alias("l"), right.alias("r")
    condition = F.col("l._bucket") == F.col("r._bucket")
    for key in keys:
        condition = condition & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    condition = condition & F.col(f"r.{position}").between(F.col("l._low"), F.col("l._high"))
    kept = [F.col(f"l.{c}") for c in probes.columns]
    added = [F.col(f"r.{c}") for c in points.columns if c not in keys]
    return left_alias.join(right_alias, condition, how).select(*kept, *added)


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    position: str,
    sequence: str,
    values: Sequence[str],
    tolerance: int,
    block: int = 1440,
) -> DataFrame:
    """Attach the nearest right row within `tolerance`; ties take the earlier, then the first in order.

    The right side is reduced to one row per position, merged with the left rows and filled
    in both directions, so no pair of rows is ever formed.
    """
    tagged = right.groupBy(key, position).agg(
        F.min_by(F.struct(F.col(position).alias("at"), *values), sequence).alias("_hit")
    )
    merged = (
        left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(tagged.schema["_hit"].dataType).alias("_hit"))
        .unionByName(tagged.select(key, position, "_hit", F.lit(0).alias("_side")), allowMissingColumns=True)
    )
    merged = ordered.with_block(merged, position, block)
    order = [position, "_side", sequence]
    hit = F.col("_hit")
    merged = ordered.sweep(merged, [key], order, forward={"_prev": hit}, backward={"_next": hit})
    # a right row at the same position sorts before the left one, so it is found backwards
    before = F.col(position) - F.col("_prev.at")
    after = F.col("_next.at") - F.col(position)
    best = F.when(
        F.col("_prev").isNotNull() & (before <= F.coalesce(after, before)), F.col("_prev")
    ).otherwise(F.col("_next"))
    out = merged.filter("_side = 1").withColumn("_best", best)
    near = F.abs(F.col("_best.at") - F.col(position)) <= tolerance
    return out.select(*left.columns, *[F.when(near, F.col(f"_best.{v}")).alias(v) for v in values])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First row per key, by partial aggregation: copies of a key merge before the shuffle."""
    packed = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in columns])


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    packed = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])


def disjoint_union(cohorts: Mapping[str, DataFrame], id_column: str) -> tuple[DataFrame, DataFrame]:
    """Union of cohorts with their name, and the ids that occur in more than one of them."""
    pooled = None
    for name, df in cohorts.items():
        tagged = df.withColumn("cohort", F.lit(name))
        pooled = tagged if pooled is None else pooled.unionByName(tagged, allowMissingColumns=True)
    shared = (
        pooled.groupBy(id_column)
        .agg(F.min("cohort").alias("_a"), F.max("cohort").alias("_b"))
        .filter("_a <> _b")
        .select(id_column)
    )
    return pooled, shared
