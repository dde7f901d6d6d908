"""Ordered computation per key without ever putting one key in one task.

A `Window.partitionBy(patient)` hands a patient's whole history to a single task. The
operators here split every key into blocks of its order column (a span of minutes, or a
quantile bucket), run the window inside `(key, block)`, and pass the state between blocks
through a summary with one row per block. A key that holds a third of all rows is then as
many tasks as it has blocks, and the fact rows are shuffled once.

`keys` and `order` are column names; `order` must be unique within a key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sugartrace.session import materialize

BLOCK = "_block"
TILE = "_tile"
CORE = "_core"


def floor_div(value: Column | str, width: float) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(width)).cast("long")


def with_block(df: DataFrame, order: str | Column, width: float) -> DataFrame:
    """Block = span of `width` units of a numeric order column."""
    return df.withColumn(BLOCK, floor_div(order, width))


def with_time_block(df: DataFrame, ts: str, seconds: int = 3600) -> DataFrame:
    return df.withColumn(BLOCK, floor_div(F.unix_seconds(F.col(ts)), seconds))


BLOCK_ROWS = 2_000_000


def with_value_block(df: DataFrame, value: str, blocks: int | None = None) -> DataFrame:
    """Block = approximate quantile bucket of a numeric column.

    Without `blocks`, there are 256, and more once a block would hold over BLOCK_ROWS rows. Only the cut points
    reach the driver. They become constants of the plan, so every branch of it agrees on the blocks; they decide
    balance, never the result. NaN values take the last block and null values none; without finite cuts there is one block.
    """
    if blocks is None:
        blocks = max(256, math.ceil(df.count() / BLOCK_ROWS))
    cuts = df.approxQuantile(value, [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)) if blocks > 1 else []
    cuts = sorted({c for c in cuts if math.isfinite(c)})
    if not cuts:
        return df.withColumn(BLOCK, F.when(F.col(value).isNotNull(), F.lit(0).cast("long")))
    splits = [float("-inf"), *cuts, float("inf")]
    bucketed = Bucketizer(
        splits=splits, inputCol=value, outputCol=BLOCK, handleInvalid="keep"
    ).transform(df)
    return bucketed.withColumn(BLOCK, F.col(BLOCK).cast("long"))


def _local(keys: Sequence[str], order: Sequence[str], backwards: bool = False):
    columns = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    return Window.partitionBy(*keys, BLOCK).orderBy(*columns)


def _across(keys: Sequence[str], backwards: bool = False):
    block = F.col(BLOCK).desc() if backwards else F.col(BLOCK).asc()
    return Window.partitionBy(*keys).orderBy(block)


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    inclusive: bool = True,
) -> DataFrame:
    """Running sum per key; `df` carries a block column."""
    terms = [expr.alias(f"_v_{name}") for name, expr in sums.items()]
    df = df.select("*", *terms)
    carry = (
        df.groupBy(*keys, BLOCK)
        .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
        .select(
            *keys,
            BLOCK,
            *[
                F.coalesce(
                    F.sum(f"_t_{n}").over(_across(keys).rowsBetween(Window.unboundedPreceding, -1)),
                    F.lit(0),
                ).alias(f"_c_{n}")
                for n in sums
            ],
        )
    )
    local = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    drop = [f"_{p}_{n}" for n in sums for p in "vcs"]
    return (
        df.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(local), F.lit(0)).alias(f"_s_{n}") for n in sums])
        .join(carry, [*keys, BLOCK])
        .withColumns({n: F.col(f"_s_{n}") + F.col(f"_c_{n}") for n in sums})
        .drop(*drop)
    )


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    return prefix_sum(df, keys, order, {name: F.lit(1).cast("long")})


def sweep(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    forward: Mapping[str, Column] | None = None,
    backward: Mapping[str, Column] | None = None,
    strict: Sequence[str] = (),
) -> DataFrame:
    """Carry values along each key: `forward` takes the last non-null value at or before a row,
    `backward` the first at or after it, without the row itself for names in `strict`.

    All columns share one block summary and one join.
    """
    forward, backward = dict(forward or {}), dict(backward or {})
    names = [*forward, *backward]
    df = df.select("*", *[e.alias(f"_v_{n}") for n, e in {**forward, **backward}.items()])
    edges = []
    for name in names:
        value = F.col(f"_v_{name}")
        pick = F.max_by if name in forward else F.min_by
        edges.append(pick(value, F.when(value.isNotNull(), F.struct(*order))).alias(f"_e_{name}"))

    def carried(name: str) -> Column:
        earlier = _across(keys, name in backward).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(f"_e_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}")

    def seen(name: str) -> Column:
        frame = _local(keys, order, name in backward).rowsBetween(
            Window.unboundedPreceding, -1 if name in strict else 0
        )
        return F.last(f"_v_{name}", ignorenulls=True).over(frame).alias(f"_s_{name}")

    carry = df.groupBy(*keys, BLOCK).agg(*edges).select(*keys, BLOCK, *map(carried, names))
    return (
        df.select("*", *map(seen, names))
        .join(carry, [*keys, BLOCK])
        .withColumns({n: F.coalesce(f"_s_{n}", f"_c_{n}") for n in names})
        .drop(*[f"_{p}_{n}" for n in names for p in "vcs"])
    )


def neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, Column]
) -> DataFrame:
    """Values of the row just before this one in its key, null on the first."""
    row = F.struct(*[e.alias(n) for n, e in columns.items()])
    out = sweep(df, keys, order, forward={"_near": row}, strict=["_near"])
    return out.withColumns({n: F.col(f"_near.{n}") for n in columns}).drop("_near")


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Keep the flagged rows and name their contiguous runs (`run`).

    Rows of a run share the last unflagged position before them. A run breaks on an
    unflagged row only, not on a gap in time.
    """
    df = df.withColumn("_on", F.coalesce(flag, F.lit(False)))
    out = sweep(df, keys, [order], forward={"run": F.when(~F.col("_on"), F.col(order).cast("long"))})
    return out.filter("_on").withColumn("run", F.coalesce("run", F.lit(NO_ROW))).drop("_on", BLOCK)


NO_ROW = -(2**62)  # below every position


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join facts to a one-row-per-key table.

    Spark broadcasts the lookup when its measured size allows. Beyond that it is one plain join, each side shuffled
    once; adaptive execution splits the partitions of heavy keys (`session.tune` asks for that also where it costs
    another shuffle), so no key is one task and light keys are not copied.
    """
    return facts.join(lookup, list(keys), how)


def with_halo(
    df: DataFrame, position: str, width: int, before: int = 0, after: int = 0
) -> DataFrame:
    """Copy rows into every tile whose frames reach them, for bounded sliding frames.

    Run the window per `(key, _tile)` over `[-before, +after]` and keep `_core` rows: a row
    is copied to the next tile only near a border, so the data grows by (before+after)/width.
    """
    first = floor_div(F.col(position) - F.lit(after), width)
    last = floor_div(F.col(position) + F.lit(before), width)
    home = floor_div(position, width)
    return df.withColumn(TILE, F.explode(F.sequence(first, last))).withColumn(
        CORE, F.col(TILE) == home
    )


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, blocks: int = 256) -> DataFrame:
    """Distinct values per key with the rank range `[lo, hi)` their copies occupy."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counts = materialize(counts)  # read for the cut points, the block totals and the ranks
    ranked = prefix_sum(with_value_block(counts, value, blocks), keys, [value], {"hi": F.col("_n")})
    return ranked.select(*keys, value, (F.col("hi") - F.col("_n")).alias("lo"), "hi")


def quantiles_from_ranks(
    ranks: DataFrame, keys: Sequence[str], value: str, totals: DataFrame, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linear-interpolated quantiles of the first `n` ranks of every key.

    `totals` has the keys and `n`; other columns of it are passed on. Only the values that
    hold a wanted rank are aggregated.
    """
    extra = [c for c in totals.columns if c not in (*keys, "n")]
    joined = lookup_join(ranks, totals, list(keys)) if keys else ranks.crossJoin(F.broadcast(totals))
    spots = {name: f"((n - 1) * {float(p)}D)" for name, p in probs.items()}
    parts = {
        f"_{name}_{side}": f"CASE WHEN lo <= {at}({spot}) AND {at}({spot}) < hi THEN `{value}` END"
        for name, spot in spots.items()
        for side, at in (("lo", "floor"), ("hi", "ceil"))
    }
    columns = [*keys, "n", *extra]
    hits = joined.selectExpr(*columns, *[f"{e} AS {n}" for n, e in parts.items()])
    picked = (
        hits.filter(f"coalesce({', '.join(parts)}) IS NOT NULL")
        .groupBy(*keys)
        .agg(*[F.expr(f"max({c}) AS {c}") for c in ("n", *extra, *parts)])
    )
    between = "_{0}_lo + (_{0}_hi - _{0}_lo) * ({1} - floor({1})) AS {0}"
    return picked.selectExpr(*columns, *[between.format(name, spot) for name, spot in spots.items()])


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], blocks: int = 256
) -> DataFrame:
    """Exact quantiles per key by rank, for keys too large for `percentile`'s one-task buffer."""
    ranks = order_statistics(df, keys, value, blocks)
    totals = ranks.groupBy(*keys).agg(F.max("hi").alias("n"))
    return quantiles_from_ranks(ranks, keys, value, totals, probs)
