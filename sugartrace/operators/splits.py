"""Repeatable patient splits and balanced batches, by hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugartrace.operators import ordered
from sugartrace.operators.joins import lookup_join


def hash_rank(df: DataFrame, id_columns: Sequence[str], seed: int, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """0-based position in the order of an MD5 of seed and ids, per key. The first hex digits are the block: blocks
    are even, and at 65,536 of them each is a small window."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_columns]))
    hashed = df.withColumn("_h", digest)
    hashed = hashed.withColumn(ordered.BLOCK, F.conv(F.substring("_h", 1, 4), 16, 10).cast("long"))
    ranked = ordered.row_number(hashed, list(keys), ["_h", *id_columns], name)
    return ranked.withColumn(name, F.col(name) - 1).drop("_h", ordered.BLOCK)


def _by_counts(ranked: DataFrame, train: Column, val: Column) -> DataFrame:
    rank = F.col("rank")
    return ranked.withColumn("split", F.when(rank < train, "train").when(rank < train + val, "val").otherwise("test"))


def patient_split(ids: DataFrame, seed: int = 42, ratios: tuple[float, float] = (0.60, 0.20), key: str = "patient_id"):
    """60/20/20 by patient, exact counts."""
    unique = ids.select(key).distinct()
    total = unique.agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(unique, [key], seed).crossJoin(F.broadcast(total))
    n = F.col("_n")
    out = _by_counts(ranked, F.floor(n * ratios[0]), F.floor(n * ratios[1]))
    return out.select(key, "split")


def cohort_split(ids: DataFrame, seed: int = 42, n_train: int = 15, n_val: int = 3, key: str = "patient_id"):
    """Fixed numbers for train and validation, the rest is test."""
    ranked = hash_rank(ids.select(key).distinct(), [key], seed)
    return _by_counts(ranked, F.lit(n_train), F.lit(n_val)).select(key, "split")


def pooled_split(
    ids: DataFrame, n_test: dict[str, int], n_val: int = 6, seed: int = 42, key: str = "patient_id"
) -> DataFrame:
    """Reserve test patients per cohort, pool the others, carve validation from the pool.

    `ids`: patient, cohort.
    """
    ranked = hash_rank(ids.select(key, "cohort").distinct(), [key], seed, ["cohort"])
    quota = F.lit(0)
    for name, n in n_test.items():
        quota = F.when(F.col("cohort") == name, n).otherwise(quota)
    test = ranked.filter(F.col("rank") < quota).withColumn("split", F.lit("test")).drop("rank")
    pool = hash_rank(ranked.filter(F.col("rank") >= quota).drop("rank"), [key], seed + 1)
    rest = pool.withColumn("split", F.when(F.col("rank") < n_val, "val").otherwise("train")).drop("rank")
    return test.unionByName(rest)


def balanced_batches(pools: DataFrame, batch_size: int, normal_ratio: float = 0.7, seed: int = 42,
                     id_columns: Sequence[str] = ("patient_id", "start")) -> DataFrame:
    """Batches with a fixed share of normal windows; anomalous windows cycle when they are fewer.

    `pools`: ids, is_normal. Incomplete batches of normal windows are left out.
    """
    per_normal = int(batch_size * normal_ratio)
    per_anomaly = batch_size - per_normal
    ranked = hash_rank(pools, list(id_columns), seed, ["is_normal"])
    sizes = pools.agg(F.count_if("is_normal").alias("_nn"), F.count_if(~F.col("is_normal")).alias("_na"))
    batches = F.floor(F.col("_nn") / per_normal)
    rows = ranked.crossJoin(F.broadcast(sizes.withColumn("_b", batches)))
    normal = rows.filter("is_normal").withColumn("batch", F.floor(F.col("rank") / per_normal)).filter("batch < _b")
    # each batch opens its anomaly slots; slot i takes the anomaly of rank i modulo their number
    slots = (
        normal.filter(F.col("rank") % per_normal == 0)
        .select("batch", "_na", F.explode(F.sequence(F.lit(0), F.lit(per_anomaly - 1))).alias("_i"))
        .withColumn("_slot", F.col("batch") * per_anomaly + F.col("_i"))
        .filter("_na > 0")
        .withColumn("rank", F.pmod("_slot", "_na"))
    )
    pool = ranked.filter(~F.col("is_normal"))
    anomalous = lookup_join(slots, pool, ["rank"])
    columns = ["batch", *id_columns, "is_normal"]
    return normal.select(*columns).unionByName(anomalous.select(*columns))


def cap_per_class(rows: DataFrame, cap: int, seed: int = 42, label: str = "class",
                  id_columns: Sequence[str] = ("patient_id", "start")) -> DataFrame:
    """At most `cap` rows per class, chosen by hash order."""
    return hash_rank(rows, list(id_columns), seed, [label]).filter(F.col("rank") < cap).drop("rank")
