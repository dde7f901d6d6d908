"""Mixing sources to target weights by weighted fair queueing.

Every pass over a source shuffles its documents by a hash. A document's virtual finish time is the number
of the source's words up to and with it, divided by the source's target. All sources are merged by that
time and cut where the words taken reach the budget, so each source is served in step with its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sugartrace.llm.common import running, word_count
from sugartrace.session import materialize

CYCLE = 3  # weights 1, 2, 3, repeating over the sources in code point order
MOST = 3  # passes over a source at most
BINS = 1024  # bins a unit of virtual time; only the size of tasks depends on it
LAST_BIN = 64 * BINS


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """One row a source (source, source_size) to its weight and target.

    A target is the smaller of `most` times the source and its weight times a level; the level solves that all
    targets add up to all sizes. Sources sorted by size over weight reach their limit in that order, so the
    level is found by running sums over sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % CYCLE + 1)
    out = out.withColumn("_ratio", (most * F.col("source_size")).cast("double") / F.col("weight"))
    by_ratio = Window.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    out = out.withColumn("_left", F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(ahead), F.lit(0)))
    out = out.withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
    out = out.withColumn("_level", F.col("_left").cast("double") / F.col("_weights"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    limit = (most * F.col("source_size")).cast("double")
    return out.select("source", "source_size", "weight", F.least(limit, level * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", row: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Every copy the mix takes (`_row`, pass, time, size, draw), and the sized rows it chose from.

    `_row` is the column `row`, which must be unique, or a number drawn here. Null texts have size 0; rows of size 0 are never
    taken, as they would add nothing. Equal rows are separate rows; ties of the hash go by key, size and row number. Null sources
    are one source, the last. An empty table gives no rows. Columns of `docs` are untouched.
    """
    rows = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("_row"),
        F.col(key).alias("_key"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
    )
    rows = materialize(rows)  # row numbers are drawn once
    count = rows.count()
    digits = 1
    while count > 20_000 * 16**digits and digits < 6:
        digits += 1
    goal = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    sized = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).select(rows["*"], "source_size", "target")
    passes = F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")) + 1).cast("int")
    copies = sized.where("size > 0 and target > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), passes)))
    draw = F.md5(F.concat(F.coalesce(F.col("_key").cast("string"), F.lit("null")), F.lit(":"), F.col("pass").cast("string")))
    copies = copies.withColumn("draw", draw).withColumn("_block", F.substring("draw", 1, digits))
    copies = copies.withColumn("_source", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    order = [F.col("draw"), F.col("_key"), F.col("size"), F.col("_row")]
    copies = running(copies, ["_source", "pass"], "_block", order, "size", "_upto")
    time = ((F.col("pass") - 1) * F.col("source_size") + F.col("_upto")).cast("double") / F.col("target")
    copies = copies.withColumn("time", time)
    copies = copies.withColumn("_bin", F.least(F.floor(F.col("time") * BINS), F.lit(LAST_BIN)).cast("long"))
    copies = materialize(copies.select("_row", "_key", "_source", "size", "source_size", "target", "pass", "draw", "time", "_bin"))
    # At most LAST_BIN + 1 rows: the number of bins is fixed.
    bins = copies.groupBy("_bin").agg(F.sum("size").alias("_words"))
    ahead = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_words").over(ahead), F.lit(0)))
    budget = goal.agg(F.sum("source_size")).first()[0] or 0
    bins = materialize(bins.where(F.col("_before") < budget))
    timed = copies.join(F.broadcast(bins), "_bin")
    whole = timed.where(F.col("_before") + F.col("_words") <= budget)
    within = Window.partitionBy("_bin").orderBy("time", "_source", "draw", "_key", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    cut = timed.where(F.col("_before") + F.col("_words") > budget).withColumn("_sum", F.col("_before") + F.sum("size").over(within))
    taken = whole.unionByName(cut.where(F.col("_sum") <= budget).drop("_sum"))
    return taken.select("_row", "pass", "time", "size", "draw"), sized


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: a document row for each copy taken, globally sorted by virtual finish time."""
    numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    taken, _ = mix(numbered, row="_row")
    taken = taken.select("_row", F.col("time").alias("_time"), F.col("draw").alias("_draw"))
    return numbered.join(taken, "_row").orderBy("_time", "_draw").select(docs.columns)


def mixed_words(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken (words taken, repeats counted)."""
    taken, rows = mix(docs)
    words = taken.groupBy("_row").agg(F.sum("size").alias("taken"))
    return rows.join(words, "_row", "left").select(
        F.col("_key").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )
