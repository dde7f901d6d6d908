"""Helpers of this folder: reading tables, words and shingles as columns, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sugartrace.session import materialize

# White space of the word rule `[^\x20\x09-\x0D]+`, as a Java pattern.
SPACES = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


DOCUMENT = ("doc_id", "text", "source")


def apart(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`step` over the columns it works with, all others packed in one, so that no name of theirs meets one of the step's own."""
    others = [c for c in docs.columns if c not in DOCUMENT]
    packed = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("other_columns")] if others else []
    out = step(docs.select(*[c for c in docs.columns if c in DOCUMENT], *packed))
    return out.select(*[F.col("other_columns").getField(c).alias(c) if c in others else F.col(c) for c in docs.columns])


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Python workers get few documents at a time, so long ones do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building them: pieces between spaces less an empty first and last piece."""
    text = F.coalesce(text, F.lit(""))
    spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
    first = F.substring(text, 1, 1).isin(spaces).cast("long")
    last = F.substring(text, -1, 1).isin(spaces).cast("long")
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, SPACES)) - first - last).cast("long")


def held_out(doc_id: Column) -> Column:
    """The fixed fifth of documents no classifier learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b): rows (node, root), root the smallest node; nodes without edge are absent.

    Alternating large and small stars. Every round writes its edges in the shared folder, so lineage stays
    short and a lost executor repeats one round. A hub is a group of partial minima and a join that
    adaptive execution may split, never one task's list of neighbours.
    """
    current = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        current = materialize(
            small.select(F.col("low").alias("a"), F.col("v").alias("b"))
            .union(low.select(F.col("low"), F.col("u")))
            .where("a <> b")
            .distinct()
        )
    return current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def running(df: DataFrame, keys: list[str], block: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Inclusive running sum of `value` per key without one task per key: blocks are summed first."""
    sums = df.groupBy(*keys, block).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, block, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(sums, [*keys, block])
    return joined.withColumn(out, F.col("_ahead") + F.sum(value).over(inside)).drop("_ahead")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, longest: int) -> DataFrame:
    """(text, label) of at most `most` labelled documents outside the held-out fifth, texts up to `longest` characters.

    The one bounded sample of this folder: it fits classifiers, which then score everything. Rows come in hash order, so
    the sample repeats; the ids chosen are at most `most` rows and may be broadcast.
    """
    usable = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return joined.where(F.length("text") <= longest).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("text", "label")
