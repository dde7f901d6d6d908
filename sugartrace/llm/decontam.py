"""Documents that hold a passage of a benchmark item.

A window is as many words of a document as the item has. Its SimHash over five-word shingles is looked up in a
multi-index: the fingerprints are cut in one block more than bits may differ, so every pair within the radius
agrees in some block. Candidates are then compared exactly: shingles weighted by how often they occur,
sum of smaller over sum of larger weights. Only windows that share enough shingles with an item to be able to reach the
threshold are fingerprinted; that bound is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sugartrace.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
BITS = 64
RADIUS = 23  # at similarity 0.8 fingerprints differ in 10 bits on average, with a deviation of 3
BROADCAST_ROWS = 1_000_000  # rows of two or three numbers that may be broadcast; more are joined by a shuffle
BREAKS = "[^\\p{L}\\p{N}]+"
DOC = ["doc_id", "text_key"]


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def shingles(words_: str, width: Column | int) -> Column:
    """Hash of every run of `width` words."""
    width = F.lit(width) if isinstance(width, int) else width
    count = F.size(words_) - width + 1
    starts = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    return F.when(count > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(words_, i, width)))).otherwise(F.array().cast("array<bigint>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash `fp` of the shingle hashes `h` of each key: two 32-bit counters of bits in each sum."""
    low = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(low)).alias(f"s{k}") for k in range(32)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    lower, upper = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(32):
        ones = F.col(f"s{k}").bitwiseAND(F.lit((1 << 32) - 1))
        lower = lower + F.when(2 * ones > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0).cast("long"))
        ones = F.shiftrightunsigned(f"s{k}", 32)
        upper = upper + F.when(2 * ones > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0).cast("long"))
    return counted.select(*keys, "n", F.shiftleft(upper, 32).bitwiseOR(lower).alias("fp"))


def blocks(fp: str) -> Column:
    """(number, value) of the blocks of a fingerprint."""
    cuts = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
    )


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, item_id, start, n_words, similarity): the best window of each document and item that reaches the threshold.

    `start` counts words from 0; ties go to the first window. An item with fewer than five words is one shingle of
    its words; a document with fewer words than an item is one window. Texts and items without words match nothing. A
    repeated row counts once, and documents that share a doc_id are told apart by their text.
    """
    listed = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    listed = listed.withColumn("width", F.least(F.size("words"), F.lit(SHINGLE)))
    listed = listed.withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"])
    listed = materialize(
        listed.select("item_id", "item", "width", F.size("words").alias("n_words"), F.explode(shingles("words", F.col("width"))).alias("h"))
    )
    counts = listed.groupBy("item_id", "item", "width", "n_words", "h").agg(F.count("*").alias("times"))
    counts = counts.withColumn("need", F.sum("times").over(Window.partitionBy("item")))
    counts = materialize(counts)
    known = counts.count()
    widths = [r.width for r in counts.select("width").distinct().collect()]  # at most SHINGLE different

    def of_documents(some: DataFrame) -> DataFrame:
        split = some.select("doc_id", text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("words"))
        arrays = F.array(*[F.struct(F.lit(w).alias("width"), shingles("words", w).alias("hashes")) for w in widths or [SHINGLE]])
        return split.select(*DOC, F.explode(arrays).alias("s")).select(*DOC, "s.width", "s.hashes", F.size("s.hashes").alias("total"))

    hashes = of_documents(docs).select(*DOC, "width", "total", F.posexplode("hashes").alias("pos", "h"))
    hits = hashes.join(_small(counts.select("item", "width", "h", "need"), known), ["width", "h"])
    hits = materialize(hits.select(*DOC, "item", "width", "total", "need", "pos").distinct())
    each = Window.partitionBy(*DOC, "item")
    able = hits.withColumn("_hits", F.count("*").over(each)).where(F.col("_hits") >= threshold * F.col("need"))
    size = F.least("need", F.col("total").cast("long"))
    starts = able.withColumn("size", size).withColumn("back", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") - 1)))
    starts = starts.withColumn("start", F.col("pos") - F.col("back")).where("start >= 0 and start <= total - size")
    starts = starts.groupBy(*DOC, "item", "width", "need", "size", "start").agg(F.count("*").alias("_hits"))
    starts = materialize(starts.where(F.col("_hits") >= threshold * F.col("need")).drop("_hits"))

    keys = materialize(starts.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key"))
    again = docs.select("doc_id", "text").join(_small(keys, keys.count()), own, "left_semi")
    arrays = of_documents(again.distinct())
    held = arrays.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("width").alias("_width"), "hashes")
    inside = starts.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")) & (F.col("width") == F.col("_width")))
    window = [*DOC, "item", "start"]
    inside = inside.select(*window, "need", F.explode(F.slice("hashes", (F.col("start") + 1).cast("int"), F.col("size").cast("int"))).alias("h"))
    inside = materialize(inside)

    fps = fingerprint(inside, window)
    item_fps = fingerprint(listed.select("item", "h"), ["item"]).select(F.col("item"), F.col("fp").alias("item_fp"))
    item_blocks = item_fps.select("item", "item_fp", F.explode(blocks("item_fp")).alias("b")).select("item", "item_fp", "b.block", "b.value")
    window_blocks = fps.select(*window, "n", "fp", F.explode(blocks("fp")).alias("b")).select(*window, "n", "fp", "b.block", "b.value")
    near = window_blocks.join(item_blocks, ["item", "block", "value"])
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select(*window, "n").distinct()

    weights = inside.groupBy(*window, "h").agg(F.count("*").alias("mine"))
    shared = weights.join(counts, ["item", "h"]).groupBy(*window, "item_id", "n_words", "need").agg(F.sum(F.least("mine", "times")).alias("shared"))
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))] + [F.col(f"a.{c}") == F.col(f"b.{c}") for c in window[1:]]
    on = same[0]
    for part in same[1:]:
        on = on & part
    scored = near.alias("a").join(shared.alias("b"), on).select("b.*", "a.n")
    scored = scored.withColumn("similarity", F.col("shared").cast("double") / (F.col("need") + F.col("n") - F.col("shared")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("_start"), "n_words")).alias("best")
    found = scored.where(F.col("similarity") >= threshold).groupBy(*DOC, "item_id").agg(best)
    return found.select(*DOC, "item_id", (-F.col("best._start")).cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"), "best.similarity")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a benchmark passage."""
    keys = contaminated(docs, items).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keys = materialize(keys)
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key"))
    return docs.join(_small(keys, keys.count()), on, "left_anti")


def leak_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contaminated(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")
