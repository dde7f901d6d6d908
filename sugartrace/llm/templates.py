"""Line dedup by log templates.

The tree has a fixed depth: number of tokens, then the leading tokens; a token with a digit in it is a variable
field. Each leaf has one template: the most frequent token of each place if it makes up half of the lines there, else
a variable. A line that agrees with its leaf's template in enough places belongs to it; any other line is a template of its own.
Templates that occur in enough documents are dropped from all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugartrace.llm.common import SPACES
from sugartrace.session import materialize

LEADING = 3
AGREE = 0.7
DOCUMENTS = 5
VARIABLE = "<*>"
BROADCAST_ROWS = 1_000_000  # numbers that may be broadcast; more are joined by a shuffle


def tokens(line: Column) -> Column:
    found = F.filter(F.split(line, SPACES), lambda t: t != "")
    return F.transform(found, lambda t: F.when(t.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(t))


def lines_of(docs: DataFrame) -> DataFrame:
    """A row for each line that is not blank: doc_id, text_key, line (number from 0), content, leaf, line_key."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    filled = cut.where(F.col("content").rlike("[^\\x20\\x09-\\x0D]"))  # on the line itself, so tokens are made once
    filled = filled.withColumn("tokens", tokens(F.col("content")))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEADING)).alias("leaf")
    return filled.select("*", leaf, F.xxhash64("tokens").alias("line_key")).drop("tokens")


def recurring_lines(docs: DataFrame, documents: int = DOCUMENTS, agree: float = AGREE) -> DataFrame:
    """(doc_id, text_key, line) of the lines whose template occurs in at least `documents` documents."""
    docs = docs.where("text is not null")
    written = materialize(lines_of(docs))
    lines = written.drop("content")
    document = F.xxhash64("doc_id", "text_key").alias("document")
    # Only leaves in enough documents can hold a template in enough documents.
    leaves = lines.select("leaf", document).distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= documents)
    leaves = materialize(leaves.select("leaf"))
    few = leaves.count() <= BROADCAST_ROWS
    kept = lambda df: df.join(F.broadcast(leaves) if few else leaves, "leaf", "left_semi")
    lines = materialize(kept(lines).withColumn("document", document))
    # Equal lines have equal tokens, so only one of them goes through the shuffle, and no text is read again for it.
    often = kept(written).groupBy("leaf", "line_key").agg(F.count("*").alias("times"), F.first("content").alias("content"))
    distinct = materialize(often.withColumn("tokens", tokens(F.col("content"))).drop("content"))
    placed = distinct.select("leaf", "times", F.posexplode("tokens").alias("place", "token"))
    votes = placed.groupBy("leaf", "place", "token").agg(F.sum("times").alias("votes"))
    chosen = votes.groupBy("leaf", "place").agg(F.max(F.struct("votes", "token")).alias("best"), F.sum("votes").alias("all"))
    constant = chosen.where(2 * F.col("best.votes") >= F.col("all")).select("leaf", F.struct("place", F.col("best.token").alias("token")).alias("c"))
    template = constant.groupBy("leaf").agg(F.sort_array(F.collect_list("c")).alias("template"))  # as many as the line has tokens
    matched = distinct.join(template, "leaf", "left")
    equal = F.size(F.filter("template", lambda c: (F.element_at("tokens", c["place"] + 1) == c["token"])))
    belongs = F.coalesce(equal >= agree * F.size("tokens"), F.lit(False))
    matched = matched.select("leaf", "line_key", F.when(belongs, F.lit(0).cast("long")).otherwise(F.col("line_key")).alias("template"))
    lines = materialize(lines.join(matched, ["leaf", "line_key"]).select("doc_id", "text_key", "line", "document", "leaf", "template"))
    spread = lines.select("leaf", "template", "document").distinct().groupBy("leaf", "template").agg(F.count("*").alias("n"))
    return lines.join(spread.where(F.col("n") >= documents), ["leaf", "template"], "left_semi").select("doc_id", "text_key", "line")


def drop_recurring(docs: DataFrame, documents: int = DOCUMENTS, agree: float = AGREE) -> DataFrame:
    """`docs` with recurring lines taken out of `text`, and n_lines, n_dropped appended.

    Null texts have no lines and stay null; blank lines are never dropped. Repeated rows get the same result, and
    count as one document. Very long lines are templates like others.
    """
    found = recurring_lines(docs, documents, agree)
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("line").alias("_lines"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    joined = docs.join(found, on, "left").withColumn("_cut", F.split("text", "\n"))
    kept = F.filter("_cut", lambda _, i: ~F.array_contains("_lines", i))
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    others = [F.col(f"`{c}`") if c != "text" else text.alias("text") for c in docs.columns]
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return joined.select(*others, count("_cut").alias("n_lines"), count("_lines").alias("n_dropped"))


def line_rows(docs: DataFrame) -> DataFrame:
    kept = drop_recurring(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))
