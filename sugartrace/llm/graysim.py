"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are grouped under upper nodes by a masked bit pattern they share, and each group is sorted by
Gray rank, so neighbours in it share most other bits too. Inside a group, runs of fingerprints form nodes, and runs of
nodes form higher nodes; a node holds the bits all its fingerprints share. A search goes down from the top and adds
up the differing bits of each level; a node whose sum passes the radius is left out with all below it.

Masks: the 64 bits are cut in segments; as at most `radius` bits differ, all but `radius` segments are equal
in some choice, so each choice of the others is one family of upper nodes and no pair is missed. The number of
segments grows with the number of fingerprints, to keep groups small.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugartrace.llm.common import components, small_batches
from sugartrace.session import materialize

SEED = 42
BITS = 64
PIECE = 50_000  # shingles whose bits are unpacked at a time
NODE = 32  # fingerprints in a node, nodes in a higher node
SIZED_FOR = 1 << 20  # fingerprints the masks suit at least, so work grows evenly up to there
HELD = 200_000  # rows a task holds before it joins the groups it has read whole


def fingerprint(text: bytes | None, size: int) -> int:
    """SimHash of word shingles of a UTF-8 text: a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    width = min(size, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    shingles = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in shingles), np.uint64, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), PIECE):
        octets = hashes[begin : begin + PIECE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """A row for each document: `key`, fp (the fingerprint as a signed long). Null and blank texts have fingerprint zero."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], [key, "fp"])

    columns = docs.select(F.col(key), F.col(text))
    return columns.mapInArrow(score, f"`{key}` {columns.schema[0].dataType.simpleString()}, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray code."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def differing(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits)


class GrayIndex:
    """Two levels of nodes over fingerprints in Gray order."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        starts = np.arange(0, len(fps), NODE)
        self.pattern = np.bitwise_and.reduceat(fps, starts)
        either = np.bitwise_or.reduceat(fps, starts)
        self.mask = ~(self.pattern ^ either)
        high = np.arange(0, len(starts), NODE)
        self.high_pattern = np.bitwise_and.reduceat(self.pattern, high)
        self.high_mask = ~(self.high_pattern ^ np.bitwise_or.reduceat(either, high))
        own = np.repeat(self.high_mask, NODE)[: len(starts)]
        self.rest = self.mask & ~own  # shared by the node and not by the node above

    def near(self, fp: np.uint64, radius: int, open_: np.ndarray) -> np.ndarray:
        """Places still open that differ from `fp` in at most `radius` bits."""
        above = differing((self.high_pattern ^ fp) & self.high_mask)
        high = np.flatnonzero(above <= radius)
        nodes = (high[:, None] * NODE + np.arange(NODE)).ravel()
        so_far = np.repeat(above[high], NODE)
        inside = nodes < len(self.pattern)
        nodes, so_far = nodes[inside], so_far[inside]
        so_far = so_far + differing((self.pattern[nodes] ^ fp) & self.rest[nodes])
        nodes = nodes[so_far <= radius]
        leaves = (nodes[:, None] * NODE + np.arange(NODE)).ravel()
        leaves = leaves[leaves < len(self.fps)]
        leaves = leaves[open_[leaves]]
        return leaves[differing(self.fps[leaves] ^ fp) <= radius]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints within `radius`, one for each newly reached one: at most len(fps) - 1."""
    index, open_ = GrayIndex(fps), np.ones(len(fps), bool)
    ends: list[np.ndarray] = []
    begins: list[np.ndarray] = []
    for first in range(len(fps)):
        if not open_[first]:
            continue
        open_[first] = False
        waiting = [first]
        while waiting:
            at = waiting.pop()
            found = index.near(fps[at], radius, open_)
            if len(found):
                open_[found] = False
                waiting.extend(found.tolist())
                begins.append(np.full(len(found), fps[at]))
                ends.append(fps[found])
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *begins]), np.concatenate([none, *ends])


def links_of(groups: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups; rows sorted by group, then Gray rank. Groups up to a node's size are compared side by side."""
    cuts = np.flatnonzero(np.diff(groups)) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(fps)]]))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    small = np.repeat(sizes <= NODE, sizes)
    for apart in range(1, min(NODE, int(sizes.max()))):
        pair = small[:-apart] & (groups[:-apart] == groups[apart:])
        at = np.flatnonzero(pair)
        if not len(at):
            break
        at = at[differing(fps[at] ^ fps[at + apart]) <= radius]
        left.append(fps[at])
        right.append(fps[at + apart])
    for start, length in zip(starts[sizes > NODE], sizes[sizes > NODE]):
        begins, ends = forest(fps[start : start + length], radius)
        left.append(begins)
        right.append(ends)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect all distinct values of `fps` (fp) within `radius` bits."""
    count = max(fps.count(), SIZED_FOR)
    segments = radius + 1
    while count > 2 ** (8 + BITS * (segments - radius) // segments) and segments < radius + 4:
        segments += 1
    cuts = [BITS * i // segments for i in range(segments + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(segments)]
    masks = [sum(parts[i] for i in chosen) for chosen in combinations(range(segments), segments - radius)]
    signed = [int(np.array(m, np.uint64).view(np.int64)) for m in masks]
    node = F.explode(F.array(*[F.struct(F.lit(i).alias("family"), F.col("fp").bitwiseAND(F.lit(m)).alias("node")) for i, m in enumerate(signed)]))
    tree = fps.select("fp", node.alias("upper")).select("fp", F.xxhash64("upper.family", "upper.node").alias("upper"))
    # Gray rank in columns: x ^ x >> 1 ^ x >> 2 ... by doubling.
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        tree = tree.withColumn("rank", rank.bitwiseXOR(F.shiftrightunsigned(rank, shift)))
        rank = F.col("rank")
    tree = tree.repartition("upper").sortWithinPartitions("upper", "rank")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uppers, values = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(end: int) -> pa.RecordBatch:
            a, b = links_of(uppers[:end], values[:end], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            uppers = np.concatenate([uppers, batch.column(0).to_numpy()])
            values = np.concatenate([values, batch.column(1).to_numpy().view(np.uint64)])
            if len(uppers) >= HELD and uppers[0] != uppers[-1]:
                end = int(np.searchsorted(uppers, uppers[-1]))  # the last group may go on
                yield found(end)
                uppers, values = uppers[end:], values[end:]
        if len(uppers):
            yield found(len(uppers))

    return tree.select("upper", "fp").mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, radius: int = 3) -> DataFrame:
    """A row for each document: `key`, fp, component_id (the smallest key reachable over links, itself included).

    Null and blank texts share fingerprint zero and are linked like any other. Repeated rows stay. A null key never
    is a component's smallest unless all keys of the component are null.
    """
    rows = materialize(fingerprints(docs, text, key, size))
    distinct = materialize(rows.groupBy("fp").agg(F.min(key).alias("low")))
    roots = components(links(distinct.select("fp"), radius))
    distinct = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    distinct = distinct.withColumn("root", F.coalesce("root", "fp"))
    lowest = distinct.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = distinct.join(lowest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(key, "fp", "component_id")


def component_rows(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return near_duplicates(docs, size=size, radius=radius).select("doc_id", digits, "component_id")
