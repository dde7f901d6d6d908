"""Near-duplicate documents: several SimHash fingerprints find pairs, exact shingle sets decide.

A document is its set of word shingles. Each of SEEDS independent fingerprints is placed under upper nodes by masked
bit patterns, always the same FAMILIES of them whatever the number of documents; two documents under one upper node whose
fingerprints differ in at most NEAR bits are a candidate pair. A pair is linked only if the Jaccard similarity of its shingle
sets is at least THRESHOLD, so no link is false; components are taken of true links.

Candidates come in two rounds. In the first an upper node with few pairs gives all of them; one with many gives stars
around its smallest members. In the second the nodes with stars give each pair that true links have not joined yet, if
the sketches of both sets let it reach the threshold. So documents that are alike, but not so alike, are told apart
inside their node, where a comparison is a few bytes, and hardly a row is made of them.
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
from sugartrace.llm.graysim import BITS, GrayIndex, PIECE, SEED, differing, gray_rank
from sugartrace.session import materialize

THRESHOLD = 0.8
SEEDS = 4
RADIUS = 7  # differing bits up to which two fingerprints always meet under an upper node
NEAR = 11  # differing bits of a candidate; at similarity 0.8 two fingerprints differ in 10 on average, and most pairs meet
SEGMENTS = RADIUS + 2  # an upper node holds two of them
CUTS = [BITS * i // SEGMENTS for i in range(SEGMENTS + 1)]
PARTS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(CUTS, CUTS[1:])]
FAMILIES = list(combinations(range(SEGMENTS), 2))
MASKS = [PARTS[i] | PARTS[j] for i, j in FAMILIES]
BINS = 256  # least hashes in a sketch, four bits of each
LIKELY = 0.735  # share of equal ones from which a pair is compared; at similarity 0.8 it is 0.81 on average, deviation 0.025
PAIRS = 1 << 17  # sketches compared at a time
FEW = 1  # pairs a member up to which an upper node gives all; beyond, sketches tell which are worth a row
SMALL = 64  # members up to which upper nodes are compared side by side
BLOCK = 1 << 20  # comparisons of a larger node at a time
HELD = 200_000  # rows a task holds before it compares the upper nodes it has read whole
BROADCAST_ROWS = 1_000_000


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Hashes of the distinct word shingles of a UTF-8 text in order; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest, count = xxhash.xxh64_intdigest, len(words) - width + 1
    pairs = zip(starts[:count].tolist(), ends[width - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, count))


def prints(values: np.ndarray) -> list[int]:
    """SimHash fingerprints of a set of hashes as signed longs, one for each seed."""
    found = []
    for seed in range(SEEDS):
        ones = np.zeros(BITS, np.int64)
        for begin in range(0, len(values), PIECE):
            x = (values[begin : begin + PIECE] ^ np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            octets = (x ^ (x >> np.uint64(29))).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        found.append(int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.int64)[0]))
    return found


def sketch(values: np.ndarray) -> np.ndarray:
    """Of a sorted set of hashes, four bits (1 to 15) of the least in each of BINS equal ranges, 0 where there is none; as signed longs."""
    bins = (values >> np.uint64(BITS - 8)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    codes = np.zeros(BINS, np.uint8)
    codes[bins[first]] = (values[first] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(15) + np.uint64(1)
    return (codes[::2] << np.uint8(4) | codes[1::2]).view(np.int64)


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches (bytes, a row each) agree in a share of LIKELY of the ranges that are not empty in both."""
    found = np.zeros(len(a), bool)
    for begin in range(0, len(a), PAIRS):
        x, y = a[begin : begin + PAIRS], b[begin : begin + PAIRS]
        equal, used = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for half in (0xF0, 0x0F):
            p, q = x & np.uint8(half), y & np.uint8(half)
            equal += ((p == q) & (p > 0)).sum(1)
            used += (p | q > 0).sum(1)
        found[begin : begin + PAIRS] = equal >= LIKELY * used
    return found


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def owner(bits: np.ndarray) -> np.ndarray:
    """Number of the first family whose mask two fingerprints with these differing bits share, so a pair is given once."""
    found = np.full(len(bits), -1, np.int64)
    for f in range(len(MASKS) - 1, -1, -1):
        found[bits & np.uint64(MASKS[f]) == 0] = f
    return found


def stars(nodes: np.ndarray, fps: np.ndarray, family: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links from the smallest member not reached yet to all others not reached within NEAR bits of it, until none is left.
    Links that another family owns are left to its node, which gives them or, with stars of its own, has them in the second round."""
    order = np.argsort(gray_rank(fps), kind="stable")
    nodes, fps = nodes[order], fps[order]
    index, open_ = GrayIndex(fps), np.ones(len(fps), bool)
    left, right = [], []
    for first in np.argsort(nodes, kind="stable").tolist():
        if not open_[first]:
            continue
        open_[first] = False
        found = index.near(fps[first], NEAR, open_)
        open_[found] = False
        found = found[owner(fps[found] ^ fps[first]) == family]
        left.append(np.full(len(found), nodes[first]))
        right.append(nodes[found])
    return left, right


def across(
    fps: np.ndarray, roots: np.ndarray, family: int, most: int | None = None, sketches: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of all pairs of one upper node within NEAR bits that it owns and whose roots differ; None if over `most`.
    With `sketches`, only pairs that are likely by them."""
    values, inverse, sizes = np.unique(roots, return_inverse=True, return_counts=True)
    none = np.empty(0, np.int64)
    if len(values) == 1:
        return none, none
    # Each pair has a member outside the largest class; that one comes first, of two such the earlier one.
    outside = inverse != np.argmax(sizes)
    rows = np.flatnonzero(outside)
    left, right, many = [none], [none], 0
    step = max(1, BLOCK // len(fps))
    for begin in range(0, len(rows), step):
        some = rows[begin : begin + step]
        a, b = np.nonzero(differing(fps[some][:, None] ^ fps) <= NEAR)
        a = some[a]
        fresh = (inverse[a] != inverse[b]) & (~outside[b] | (a < b))
        a, b = a[fresh], b[fresh]
        own = owner(fps[a] ^ fps[b]) == family
        if sketches is not None:
            a, b = a[own], b[own]
            own = np.concatenate([none > 0, *(likely(sketches[a[i : i + PAIRS]], sketches[b[i : i + PAIRS]]) for i in range(0, len(a), PAIRS))])
        left.append(a[own])
        right.append(b[own])
        many += int(own.sum())
        if most is not None and many > most:
            return None
    return np.concatenate(left), np.concatenate(right)


def first_round(uppers: np.ndarray, families: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (a, b) of whole upper nodes, and the upper nodes that gave stars only. Rows sorted by upper node."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(uppers)) + 1])
    ends = np.append(starts[1:], len(uppers))
    sizes = ends - starts
    group = np.repeat(np.arange(len(starts)), sizes)
    last = ends[group]
    left, right, starred = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    at = np.flatnonzero((sizes <= SMALL)[group])
    firsts, seconds = [], []
    for apart in range(1, SMALL):
        at = at[at + apart < last[at]]
        if not len(at):
            break
        bits = fps[at] ^ fps[at + apart]
        near = np.flatnonzero(differing(bits) <= NEAR)
        near = near[owner(bits[near]) == families[at[near]]]
        firsts.append(at[near])
        seconds.append(at[near] + apart)
    if firsts:
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        many = np.bincount(group[a], minlength=len(starts)) > FEW * sizes
        whole = ~many[group[a]]
        left.append(nodes[a[whole]])
        right.append(nodes[b[whole]])
        crowded = np.flatnonzero(many).tolist()
    else:
        crowded = []
    for g in np.flatnonzero(sizes > SMALL).tolist():
        cut = slice(starts[g], ends[g])
        found = across(fps[cut], np.arange(sizes[g]), int(families[starts[g]]), FEW * int(sizes[g]))
        if found is None:
            crowded.append(g)
        else:
            left.append(nodes[cut][found[0]])
            right.append(nodes[cut][found[1]])
    for g in crowded:
        cut = slice(starts[g], ends[g])
        a, b = stars(nodes[cut], fps[cut], int(families[starts[g]]))
        left += a
        right += b
        starred.append(uppers[starts[g]])
    return np.concatenate(left), np.concatenate(right), np.array(starred, np.int64)


def second_round(
    uppers: np.ndarray, families: np.ndarray, nodes: np.ndarray, fps: np.ndarray, roots: np.ndarray, sketches: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sketches = np.ascontiguousarray(sketches).view(np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(uppers)) + 1])
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(uppers)]):
        x, y = across(fps[a:b], roots[a:b], int(families[a]), sketches=sketches[a:b])
        left.append(nodes[a:b][x])
        right.append(nodes[a:b][y])
    return np.concatenate(left), np.concatenate(right), np.empty(0, np.int64)


def by_upper(tree: DataFrame, compare, columns: list[str]) -> DataFrame:
    """(a, b, upper): candidates, and rows with only `upper` for nodes that gave stars."""
    small_batches(tree.sparkSession, 20_000)
    tree = tree.select(*columns).repartition("upper").sortWithinPartitions("upper", "node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def found(parts: list[np.ndarray]) -> pa.RecordBatch:
            parts[3] = parts[3].view(np.uint64)
            a, b, starred = compare(*parts)
            empty, none = pa.nulls(len(starred), pa.int64()), pa.nulls(len(a), pa.int64())
            low, high = np.minimum(a, b), np.maximum(a, b)
            arrays = [pa.concat_arrays([pa.array(low), empty]), pa.concat_arrays([pa.array(high), empty]), pa.concat_arrays([none, pa.array(starred)])]
            return pa.RecordBatch.from_arrays(arrays, ["a", "b", "upper"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # A list column holds as many values in each row.
            held.append([c.flatten().to_numpy().reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy() for c in batch.columns])
            count += batch.num_rows
            if count >= HELD and held[0][0][0] != held[-1][0][-1]:
                parts = [np.concatenate(c) for c in zip(*held)]
                end = int(np.flatnonzero(parts[0] != parts[0][-1])[-1]) + 1  # the last node may go on
                yield found([p[:end] for p in parts])
                held, count = [[p[end:].copy() for p in parts]], len(parts[0]) - end
        if held:
            yield found([np.concatenate(c) for c in zip(*held)])

    return tree.mapInArrow(join, "a long, b long, upper long")


def patterns(known: DataFrame) -> DataFrame:
    """(upper, family, node, fp, and other columns but fps) of documents (node, fps)."""
    signed = [int(np.array(m, np.uint64).view(np.int64)) for m in MASKS]
    others = [c for c in known.columns if c != "fps"]
    each = known.select(*others, F.posexplode("fps").alias("seed", "fp"))
    masked = F.array(*[F.struct(F.lit(f).cast("long").alias("family"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for f, m in enumerate(signed)])
    each = each.select(*others, "seed", "fp", F.explode(masked).alias("p"))
    return each.select(*others, "fp", F.col("p.family").alias("family"), F.xxhash64("seed", "p.family", "p.bits").alias("upper"))


def true_links(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are at least THRESHOLD similar; `texts` (node, text)."""
    small_batches(pairs.sparkSession, 200)
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = materialize(texts.join(used, "node", "left_semi"))
    both = pairs.join(texts.toDF("a", "mine"), "a").join(texts.toDF("b", "theirs"), "b").select("a", "b", "mine", "theirs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            mine, theirs = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            known: dict[int, np.ndarray] = {}  # of this batch
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
                for node, text in ((x, mine[i]), (y, theirs[i])):
                    if node not in known:
                        known[node] = shingle_set(text, size)
                keep[i] = jaccard(known[x], known[y]) >= THRESHOLD
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return materialize(both.mapInArrow(verify, "a long, b long"))


def with_roots(known: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links)
    return known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_classes(docs: DataFrame, size: int = 5) -> DataFrame:
    """(key, component_id) for each row of `docs` (key, text); component_id is the smallest key of its component.

    Documents with one set of shingles are one node; blank texts have the empty set and are one node too.
    """
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            fps = pa.array([prints(s) for s in sets], pa.list_(pa.int64()))
            sketches = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), fps, sketches], ["key", "node", "fps", "sketch"])

    columns = docs.select("key", "text")
    rows = materialize(columns.mapInArrow(score, f"key {columns.schema[0].dataType.simpleString()}, node long, fps array<long>, sketch array<long>"))
    firsts = [F.first(c).alias(c) for c in ("fps", "sketch")]  # equal within a node
    known = materialize(rows.groupBy("node").agg(F.min("key").alias("low"), *firsts))
    prints_ = known.select("node", "fps")
    found = materialize(by_upper(patterns(prints_), first_round, ["upper", "family", "node", "fp"]))
    pairs = materialize(found.where("a is not null").select("a", "b").distinct())
    key = F.struct(*[F.coalesce(F.col(f"low.{c}").cast("string"), F.lit("-")) for c in columns.schema[0].dataType.names])
    own = F.struct(*[F.coalesce(F.col(f"key.{c}").cast("string"), F.lit("-")) for c in columns.schema[0].dataType.names])
    lows = known.select("node", F.xxhash64(key).alias("_k"), "low")
    # By hash, then by the key itself, which may hold nulls.
    texts = columns.withColumn("_k", F.xxhash64(own)).join(lows, "_k").where(F.col("key").eqNullSafe(F.col("low")))
    texts = texts.select("node", "text").dropDuplicates(["node"])
    links = true_links(pairs, texts, size)
    starred = materialize(found.where("upper is not null").select("upper").distinct())
    count = starred.count()
    if count:
        reached = materialize(with_roots(known.select("node", "fps", "sketch"), links))
        again = patterns(reached).join(F.broadcast(starred) if count <= BROADCAST_ROWS else starred, "upper", "left_semi")
        more = by_upper(again, second_round, ["upper", "family", "node", "fp", "root", "sketch"]).select("a", "b").distinct()
        more = materialize(more.join(pairs, ["a", "b"], "left_anti"))
        links = links.union(true_links(more, texts, size))
    joined = materialize(with_roots(known.select("node", "low"), links))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.select("key", "node").join(joined.join(lowest, "root").select("node", "component_id"), "node").select("key", "component_id")


def one_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """`docs` with one row of each component: the smallest doc_id (null before any), then the smallest hash of the text.

    Equal rows are one group, so one stays. Other columns come along unchanged.
    """
    text_key = F.xxhash64("text")
    keyed = docs.select(F.struct("doc_id", text_key.alias("text_key")).alias("key"), "text")
    classes = materialize(near_classes(keyed, size))
    keys = classes.groupBy("key", "component_id").agg(F.count("*").alias("rows"))
    keys = keys.select(
        F.col("key.doc_id").alias("_id"), F.col("key.text_key").alias("_key"), "rows", (F.col("key") == F.col("component_id")).alias("first")
    )
    keys = materialize(keys.where("not first or rows > 1"))
    small = keys.count() <= BROADCAST_ROWS
    bound = lambda df: F.broadcast(df) if small else df
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key == F.col("_key"))
    single = docs.join(bound(keys), own, "left_anti")
    repeated = docs.join(bound(keys.where("first")), own, "left_semi")
    repeated = repeated.withColumn("_key", text_key).dropDuplicates(["doc_id", "_key"]).drop("_key")
    return single.unionByName(repeated)
