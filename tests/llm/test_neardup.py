"""The near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import numpy as np
import pytest

import corpus_pipeline
from sugartrace.llm import neardup


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted(rows[i][0] for i in set(root))


def edited(rng, words, edits):
    out = list(words)
    for place in rng.choice(len(words), edits, replace=False):
        out[place] = f"e{rng.integers(1 << 40)}"
    return " ".join(out)


def documents(rng):
    rows = []
    for n, edits in ((60, 1), (300, 6), (300, 7), (300, 8), (300, 5)):
        for _ in range(25):
            words = [f"w{k}" for k in rng.integers(0, 100_000, n)]
            rows += [" ".join(words), edited(rng, words, edits), edited(rng, words, edits)]
    centre = [f"c{k}" for k in rng.integers(0, 100_000, 400)]
    rows += [edited(rng, centre, int(rng.integers(3, 12))) for _ in range(150)]  # one crowded group, many pairs below 0.8
    rows += ["", "  ", "a b", "A b", "a c", rows[0].upper()]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small", [64, 8])
def test_near_dedup_is_brute_force_similarity(spark, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", small)
    rows = documents(np.random.default_rng(small))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    expected = plain_kept(rows)
    assert set(expected) <= set(kept)  # no false link
    assert len(rows) - len(kept) >= 0.98 * (len(rows) - len(expected))


def test_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    found = 0
    for _ in range(1000):
        x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        cut = rng.integers(0, 61)
        a, b = (np.array(neardup.prints(np.unique(s))).view(np.uint64) for s in (x[: 240 + cut], np.concatenate([x[:240], x[240 + cut :]])))
        found += bool(((np.bitwise_count(a ^ b) <= neardup.NEAR) & (neardup.owner(a ^ b) >= 0)).any())
    assert found >= 980


def sketches_at(rng, similar, size, count):
    """Sketches of drawn pairs of sets with that Jaccard similarity and `size` members in all."""
    both = round(similar * size)
    for _ in range(count):
        x = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        cut = both + rng.integers(0, size - both + 1)
        yield [neardup.sketch(np.unique(s)).view(np.uint8) for s in (x[:cut], np.concatenate([x[:both], x[cut:]]))]


@pytest.mark.parametrize("size", [10, 40, 300, 3000])
def test_sketches_keep_pairs_at_the_threshold_and_leave_others(size):
    rng = np.random.default_rng(size)
    share = {}
    for similar in (0.8, 0.6):
        a, b = (np.stack(x) for x in zip(*sketches_at(rng, similar, size, 1000)))
        share[similar] = neardup.likely(a, b).mean()
    assert share[0.8] >= 0.995 and share[0.6] <= 0.02
    none = neardup.sketch(np.empty(0, np.uint64)).view(np.uint8)[None]
    assert neardup.likely(none, none)[0]


def test_second_round_gives_each_pair_the_links_left_apart():
    rng = np.random.default_rng(7)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(57, rng.integers(0, 9), replace=False) + 7)) for _ in range(90)], np.uint64)
    nodes, roots = rng.permutation(90).astype(np.int64), np.repeat([3, 4, 5], [60, 20, 10])
    got = set()
    for f, mask in enumerate(neardup.MASKS):
        for value in np.unique(fps & np.uint64(mask)):
            at = np.flatnonzero(fps & np.uint64(mask) == value)
            same = np.ones((len(at), neardup.BINS // 16), np.int64)  # sketches that leave no pair out
            a, b, _ = neardup.second_round(np.zeros(len(at), np.int64), np.full(len(at), f), nodes[at], fps[at], roots[at], same)
            pairs = [tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())]
            assert not got & set(pairs) and len(pairs) == len(set(pairs))
            got |= set(pairs)
    d = np.bitwise_count(fps[:, None] ^ fps)
    expected = {tuple(sorted((int(nodes[i]), int(nodes[j])))) for i in range(90) for j in range(i) if roots[i] != roots[j] and d[i, j] <= neardup.NEAR and neardup.owner(fps[[i]] ^ fps[j])[0] >= 0}
    assert got == expected


def test_near_dedup_of_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == plain_kept([(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()])
