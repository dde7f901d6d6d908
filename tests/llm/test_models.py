"""The line field and the recurrent network: exact sums, gradients, accuracy, odd input."""

import itertools
import zlib

import numpy as np

from sugartrace.llm import crf, toxicity


def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 4])
    evidence, ties = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs = crf.marginals(evidence, counts, ties)
    expected, moved, at = [], np.zeros((2, 2)), 0
    for n in counts:
        total, ones, seen = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            score = sum(evidence[at + i] for i in range(n) if labels[i]) + sum(ties[a, b] for a, b in zip(labels, labels[1:]))
            weight = np.exp(score)
            total += weight
            ones += weight * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                seen[a, b] += weight
        expected += (ones / total).tolist()
        moved += seen / total
        at += n
    assert np.allclose(good, expected) and np.allclose(pairs, moved)


def test_features_do_not_depend_on_slices(monkeypatch):
    texts = ["One line.\nTwo !! LINES ###\n\nend", "", "x" * 500]
    whole = crf.line_features(texts)
    monkeypatch.setattr(crf, "SLICE", 7)
    for a, b in zip(whole, crf.line_features(texts)):
        assert np.allclose(a, b)


def sentences(rng, loud):
    words = [f"{'abcdefghij'[i]}{'klmnop'[i % 6]}st" for i in rng.integers(0, 10, 40)]
    lines = [" ".join(words[k : k + 8]) for k in range(0, 40, 8)]
    return "\n".join((x.upper().replace(" ", "!! ") if loud else x.capitalize() + ".") for x in lines)


def test_quality_is_learnt(spark):
    rng = np.random.default_rng(1)
    rows = [(i, sentences(rng, i % 3 == 0), "s", i % 3 != 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t, s, 0.5) for i, t, s, _ in rows] + [(900, None, None, None), (None, "", "s", 1.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(y), 0) for i, _, _, y in rows] + [(900, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in crf.quality_rows(docs, labels).collect()}
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got.values())
    out = [(got[i].predicted == y) for i, _, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(out) == 1.0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    nothing = crf.quality_rows(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}
    assert crf.quality_rows(docs.limit(0), labels).count() == 0


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 48, 100, 1000):
        starts = toxicity.windows_of(n)
        covered = set().union(*[range(s, s + toxicity.WINDOW) for s in starts.tolist()])
        assert set(range(n)) <= covered and max(starts) <= max(0, n - toxicity.WINDOW)
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_gradients():
    rng = np.random.default_rng(4)
    network = toxicity.Network([b"abc", b"xyz"])
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    ids, real = rng.integers(0, 5, (3, toxicity.WINDOW)), np.ones((3, toxicity.WINDOW), bool)
    real[1, 20:] = False
    vectors = rng.normal(size=(5, toxicity.WORD + toxicity.CHAR))
    target = rng.normal(size=3)

    def loss():
        logit = network.run({w: network.gates(vectors, w) for w in "fb"}, ids, real)
        return ((logit - target) ** 2).sum() / 2

    logit, *kept = network.run({w: network.gates(vectors, w) for w in "fb"}, ids, real, keep=True)
    grads, d_vectors = network.back(logit - target, ids, real, vectors, *kept)
    for values, gradient in [*((network.weights[k], g) for k, g in grads.items()), (vectors, d_vectors)]:
        for at in [tuple(rng.integers(0, s) for s in values.shape) for _ in range(4)]:
            step = np.zeros_like(values)
            step[at] = 1e-3
            values += step
            up = loss()
            values -= 2 * step
            down = loss()
            values += step
            assert abs((up - down) / 2e-3 - gradient[at]) < 1e-3 * (1 + abs(gradient[at]))


def test_toxicity_is_learnt(spark):
    rng = np.random.default_rng(5)
    plain = [f"{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}{'uvw'[i % 3]}t" for i in range(60)]

    def text(bad, size=90):
        words = [plain[i] for i in rng.integers(0, 60, size)]
        for at in rng.integers(0, size, 4 if bad else 0):
            words[at] = ["rotten", "foul"][rng.integers(0, 2)]
        return " ".join(words)

    rows = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, None), (901, text(False, 3000) + " foul rotten foul", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_rows(docs, labels).collect()}
    held = [got[i].predicted == y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.95 and got[900].predicted == 0 and got[901].predicted == 1
    assert len(got) == 402
    assert toxicity.toxicity_rows(docs.limit(0), labels.limit(0)).count() == 0


def test_scores_do_not_depend_on_what_was_kept(monkeypatch):
    network = toxicity.Network([b"abc"])
    texts = ["abc def " * 40, "", "one two three", "é ü"]
    whole = toxicity.Scorer(network).scores(texts)
    monkeypatch.setattr(toxicity, "KNOWN", 0)
    scorer = toxicity.Scorer(network)
    assert np.allclose(np.concatenate([scorer.scores([t]) for t in texts]), whole, atol=1e-6)
