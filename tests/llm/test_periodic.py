"""Runs against all periods tried one by one."""

import hashlib
import zlib

import numpy as np
import pytest

from sugartrace.llm import periodic


def plain_runs(words):
    """(start, end, period) of all runs of a list of words, by start, then period."""
    words, found = np.asarray(words), {}
    for period in range(1, len(words) // 3 + 1):
        same = np.concatenate([[0], words[:-period] == words[period:], [0]]).astype(int)
        change = np.diff(same)
        for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
            if b - a + period >= max(24, 3 * period):
                found.setdefault((a, b + period), period)
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def some_document(rng, earlier):
    parts = []
    for _ in range(rng.integers(0, 6)):
        kind, letters = rng.integers(0, 6), rng.integers(1, 6)
        if kind == 0:
            parts += rng.integers(0, 50, rng.integers(0, 60)).tolist()
        elif kind == 1:
            parts += np.tile(rng.integers(0, letters, rng.integers(1, 40)), rng.integers(1, 9)).tolist()[: rng.integers(1, 400)]
        elif kind == 2:
            parts += rng.integers(0, 2, rng.integers(0, 200)).tolist()
        elif kind == 3 and earlier:
            parts += earlier[-1]
        elif kind == 4:
            a, b = [0], [0, 1]
            for _ in range(rng.integers(1, 11)):
                a, b = b, b + a
            parts += b
        else:
            parts += (rng.integers(0, letters, rng.integers(1, 6)).tolist() * int(rng.integers(1, 12)) + [9]) * int(rng.integers(1, 6))
    return parts


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_are_found(seed):
    rng = np.random.default_rng(seed)
    count = 0
    for _ in range(60):
        docs = []
        for _ in range(rng.integers(1, 7)):
            docs.append(some_document(rng, docs))
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = list(zip(*(x.tolist() for x in periodic.find_runs(np.array(sum(docs, []), np.int64), starts))))
        expected = [(a + int(s), b + int(s), p) for d, s in zip(docs, starts) for a, b, p in plain_runs(d)]
        assert got == expected
        count += len(got)
    assert count > 100


def test_grammar_spells_the_words():
    rng = np.random.default_rng(1)
    docs = [some_document(rng, []) for _ in range(30)]
    words = np.array(sum(docs, []), np.int64)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    rounds, final = periodic.grammar(words, starts)
    assert len(final) < len(words) // 2 and set(starts[:-1][np.diff(starts) > 0].tolist()) <= set(final.tolist())
    for first, border, end, places, rule in rounds:
        for place, r in zip(places, rule):
            assert np.array_equal(words[place : place + end[r] - first[r]], words[first[r] : end[r]])
            assert first[r] < border[r] < end[r]


@pytest.mark.parametrize("words", [[0] * 300_000, [0, 1, 2] * 100_000, ([0] * 1000 + [1]) * 200, [*range(12), *[5] * 7] * 9000])
def test_long_documents(words):
    words = np.array(words, np.int64)
    begin, end, period = periodic.find_runs(words, np.array([0, len(words)]))
    longest = int(np.argmax(end - begin))
    assert (begin[longest], end[longest]) == (0, len(words))
    assert np.array_equal(words[: -period[longest]], words[period[longest] :])


def plain_row(key, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str("" if key is None else key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = [(a, b - a, p) for a, b, p in plain_runs([code[w] for w in words])]
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    gone = {i for a, length, p in runs for i in range(a + p, a + length)}
    listed = "".join(f"{a},{length},{p}\n" for a, length, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return key, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_rows(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " \x0b ", "one", "a " * 40, "a\x1cb c d " * 30]
    texts += [" ".join(f"w{x}" for x in some_document(rng, [])) for _ in range(150)]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 400, 4000))] * 8
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)] + [(4, texts[4], 7, "x"), (None, "b " * 50, 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, runs string").repartition(6)
    got = periodic.run_rows(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_row(r[0], r[1]) for r in rows), key=repr)
    assert periodic.run_rows(docs.limit(0)).collect() == []


def test_without_planting(spark):
    docs = spark.createDataFrame([(10, "x y " * 20), (11, "x y z " * 2)], "doc_id long, text string")
    rows = {r.doc_id: r for r in periodic.periodic(docs).collect()}
    assert [tuple(r) for r in rows[10].runs] == [(0, 40, 2)] and rows[10].collapsed == "x y"
    assert rows[11].runs == [] and rows[11].collapsed == "x y z x y z"
