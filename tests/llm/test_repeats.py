"""Repeated spans, passages, lines, benchmark passages and the mix against plain versions."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from sugartrace.llm import compact, decontam, mixing, runindex, templates
from sugartrace.session import materialize

TEXT = "doc_id long, text string, source string, anchor string, row_key long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "c", 1) for i, t, s in rows], TEXT).repartition(3)


def plain_spans(rows, span=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - span + 1):
                s = t[k : k + span]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - span + 1) if i is not None else ():
            if first[t[k : k + span]] < i:
                gone[k : k + span] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("piece", [1 << 20, 400])
def test_spans(spark, piece, monkeypatch):
    if piece != 1 << 20:
        monkeypatch.setattr(runindex, "PIECE", piece)
        monkeypatch.setattr(runindex, "_tables", {})
    rng = np.random.default_rng(piece)
    parts = ["".join(rng.choice(list("abcdé "), 70)) for _ in range(6)] + ["ab" * 60, "z" * 130]
    rows = []
    for i in range(60):
        picks = [parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 6))]
        cut = "".join(p[rng.integers(0, 30) : len(p) - rng.integers(0, 25)] + "".join(rng.choice(list("xy"), rng.integers(0, 4))) for p in picks)
        rows.append((int(rng.integers(0, 50)), cut, "s"))
    rows += [(100, None, None), (101, "", "s"), (None, parts[0] * 2, "s"), (102, rows[3][1], "s"), (102, rows[3][1], "s"), (102, parts[0] + "q" + parts[1], "s")]
    got = [tuple(r) for r in runindex.span_rows(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(plain_spans(rows), key=repr)


def test_spans_of_nothing(spark):
    assert runindex.span_rows(frame(spark, [(1, "x", "s")]).limit(0)).collect() == []


def test_matching_statistics():
    rng = np.random.default_rng(8)
    rows = [rng.integers(1, 4, rng.integers(1, 20)) for _ in range(30)]
    index = runindex.RunIndex(np.concatenate([x for r in rows for x in (r, [0])]), 20)
    assert len(index.starts) < len(index.text)
    patterns = np.full((25, 30), -1, np.int64)
    for p in patterns:
        n = rng.integers(1, 30)
        p[30 - n :] = rng.integers(1, 5, n)
    got = index.statistics(patterns)
    strings = {tuple(r[i:j].tolist()) for r in rows for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    for p, line in zip(patterns, got):
        for i in np.flatnonzero(p >= 0):
            own = p[i:].tolist()
            assert line[i] == max([0, *(n for n in range(1, len(own) + 1) if tuple(own[:n]) in strings)])


def test_compact_windows_are_large_nodes_of_the_tree():
    rng = np.random.default_rng(9)
    sizes = [45, 46, 300, 1, 700]
    values = np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in sizes])
    values[100:110] = values[100]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    expected = set()

    def split(d, a, b):
        if b - a + 1 >= compact.LEAST:
            c = a + int(np.argmin(values[a : b + 1] >> np.uint64(32)))
            expected.add((d, c, a, b))
            split(d, a, c - 1)
            split(d, c + 1, b)

    for d, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        split(d, a, b - 1)
    assert {tuple(int(x) for x in row) for row in zip(*compact.windows(values, starts, ends))} == expected


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 100_000, n)]


def test_passages(spark):
    rng = np.random.default_rng(10)
    passage, long_one = words(rng, 60), words(rng, 400)
    edited = long_one.copy()
    edited[::97] = words(rng, len(edited[::97]))
    rows = [(i, " ".join(words(rng, 120) + passage + words(rng, 80)), "s") for i in range(5)]
    rows += [(10, " ".join(words(rng, 30) + long_one), "s"), (11, " ".join(edited + words(rng, 50)), "s")]
    clean = [(20 + i, " ".join(words(rng, 300)), "s") for i in range(5)]
    rows += clean + [(30, rows[0][1], "s"), (31, " ".join(passage[:30]), "s"), (40, None, None), (41, "", "s"), (None, rows[0][1], "s")]
    got = compact.passage_rows(frame(spark, rows)).collect()
    assert {(r.doc_id, r.of_doc_id) for r in got} == {(i, 0) for i in (1, 2, 3, 4, 30)} | {(11, 10)}
    same = [(50, "the " * 300, "s"), (51, "the " * 200, "s"), (52, "one two three " * 90 + "end", "s"), (53, "two three one " * 70, "s")]
    over = {(r.doc_id, r.of_doc_id) for r in compact.passage_rows(frame(spark, same)).collect()}
    assert over == {(51, 50), (53, 52)}
    for r in got:
        if r.doc_id in (1, 2, 3, 4):
            assert (r.begin, r.end, r.of_begin, r.of_end) == (120, 180, 120, 180) and r.similarity == 1.0
        assert r.similarity >= 0.8 and r.end - r.begin >= 50
    kept = {r.doc_id: r.text for r in compact.drop_passages(frame(spark, rows)).collect()}
    assert all(kept[i] == t for i, t, _ in clean) and len(kept[1].split()) == 200 and kept[30] == ""
    assert compact.passage_rows(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("rounds", [1, None])
def test_a_smaller_document_with_an_edited_copy_hides_no_exact_passage(spark, rounds):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        passage = words(rng, 60)
        edited = [w if k % 18 else f"new{k}" for k, w in enumerate(passage)]
        rows += [(n + i, " ".join(words(rng, 50) + p + words(rng, 50)), "s") for n, p in ((0, edited), (100, passage), (200, passage))]
    docs = frame(spark, rows).select("doc_id", "text")
    got = {(r.doc_id, r.of_doc_id, r.begin, r.end) for r in compact.repeated_passages(docs, rounds).collect()}
    assert {(200 + i, 100 + i, 50, 110) for i in range(60)} <= got


def test_no_number_of_smaller_documents_hides_a_passage(spark):
    rng = np.random.default_rng(7)
    rows = []
    for f in range(0, 120, 10):
        # All of a family have 44 words in common, too few for a passage; the last two have 50, and the first of them has the 44 twice.
        line, ahead, after = words(rng, 44), words(rng, 3), words(rng, 3)
        rows += [(f + i, " ".join(words(rng, 40) + line + words(rng, 40)), "s") for i in range(6)]
        rows += [(f + 6, " ".join(line + words(rng, 40) + ahead + line + after + words(rng, 40)), "s")]
        rows += [(f + 7, " ".join(words(rng, 40) + ahead + line + after + words(rng, 40)), "s")]
    got = {(r.doc_id, r.of_doc_id, r.begin, r.end) for r in compact.repeated_passages(frame(spark, rows).select("doc_id", "text")).collect()}
    assert got == {(f + 7, f + 6, 40, 90) for f in range(0, 120, 10)}


def test_regions_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(6)
    for _ in range(200):
        pairs = np.sort(rng.integers(0, 9, rng.integers(1, 70)))
        begin = rng.integers(0, 100, len(pairs))
        hits = np.stack([rng.integers(0, 6, len(pairs)), begin, begin + rng.integers(0, 120, len(pairs)), rng.choice([0, 30, 60, 400, -50], len(pairs))], 1)
        expected = set()
        for pair in set(pairs.tolist()):
            own = hits[pairs == pair]
            own = own[np.argsort(own[:, 3])]
            for some in np.split(own, np.flatnonzero(np.diff(own[:, 3]) > compact.LEAST) + 1):
                covered = np.array([len({k for k, a, b, _ in some.tolist() if a <= x <= b}) for x in range(230)]) >= compact.ENOUGH
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    if b - a >= compact.LEAST - compact.SLACK:
                        expected.add((pair, max(0, a - compact.SLACK), b + compact.SLACK))
        assert set(zip(*(x.tolist() for x in compact.regions(pairs, hits)))) == expected


def test_lines(spark):
    rows = [(i, f"Job {i} done after {i * 7} s\nUnique line number {'abcdefgh'[i]} of this text\n\nCopyright owner {'xyz'[i % 3]} all rights reserved", "s") for i in range(8)]
    rows += [(20, None, None), (21, "", "s"), (22, "Unique words only here", "s"), (22, "Unique words only here", "s"), (None, "Job 5 done after 9 s", "s")]
    out = templates.drop_recurring(frame(spark, rows))
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == len(rows)
    # The owner is the third token, where the tree still tells lines apart, and three documents are too few.
    kept = got[3, "\nCopyright owner x all rights reserved"]
    assert kept.n_dropped == 2 and kept.n_lines == 4
    assert got[20, None].n_lines == 0 and got[21, ""].n_dropped == 0 and got[None, ""].n_dropped == 1
    assert got[22, "Unique words only here"].n_dropped == 0
    assert templates.drop_recurring(frame(spark, rows).limit(0)).count() == 0


def test_lines_take_texts_once(spark, tmp_path, monkeypatch):
    rows = [(i, f"Job {i} done after {i * 7} s\n{'abcdefgh'[i]} line of its own\nAll rights reserved", "s") for i in range(8)]
    frame(spark, rows + rows[:2]).write.parquet(f"{tmp_path}/docs")
    docs, reads = spark.read.parquet(f"{tmp_path}/docs"), []

    def noted(df):
        reads.append(any(f"{tmp_path}/docs" in file for file in df.inputFiles()))
        return materialize(df)

    monkeypatch.setattr(templates, "materialize", noted)
    got = sorted(map(tuple, templates.line_rows(docs).collect()))
    assert reads.count(True) == 1  # no join but the last one meets texts
    assert len(got) == 10 and all(r[1:3] == (3, 2) for r in got)
    monkeypatch.setattr(templates, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, templates.line_rows(docs).collect())) == got



def test_benchmark_passages(spark):
    rng = np.random.default_rng(11)
    items = [words(rng, n) for n in (30, 60, 7, 3)]
    edited = items[1].copy()
    edited[30] = "changed"
    rows = [
        (1, " ".join(words(rng, 40) + items[0] + words(rng, 9)), "s"),
        (2, " ".join(words(rng, 400) + edited).upper(), "s"),
        (3, " ".join(words(rng, 500)), "s"),
        (4, " ".join(items[0][:15] + words(rng, 15)), "s"),
        (5, ", ".join(items[2]), "s"),
        (6, " ".join(items[3]), "s"),
        (7, None, None),
        (8, "", "s"),
        (1, " ".join(words(rng, 40)), "s"),
        (None, " ".join(items[0]), "s"),
    ]
    bench = spark.createDataFrame([(i, " ".join(x), "c") for i, x in enumerate(items)] + [(9, None, "c"), (0, " ".join(items[0]), "c")], "item_id long, text string, h string")
    got = sorted(((r.doc_id, r.item_id, r.start, round(r.similarity, 3)) for r in decontam.leak_rows(frame(spark, rows), bench).collect()), key=repr)
    assert got == sorted([(1, 0, 40, 1.0), (2, 1, 400, round(51 / 61, 3)), (5, 2, 0, 1.0), (None, 0, 0, 1.0), (6, 3, 0, 1.0)], key=repr)
    kept = decontam.clean(frame(spark, rows), bench).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == [1, 3, 4, 7, 8] and len(kept[0]) == 5
    assert decontam.leak_rows(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontam.leak_rows(frame(spark, rows).limit(0), bench).count() == 0


def test_mix(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["a", "b", "c", "d", None][min(4, int(rng.exponential(1)))]) for i in range(600)]
    rows += [(700, None, "a"), (701, "  ", "empty"), (702, "x y", "b"), (702, "x y", "b"), (None, "q", "b")]
    got = mixing.mixed_words(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    total, taken, target = defaultdict(int), defaultdict(int), {}
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r.taken <= 3 * r["size"]
        total[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert abs(sum(target.values()) - sum(total.values())) < 1e-6
    for s in total:
        assert abs(taken[s] - target[s]) <= 80 and target[s] <= 3 * total[s]
    assert sum(taken.values()) <= sum(total.values())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed_words(frame(spark, rows)).collect()), key=repr)
    assert mixing.mixed_words(frame(spark, rows).limit(0)).count() == 0
    whole = mixing.mixed_documents(frame(spark, rows))
    assert whole.columns == TEXT.replace(" long", "").replace(" string", "").split(", ")
    assert sum(len((r.text or "").split()) for r in whole.collect()) == sum(taken.values())


def test_windows_meet_in_one_shuffle(table, monkeypatch):
    plans = []
    monkeypatch.setattr(compact, "materialize", lambda df, *path: plans.append(df) or materialize(df, *path))
    words = [f"w{i}" for i in range(200)]
    docs = [(9, " ".join(words)), (4, " ".join(words[20:150] + ["other"])), (6, " ".join(f"x{i}" for i in range(120)))]
    found = compact.repeated_passages(table(docs, "doc_id long, text string"), rounds=0).collect()
    assert {(r.doc_id, r.of_doc_id) for r in found} == {(9, 4)}
    hits = next(df for df in plans if "around" in df.columns)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # texts are windowed once
    firsts = {(r.sign, r.first.doc_id) for r in hits.select("sign", "first").collect()}
    assert firsts and {doc for _, doc in firsts} == {4} and len(firsts) == len({sign for sign, _ in firsts})
