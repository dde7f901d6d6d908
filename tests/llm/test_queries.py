"""Registered queries against DuckDB, and the pipeline against a plain version of it."""

import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sugartrace.llm import crf, queries, repair
from sugartrace.llm.common import read

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    theirs = db.sql(queries.SQL[name])
    mine = queries.QUERIES[name](spark, FOLDER)
    order = sorted(mine.columns)
    assert order == sorted(theirs.columns)
    rows = lambda columns, data: sorted((tuple(r[columns.index(c)] for c in order) for r in data), key=repr)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(theirs.columns, theirs.fetchall())


def test_every_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))


def plain_pipeline(spark):
    """The five stages in plain Python over lists; only the fitted field is shared."""
    docs = [(r.doc_id, r.text or "", r.source) for r in read(spark, FOLDER, "documents").collect()]
    items = [r.text for r in read(spark, FOLDER, "benchmark").collect()]
    field = crf.train(read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels"))
    docs = [d for d, s in zip(docs, field.qualities([d[1] for d in docs])) if s >= 0.3]

    def five(text):
        words = text.encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [five(d[1]) for d in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)), key=lambda k: docs[k][0])
                parent[b] = a
    docs = [d for i, d in enumerate(docs) if top(i) == i]

    letters = lambda text: "".join(c if c.isalnum() else " " for c in text.lower()).split()
    runs = lambda words: [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    tests = [runs(letters(t)) for t in items]

    def leaks(text):
        own = runs(letters(text))
        for test in tests:
            if not set(own) & set(test):
                continue
            size = min(len(own), len(test))
            for start in range(len(own) - size + 1):
                window = own[start : start + size]
                shared = sum(min(window.count(x), test.count(x)) for x in set(window))
                if shared / (size + len(test) - shared) >= 0.8:
                    return True
        return False

    docs = [d for d in docs if not leaks(d[1])]

    import hashlib

    sizes = {d[0]: len([w for w in d[1].split() if w]) for d in docs}
    total = defaultdict(int)
    for d in docs:
        total[d[2]] += sizes[d[0]]
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(total))}
    target, free, rest = {}, set(total), float(sum(total.values()))
    while True:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if 3 * total[s] < level * weight[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            rest -= 3 * total[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    copies = []
    for s in total:
        own = [d for d in docs if d[2] == s and sizes[d[0]]]
        for n in range(1, min(3, int(target[s] // total[s]) + 1) + 1):
            done = (n - 1) * total[s]
            for draw, i in sorted((hashlib.md5(f"{d[0]}:{n}".encode()).hexdigest(), d[0]) for d in own):
                done += sizes[i]
                copies.append((done / target[s], s, draw, i))
    taken, budget = [], sum(total.values())
    for _, _, _, i in sorted(copies):
        budget -= sizes[i]
        if budget < 0:
            break
        taken.append(i)

    tokenizer, text = Tokenizer.from_file(repair.vocabulary()), {d[0]: d[1] for d in docs}
    rows, start = [], 0
    for i in sorted(taken):
        ids = np.array(tokenizer.encode(text[i], add_special_tokens=False).ids + [2], "<u4")
        rows.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return rows


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert sorted(tuple(r) for r in rows.collect()) == sorted(plain_pipeline(spark))


def test_stages_keep_columns_and_handle_odd_rows(spark):
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (2, "", "en", None, 0), (3, "x " * 5000, "en", "s", 9)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()
    kept = corpus_pipeline.near_dedup(spark, odd, FOLDER).collect()
    assert len([r for r in kept if r.text == "a b"]) == 1


def test_stages_leave_clashing_columns_alone(spark):
    names = ["_id", "_key", "_row", "_score", "_text", "_time", "_draw", "other.columns", "node", "key", "label", "size", "rank", "fp", "weight"]
    docs = read(spark, FOLDER, "documents").limit(60)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, docs.doc_id * 100 + i)
    plain = {r.doc_id: tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(tuple(r) == plain[r.doc_id] for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 60
