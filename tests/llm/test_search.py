"""SimHash components, pivot search and token files against plain versions."""

import zlib

import numpy as np
import xxhash
from tokenizers import Tokenizer

from sugartrace.llm import graysim, pivots, repair
from sugartrace.session import scratch_path

TEXT = "doc_id long, text string, _row string, fp long"


def plain_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_links_connect_what_is_near():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([centres] + [centres ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(8)])
    near = np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    near = near[np.argsort(graysim.gray_rank(near))]
    a, b = graysim.links_of(np.zeros(len(near), np.int64), near, 3)
    place = {int(v): i for i, v in enumerate(near)}
    root = list(range(len(near)))
    for x, y in zip(a, b):
        p, q = root[place[int(x)]], root[place[int(y)]]
        root = [min(p, q) if r in (p, q) else r for r in root]
    assert root == plain_components([int(v) for v in near])


def test_components(spark):
    rng = np.random.default_rng(0)
    base = [" ".join(f"w{i}" for i in rng.integers(0, 500, 300)) for _ in range(12)]
    texts = base + [t.replace("w7 ", "w8 ", 1) for t in base] + [base[0]] * 20 + [t + " tail" for t in base]
    texts += [None, "", "  ", "one", "ONE", "two words", "ÀB c", "àB c", "x\x0by\x1cz", "w1 " * 30_000]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(5, texts[5], "c", 1)]
    got = graysim.component_rows(spark.createDataFrame(rows, TEXT).repartition(4)).collect()
    fps = [plain_fingerprint(t, 3) for t in texts]
    roots = plain_components(fps)
    expected = sorted((i, format(fps[i], "016x"), roots[i]) for i in [*range(len(texts)), 5])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected


def test_components_of_nothing_and_of_null_ids(spark):
    assert graysim.component_rows(spark.createDataFrame([], TEXT)).collect() == []
    got = graysim.component_rows(spark.createDataFrame([(None, "a b c", "c", 1), (4, "a b c", "c", 1)], TEXT)).collect()
    assert [r.component_id for r in got] == [4, 4]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(np.float32(x)) for x in rng.normal(size=8)] for _ in range(600)]
    vectors[200:500] = [vectors[0]] * 300  # a vector that half of all rows share
    rows = [(i, v, "c") for i, v in enumerate(vectors)]
    odd = [(1000, None, "c"), (1100, [1.0, None] + [0.0] * 6, "c"), (1200, [float("nan")] * 8, "c"), (1300, [float("inf")] * 8, "c"), (None, vectors[1], "c")]
    odd += [(1400, [1.0, 2.0], "c"), (1401, [3.0, 0.5], "c"), (1500, [], "c"), (1600, [1e6] * 8, "c")]
    got = pivots.hundredths(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string").repartition(5)).collect()
    valid = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows + odd[5:]]
    expected = []
    for q, x in valid:
        if q % 100 == 0:
            scores = sorted((-int(x @ y), i) for i, y in valid if i != q and len(y) == len(x))[:10]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_top_k_of_nothing(spark):
    assert pivots.hundredths(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_big_products_stay_exact():
    a = np.array([[1 << 31, 1, 0], [3, 4, 5]], np.int64)
    assert (pivots.product(a, a) == [[(1 << 62) + 1, 3 * (1 << 31) + 4], [3 * (1 << 31) + 4, 50]]).all()


def test_token_files(spark):
    texts = ["Ein Wort, und noch EIN Wort.", None, "", "ΑΣ x́ <|endoftext|> word.'s a,, b.", "lorem ipsum dolor sit amet " * 4000, "日本語 テスト 12,3 ½", " \n\t "]
    rows = [(7 * i % 5, t, "c", 1) for i, t in enumerate(texts)] + [(None, "null id", "c", 1), (3, texts[0], "c", 1), (3, texts[0], "c", 1)]
    docs = spark.createDataFrame(rows, TEXT).repartition(3)
    got = sorted(repair.round_trip(docs).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(repair.vocabulary())
    ids = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    expected = sorted((str(k), len(ids(t)), zlib.crc32(ids(t).tobytes())) for k, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == expected
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert repair.round_trip(docs.limit(0)).count() == 0


def test_random_access(spark):
    rng = np.random.default_rng(2)
    documents = [np.append(np.repeat(rng.integers(3, 9, n // 2), 2), 2).astype("<u4") for n in (1, 400, 0, 5000, 30)]
    block = repair.Block(repair.pack([d.tobytes() for d in documents], 49408))
    whole = np.concatenate(documents)
    assert len(block.rules) and len(block.symbols) < len(whole)
    assert (block.documents()[0] == whole).all()
    for begin, end in ((0, 1), (399, 1200), (len(whole) - 3, len(whole)), (5, 6)):
        assert (block.read(begin, end) == whole[begin:end]).all()


def test_files_hold_the_grammar(spark):
    docs = spark.createDataFrame([(1, "again and again " * 500, "c", 1)], TEXT)
    path = scratch_path(spark, "tokens")
    repair.write(docs, path)
    row = spark.read.parquet(path).first()
    assert bytes(row.payload[:4]) == b"RPR1" and len(row.payload) < 2 * row.n_tokens


ODD = ["a", "B", "é", "e", "\u0301", "\u0307", "\u0130", "I", "\u0958", "\u095c", "\u095f", "\u0915", "\u093c", "\u0905", "\ufb1d", "\ufb2a"]
ODD += ["\u05e9", "\u05c1", "ß", "ſ", "ﬁ", "Å", "\u212b", "\u1e9b", "\u0344", "漢", "ก", "ำ", "한", "ᄒ", "ᅡ", "ᆫ", "x", "1", "_"]
ODD += [" ", "  ", "\n", "\t", "\u00a0", "\u2028", "\x0b", ",", ".", "!", "'", "</w>", "<unk>", "😀", "\u200d", "\ufe0f"]


def test_ids_are_those_of_the_tokenizer():
    rng, tokenizer = np.random.default_rng(8), Tokenizer.from_file(repair.vocabulary())
    texts = ["".join(ODD[i] for i in rng.integers(0, len(ODD), rng.integers(0, 14))) for _ in range(20_000)]
    texts += [stem + mark for stem in (*ODD, *(a + b for a in ODD for b in ODD)) for mark in (",", ".", ",.", " ,")]
    texts += ["İ,", "BİLGİSİ,", "अकड़,", "שיִ.", None, ""]
    got = repair.encode(texts, repair.vocabulary())
    plain = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    wrong = [t for t, ids, p in zip(texts, got, plain) if ids != np.array(p.ids, "<u4").tobytes()]
    assert not wrong, wrong[:10]


def test_pieces_that_come_again_stay_known(monkeypatch):
    tokenizer, learnt, learn = Tokenizer.from_file(repair.vocabulary()), [], repair.learn
    monkeypatch.setattr(repair, "CACHED", 40)
    monkeypatch.setattr(repair, "learn", lambda pieces, path: (learnt.extend(pieces), learn(pieces, path)))
    monkeypatch.setattr(repair, "_tokenizers", {})  # nothing is known yet
    for i in range(30):
        texts = [f"commonly Said%%% w{i}a WORD{'abcdefghij'[i % 10] * (i + 1)}!? é{'xyz'[i % 3] * i}́.( {'q' * i}'s,", f"ſ{i}) İ,;"]
        expected = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert repair.encode(texts, repair.vocabulary()) == expected
    assert learnt.count("commonly") == 1 and learnt.count("Said%%%") == 1


def test_marks_after_a_word_are_those_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(repair.vocabulary())
    marks = ["!", "?!", "%%%", "'", "''", "'s", ".'", "</w>", "<", "=>", "_", "__", "~`", ")\".", "<|", "̸", "≠"]
    texts = [stem + mark for stem in (*ODD, *(a + b for a in ODD for b in ODD)) for mark in marks]
    got = repair.encode(texts, repair.vocabulary())
    plain = tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, ids, p in zip(texts, got, plain) if ids != np.array(p.ids, "<u4").tobytes()]
    assert not wrong, wrong[:10]
