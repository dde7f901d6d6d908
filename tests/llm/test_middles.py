"""Fill-in-middle against units found one by one."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sugartrace.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text):
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c é\U0001f600<PSM>", max_size=40), st.integers(0, 10**6))
def test_transform(text, key):
    assert fim.transform(key, text) == plain(key, text)


def test_long_texts_are_matched_in_stretches():
    for text in ("ab  c\t" * 150_000 + "  ", "x" * 600_000, " " * 300_000, "a " * 130_000, "a " * 125_000 + "b"):
        assert fim.borders(text) == [m.end() for m in UNIT.finditer(text)]


def test_rows(spark):
    texts = [None, "", " ", "one", "a <S> b", "<", "<S", "M> <P", "x y z " * 30_000]
    texts += [f"w{i} <<  S> p{i} >\n q" * (i % 7 + 1) for i in range(60)]
    rows = [(i, t, 0, "o") for i, t in enumerate(texts)] + [(3, "one", 0, "o"), (None, "no key here", 0, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, output string").repartition(5)
    got = fim.middle_rows(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = []
    for key, text, _, _ in rows:
        n, form, a, m, out = plain("" if key is None else key, text or "")
        expected.append((key, n, form, a, m, sha(out), sha(text or "")))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}
    assert fim.middle_rows(docs.limit(0)).collect() == []
