"""Web archives: one response a payload, revisits resolved, files that other readers can read."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sugartrace.llm import warc
from sugartrace.session import scratch_path

PAGES = "page_id long, url string, html string, digest string, part int"
ROWS = [
    (3, "http://a/3", "<p>same</p>"),
    (9, "http://a/9", "<p>same</p>"),
    (4, "http://a/4", "<p>same</p>"),
    (None, "http://a/none", "<p>same</p>"),
    (5, None, None),
    (6, "http://a/6", ""),
    (7, "http://a b/7\r\nX: y", "WARC/1.1\r\n\r\nkein Ende é\U0001f600\r\n\r\n"),
    (8, "http://a/8", "x" * 300_000),
    (1, "http://a/1", "only"),
    (2, "http://a/2", "twice"),
    (2, "http://a/2", "twice"),
    (2, "http://a/2", "twice"),
]


def expected(rows, at_least=0):
    out = []
    groups = {}
    for page, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, url is not None, url or "", page))
    for body, members in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first, *others = sorted(members, reverse=True)
        out.append((first[4], len(body), digest, "response", None))
        small = len(body) < at_least
        out += [(m[4], len(body), digest, "response", None) if small else (m[4], len(body), digest, "revisit", first[4]) for m in others]
    return sorted(out, key=repr)


def written(spark, rows, **choices):
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES).repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write(pages, path, **choices)
    return path


def seen(rows):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows.collect()), key=repr)


def test_one_response_a_payload(spark):
    pages = spark.createDataFrame([(*r, "d", 1) for r in ROWS], PAGES).repartition(3)
    got = warc.page_rows(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert seen(got) == expected(ROWS)
    assert warc.page_rows(pages.limit(0)).collect() == []


@pytest.mark.parametrize("at_least", [5, 12, 1 << 20])
def test_small_payloads_stay_whole(spark, at_least):
    path = written(spark, ROWS, at_least=at_least)
    assert seen(warc.resolve(warc.read(spark, path))) == expected(ROWS, at_least)


def test_payloads_and_urls_come_back(spark):
    records = warc.read(spark, written(spark, ROWS)).collect()
    assert len({r.record_id for r in records}) == len(ROWS)
    bodies = {r.page_id: (r.url, bytes(r.payload).decode()) for r in records if r.record_type == "response"}
    assert bodies[7] == ("http://a%20b/7%0D%0AX:%20y", ROWS[6][2])
    assert bodies[8] == ("http://a/8", "x" * 300_000)
    assert bodies[6] == ("http://a/6", "")
    assert all(r.payload is None for r in records if r.record_type == "revisit")


def test_files_follow_the_format(spark):
    path = Path(written(spark, ROWS).removeprefix("file:"))
    kinds = []
    for file in path.glob("part-*"):
        content, at = gzip.decompress(file.read_bytes()), 0
        while at < len(content):
            head, _, rest = content[at:].partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            assert {"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length", "WARC-Payload-Digest"} <= set(fields)
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Profile"].endswith("identical-payload-digest")
                assert fields["WARC-Refers-To"].startswith("<urn:uuid:")
            size = int(fields["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            at += len(head) + 4 + size + 4
            kinds.append(fields["WARC-Type"])
    assert sorted(kinds) == sorted(r[3] for r in expected(ROWS))


def test_many_copies_in_many_partitions(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("page_id"),
        F.format_string("http://h/%d", F.col("id")).alias("url"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("page "), (F.col("id") % 1500).cast("string"))).alias("html"),
    )
    plain = [(r.page_id, r.url, r.html) for r in rows.collect()]
    assert seen(warc.page_rows(rows.repartition(17))) == expected(plain)


def test_rewrite_resolves_revisits_of_other_archives(spark):
    path, again = written(spark, ROWS), scratch_path(spark, "warc-again")
    warc.rewrite(spark, path, again)
    assert seen(warc.resolve(warc.read(spark, again))) == expected(ROWS)
    lost = warc.read(spark, path).where("record_type = 'revisit'")
    assert {(r.payload_bytes, r.refers_to) for r in warc.resolve(lost).collect()} == {(None, None)}


def test_broken_files_are_refused():
    whole = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.cut(whole * 2)] == [b"abc", b"abc"]
    for broken in (whole[:-3], whole[:20], whole.replace(b"3", b"2"), b"junk"):
        with pytest.raises(ValueError):
            list(warc.cut(broken))
    with pytest.raises(ValueError, match="digest"):
        warc._entry({"WARC-Record-ID": "r", "WARC-Type": "response", "WARC-Payload-Digest": "sha1:A"}, b"HTTP/1.1 200 OK\r\n\r\nx")
