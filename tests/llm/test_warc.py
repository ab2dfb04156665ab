from __future__ import annotations

import hashlib

from signals.llm import warc
from signals.llm.queries import op9_warc_segments
from signals.llm.warc import archive_bytes, archive_pages, http_payload, parse_archive, read_warc, write_warc

SCHEMA = "page_id bigint, url string, html string, digest string, payload int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


ODD = [
    (1, "http://a/1", None), (2, None, ""), (3, "http://a/3", "x" * 99), (4, "http://a/4", "x" * 99),
    (9, "http://a/9", "y" * 100), (7, "http://a/7", "y" * 100), (8, "http://b/8", "y" * 100),
    (10, "http://a/10", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 3_000), (11, "http://a/11", "z" * 300_000),
    (12, "http://x/\r\nEvil: 1", "<p>" + "中" * 20_000), (None, "http://a/n", "q" * 200), (13, "http://a/13", "q" * 200),
]


def test_pages_come_back(spark):
    got = {r.page_id: r for r in archive_pages(table(spark, ODD)).collect()}
    assert len(got) == len(ODD)
    for page, _, html in ODD:
        r = got[page]
        assert r.complete
        if page in (8, 9, None):
            assert r.record_type == "revisit" and r.payload is None
        else:
            assert r.record_type == "response" and bytes(r.payload) == (html or "").encode()
    assert got[8].refers_to_id == got[7].record_id == got[9].refers_to_id and got[None].refers_to_id == got[13].record_id


def test_repeated_rows_and_none(spark):
    rows = [(5, "http://a", "long " * 9_000)] * 3 + [(6, "http://a", "short")] * 2
    got = archive_pages(table(spark, rows)).collect()
    assert sorted((r.page_id, len(r.payload), r.record_type, r.complete) for r in got) == [(5, 45_000, "response", True)] * 3 + [
        (6, 5, "response", True)
    ] * 2
    assert archive_pages(table(spark, [])).count() == 0


def test_lost_segments_are_told(spark, tmp_path):
    whole = str(tmp_path / "whole")
    write_warc(table(spark, [(1, "http://a", "k" * 80_000), (2, "http://b", "fine")]), whole)
    data = b"".join(archive_bytes(p.read_bytes()) for p in (tmp_path / "whole").glob("part-*"))
    records = [(at, h) for at, h, _ in parse_archive(data)]
    numbers = [h.get("warc-segment-number") for _, h in records]
    assert numbers.count(None) == 1 and "3" in numbers
    ends = [at for at, _ in records[1:]] + [len(data)]
    for lost in ("1", "3", max(n for n in numbers if n)):
        part = tmp_path / f"without-{lost}"
        part.mkdir()
        kept = b"".join(data[at:end] for (at, h), end in zip(records, ends, strict=True) if h.get("warc-segment-number") != lost)
        (part / "part-0").write_bytes(kept)
        got = read_warc(spark, str(part)).collect()
        assert [(bytes(r.payload)) for r in got if r.complete] == [b"fine"] and len(got) == 2


def test_segments_in_other_archives_and_order(spark, tmp_path):
    write_warc(table(spark, [(1, "http://a", "".join(map(str, range(30_000))))]), str(tmp_path / "w"))
    data = b"".join(archive_bytes(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    at = [a for a, _, _ in parse_archive(data)] + [len(data)]
    apart = tmp_path / "apart"
    apart.mkdir()
    for i in range(len(at) - 1):
        (apart / f"part-{9 - i}").write_bytes(data[at[i] : at[i + 1]])
    r = read_warc(spark, str(apart)).first()
    assert r.complete and bytes(r.payload) == "".join(map(str, range(30_000))).encode()


def test_transfer_framing():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert http_payload(head + b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"
    assert http_payload(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    for broken in (b"3\r\nab", b"3\r\nabcXX0\r\n\r\n", b"zz\r\nabc\r\n", b""):
        assert http_payload(head + broken) is None


def test_query_resolves_revisits(spark, tmp_path):
    table(spark, ODD).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in op9_warc_segments(spark, str(tmp_path)).collect()}
    for page, _, html in ODD:
        data = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {p: r.refers_to for p, r in got.items() if r.refers_to} == {8: 7, 9: 7, None: 13} and warc.MIN_REVISIT == 100
