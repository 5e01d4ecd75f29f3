"""WARC archives: round trips, segments, framing, revisits."""

import gzip
import hashlib

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, payload_bytes string"


def rows():
    long, big = "é" * 700, "".join(f"<p>{i}</p>\r\n\r\nWARC/1.1\r\n" for i in range(9000))
    out = [(1, "http://a/1", long), (2, "http://a/2\n", long), (9, None, long), (3, "http://b/", "short"), (4, "http://b/", "short"), (5, "u", None), (6, "u", "")]
    out += [(7, "u", big), (8, "u", big), (10, "u", big + "x"), (11, "u", "y" * 999), (12, "u", "y" * 999), (13, "u", "z" * 1000), (13, "u", "z" * 1000), (14, "é日", "z" * 1000)]
    out += [(None, "n", "q" * 2000), (None, "n", "q" * 2000), (None, "m", long), (20, "u", "\x00\x01 \r\n\r\n0\r\n\r\n"), (3, "again", "other"), (21, "u", "v" * 32_768 * 3)]
    return [(*r, "clash") for r in out]


def test_round_trip(spark):
    data = rows()
    want = []
    for page, _, html, _ in data:
        raw = (html or "").encode()
        same = [p for p, _, h, _ in data if (h or "") == (html or "") and p is not None]
        first = max(same, default=None) if len(raw) >= 1000 and sum((h or "") == (html or "") for _, _, h, _ in data) > 1 else None
        revisit = first is not None and first != page
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = warc.round_trip(df)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_and_urls_come_back(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    warc.write_archives(df, f"file://{tmp_path}/a", segment=100)
    back = warc.read_archives(spark, f"file://{tmp_path}/a").filter("record_type = 'response'").collect()
    pages = {(r.page_id, bytes(r.payload)) for r in back}
    assert (10, rows()[9][2].encode()) in pages and (5, b"") in pages and (14, b"z" * 1000) in pages
    assert {r.url for r in back if r.page_id == 14} == {"é日"}


def test_files_are_warc(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(rows()[:8], SCHEMA).coalesce(1), f"file://{tmp_path}/a")
    (file,) = (tmp_path / "a").glob("part*.gz")
    data = gzip.decompress(file.read_bytes())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
    assert b"WARC-Type: continuation" in data and b"WARC-Segment-Total-Length" in data and b"WARC-Type: revisit" in data
    records = list(warc.parse(iter([data[i : i + 7] for i in range(0, len(data), 7)])))
    assert sum(h["warc-type"] != "continuation" for h, _ in records) == 8
    members = b"".join(gzip.compress(warc.record([("WARC-Type", "x")], b"%d" % i) + b"\n") for i in range(50))
    assert [b for _, b in warc.parse(warc._stream(members))] == [b"%d" % i for i in range(50)]


def test_framing_and_segments():
    for n in (0, 1, 8191, 8192, 8193, 40_000):
        assert warc.unchunked(warc.chunked(b"a" * n)) == b"a" * n
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.assemble([(2, 5, b"de"), (1, None, b"abc"), (1, None, b"abc")]) == b"abcde"
    for bad in ([(1, None, b"abc")], [(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, 3, b"b")], [(1, None, b"a"), (1, None, b"b"), (2, 2, b"c")]):
        with pytest.raises(ValueError):
            warc.assemble(bad)
    for cut in (gzip.compress(b"x" * 100)[:-3],):
        with pytest.raises(ValueError):
            list(warc._stream(cut))
    with pytest.raises(ValueError):
        list(warc.parse(iter([warc.record([("WARC-Type", "x")], b"abc")[:-4]])))
