import gzip
import hashlib
import io
import os

import pytest

from cardlake.llm import warc

BIG = "é<p>x\r\n\r\nWARC/1.1\r\n" * 9_000
ROWS = [(1, "http://a/", "x" * 1000, "q"), (5, "http://b/", "x" * 1000, "q"), (3, None, "x" * 1000, None), (None, "http://c/", "x" * 1000, "q"),
        (2, "http://d/", "x" * 999, "q"), (4, "http://e/", "x" * 999, "q"), (6, "http://f/", None, "q"), (7, "", "", "q"),
        (8, "http://g/\r\nX: y", BIG, "q"), (9, "http://ü/", BIG, "q"), (9, "http://ü/", BIG, "q"), (10, "h", "y" + BIG, "q"),
        (None, "n", "z" * 2000, "q"), (None, "n", "z" * 2000, "q")]


def expected(rows):
    sha = [hashlib.sha1((h or "").encode()).hexdigest() for _, _, h, _ in rows]
    out = []
    for (i, _, h, _), s in zip(rows, sha):
        size = len((h or "").encode())
        ids = [r[0] for r, t in zip(rows, sha) if t == s and r[0] is not None]
        top = max(ids) if ids and size >= 1000 else None
        visit = top is not None and i != top
        out.append((i, size, s, "revisit" if visit else "response", top if visit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment, records, limit", [(32_768, 8_192, "10m"), (100, 3, "-1"), (1_000_000, 1, "10m")])
def test_round_trip(spark, scratch, segment, records, limit):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string").repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        warc.write_archives(pages, f"{scratch}/w", segment=segment, records=records)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    got = warc.read_archives(spark, f"{scratch}/w")
    assert got.where("problem is not null").count() == 0
    texts = {(r.page_id, r.payload.decode()) for r in got.where("record_type = 'response'").collect()}
    assert texts == {(i, h or "") for (i, _, h, _), e in ((r, e) for r in ROWS for e in [0]) if (i, h) not in
                     {(1, "x" * 1000), (3, "x" * 1000), (None, "x" * 1000), (8, BIG)}}
    assert sorted(map(tuple, warc.payload_table(got).collect()), key=str) == expected(ROWS)


def test_archives_are_plain_warc(spark, scratch):
    """A reader that knows only the format's rules finds every record."""
    warc.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string, x string").coalesce(1), f"{scratch}/w")
    seen, origins = 0, {}
    for f in sorted(os.listdir(f"{scratch}/w")):
        if f.startswith("part-"):
            data = gzip.open(f"{scratch}/w/{f}").read()
            while data:
                head, _, rest = data.partition(b"\r\n\r\n")
                h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                n = int(h["Content-Length"])
                assert head.startswith(b"WARC/1.1\r\n") and rest[n:n + 4] == b"\r\n\r\n"
                if "WARC-Segment-Number" in h:
                    origins.setdefault(h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), []).append(
                        (int(h["WARC-Segment-Number"]), n, h.get("WARC-Segment-Total-Length")))
                seen += h["WARC-Type"] != "continuation"
                data = rest[n + 4:]
    assert seen == len(ROWS) and len(origins) == 3  # the revisit of page 8 has no segments
    for segs in origins.values():
        assert [k for k, _, _ in sorted(segs)] == list(range(1, len(segs) + 1))
        assert sum(n for _, n, _ in segs) == int(max(segs)[2])


def test_framing():
    for p in (b"", b"a", b"x" * 8192, b"\r\n0\r\n\r\n" * 5000):
        assert warc.unchunked(warc.chunked(p, 7)) == p
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_damaged_segments():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world" * 20)
    parts = [block[i:i + 50] for i in range(0, len(block), 50)]
    numbers = list(range(1, len(parts) + 1))
    assert warc.assemble(numbers[::-1], parts[::-1], len(block)) == (b"hello world" * 20, None)
    assert warc.assemble(numbers * 2, parts * 2, len(block)) == (b"hello world" * 20, None)
    assert warc.assemble(numbers[:1] + numbers[2:], parts[:1] + parts[2:], len(block)) == (None, "missing segment")
    assert warc.assemble(numbers, parts, None) == (None, "missing segment")
    assert warc.assemble(numbers, parts, len(block) + 1) == (None, "wrong total length")
    assert warc.assemble([*numbers, 1], [*parts, b"other"], len(block)) == (None, "contradicting segments")
    assert warc.assemble([1], [block[:-9]], len(block) - 9)[1] == "broken framing"


def test_other_archives(spark, scratch):
    """Plain and multi-member gzip archives, records of other types, segments over files."""
    os.makedirs(f"{scratch}/w")
    rec = list(warc.page_records(4, "u", "abc" * 100, "d", None, "urn:x", "2024-01-01T00:00:00Z", segment=90))
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 2\r\n\r\nhi"
    with open(f"{scratch}/w/part-0", "wb") as f:
        f.write(info + b"\r\n\r\n" + rec[-1] + b"\r\n\r\n")
    with open(f"{scratch}/w/part-1.gz", "wb") as f:
        for r in rec[:-1]:
            f.write(gzip.compress(r + b"\r\n\r\n"))
    got = warc.read_archives(spark, f"{scratch}/w").collect()
    assert [(r.page_id, r.payload, r.problem) for r in got] == [(4, b"abc" * 100, None)]
    with pytest.raises(ValueError):
        list(warc.parse_archive(io.BytesIO(rec[0][:-3])))


def test_archives_of_any_name(spark, scratch):
    os.makedirs(f"{scratch}/w")
    for i, name in enumerate(["crawl-00001.warc.gz", "crawl-00002.warc", "part-0", "_started", ".part-0.crc"]):
        data = b"".join(r + b"\r\n\r\n" for r in warc.page_records(i, "u", f"abc{i}", "d", None, f"urn:{i}", "2024-01-01T00:00:00Z"))
        with open(f"{scratch}/w/{name}", "wb") as f:
            f.write(gzip.compress(data) if name.endswith(".gz") else data)
    got = warc.read_archives(spark, f"{scratch}/w").collect()
    assert sorted((r.page_id, r.payload) for r in got) == [(i, b"abc%d" % i) for i in range(3)]


def test_empty_table(spark, scratch):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{scratch}/w")
    assert warc.payload_table(warc.read_archives(spark, f"{scratch}/w")).count() == 0
