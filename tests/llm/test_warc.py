import hashlib

import pytest

from lakewarden.llm import warc
from lakewarden.llm.common import scratch

FAKE = "before WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n after WARC/1."
PAGES = [(1, "http://a/", None), (2, None, ""), (3, "http://a\r\nb", "é" * 700), (4, "u", "é" * 700), (5, "u", "short"), (6, "u", "short"), (7, "u", FAKE), (8, "u", "WARC/1.0"), (9, "u", "WARC/1.1\r\n"), (None, "u", "x"), (11, "u", "é" * 700), (12, "u", "\r\n\r\n"), (13, "u", "y" * 90_000 + FAKE * 40 + "WAR")]


def expected(pages):
    out = []
    for i, _, html in pages:
        b = (html or "").encode()
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        again = len(b) >= 1000 and i != max(same)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,files,codec", [("128m", 1, "none"), ("4k", 1, "none"), ("57", 2, "none"), ("1k", 3, "none"), ("4k", 2, "gzip")])
def test_round_trip_with_magic_in_payloads(spark, block, files, codec):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, header string").coalesce(files)
    path = scratch(spark, "t")
    warc.write_archives(warc.to_records(pages).coalesce(files), path, codec)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    if block == "57":
        block = "700"
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        records = warc.read_archives(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])  # payloads are read in other blocks
        got = warc.page_rows(records).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    assert sorted((tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=str) == expected(PAGES)


def test_bytes_that_are_not_utf8_survive_and_a_chain_stops_where_it_breaks(spark):
    head = lambda n: f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n".encode()
    data = head(4) + b"\xff\x00\xfe\x80" + b"\r\n\r\n" + head(9) + b"four" + b"\r\n\r\n" + head(2) + b"ok\r\n\r\n"
    path = scratch(spark, "t")
    spark.createDataFrame([(bytearray(data),)], "b binary").selectExpr("cast(b as string) value").coalesce(1).write.text(path)
    rows = warc.read_archives(spark, path).collect()
    assert bytes(rows[0].payload) == b"\xff\x00\xfe\x80" and not rows[0].broken
    assert [r.broken for r in rows[1:]] == [True]


def test_empty(spark):
    path = scratch(spark, "t")
    warc.write_archives(warc.to_records(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert warc.page_rows(warc.read_archives(spark, path)).count() == 0


@pytest.mark.parametrize("url", ["http://a/WARC/1.", "WARC/1.WARC/1.1", "http://a/?q=WARC/1.0\r\nContent-Length: 3"])
def test_magic_in_a_url_ends_no_chain(spark, url):
    pages = spark.createDataFrame([(i, url if i == 3 else "u", f"page {i}") for i in range(1, 8)], "page_id long, url string, html string").coalesce(1)
    path = scratch(spark, "t")
    warc.write_archives(warc.to_records(pages).coalesce(1), path)
    got = {r.page_id: r for r in warc.page_rows(warc.read_archives(spark, path)).collect()}
    assert sorted(got) == list(range(1, 8)) and all(r.payload_bytes == 6 for r in got.values())
    assert got[3].url.replace("%57", "W") == url.replace("\r", "%0A").replace("\n", "%0A")


def test_a_broken_record_of_an_own_archive_fails(spark):
    rows = spark.createDataFrame([("f", "WARC/1.1\r\nWARC-Type: response", bytearray(b""), True)], "file string, header string, payload binary, broken boolean")
    with pytest.raises(Exception, match="broken WARC record"):
        warc.page_rows(rows).collect()


def test_a_record_that_also_stands_inside_a_payload(spark):
    pages = spark.createDataFrame([(1, "u", "one")], "page_id long, url string, html string")
    inner = warc.to_records(pages).first().value + warc.END
    path = scratch(spark, "t")
    rows = [inner + "x", "WARC/1.1\r\nContent-Length: %d\r\n\r\n%s" % (len(inner), inner), inner[: -len(warc.END)]]
    spark.createDataFrame([(r,) for r in [rows[2], rows[1], rows[2]]], "value string").coalesce(1).write.option("lineSep", warc.END).text(path)
    got = sorted(bytes(r.payload) for r in warc.read_archives(spark, path).collect())
    assert got == sorted([b"one", b"one", inner.encode()])


@pytest.mark.parametrize("change", [("one", "two"), ("WARC-Type: response", "WARC-Type: revisit")])
def test_headers_that_lie_fail(spark, change):
    pages = spark.createDataFrame([(1, "u", "one")], "page_id long, url string, html string")
    path = scratch(spark, "t")
    spark.createDataFrame([(warc.to_records(pages).first().value.replace(*change),)], "value string").write.option("lineSep", warc.END).text(path)
    with pytest.raises(Exception, match="not what its header says|without its response"):
        warc.page_rows(warc.read_archives(spark, path)).collect()


def test_many_copies_with_the_filter_full(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILTER_BITS", 8)
    pages = [(i, "u", "z" * (1000 + i % 7)) for i in range(60)] + [(i, "u", "y" * (1100 + i)) for i in range(60, 90)]
    path = scratch(spark, "t")
    warc.write_archives(warc.to_records(spark.createDataFrame(pages, "page_id long, url string, html string")), path)
    got = warc.page_rows(warc.read_archives(spark, path)).collect()
    assert sorted((tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=str) == expected(pages)
