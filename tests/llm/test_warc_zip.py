"""Packages of WARC records: round trips, directories and revisits."""

import hashlib
import io
import struct
import zipfile
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from helpers import none

from shardloom.llm import queries, warc_zip

SF = "/root/testdata/sf0.001"
BIG = "<p>" + "same page " * 20 + "</p>"
PAGES = [
    (3, "http://a.org/1", BIG, "x"), (1, "http://a.org/2", BIG, "x"), (1, "http://a.org/2", BIG, "x"), (1, "http://b.org/", BIG, "x"),
    (None, "http://c.org/", BIG, "x"), (5, None, BIG + "!", "x"), (6, "http://d.org/a b\r\nX: y", None, "x"), (7, "", "", "x"), (7, "", "", "x"),
    (8, "http://e.org/é", "short", "x"), (9, "http://e.org/", "short", "x"), (-2, "u", "\r\n\r\nWARC/1.1\r\n日本🎉" * 40, "x"), (11, "u", "z" * 3_000_000, "x"),
    (12, "u", "y" * 100, "x"), (13, "u", "y" * 100, "x"), (14, "u", "y" * 99, "x"), (15, "u", "y" * 99, "x"),
    (None, "n", "n" * 200, "x"), (None, "n", "n" * 200, "x"),
]
SCHEMA = "page_id bigint, url string, html string, digest string"


def _expected(pages):
    """One row for each page; which of equal pages is the response does not show."""
    rows = [(page, hashlib.sha256((html or "").encode()).hexdigest(), len((html or "").encode())) for page, _, html, _ in pages]
    out = Counter()
    for digest, size in {r[1:] for r in rows}:
        keys = sorted((p is None, p or 0) for p, d, n in rows if (d, n) == (digest, size))
        for i, (absent, page) in enumerate(keys):
            again = size >= 100 and i > 0
            out[None if absent else page, size, digest, "revisit" if again else "response",
                None if not again or keys[0][0] else keys[0][1]] += 1
    return out


def _got(df):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


def test_op11_equals_brute_force(spark):
    pages = [tuple(r) + (None,) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert _got(queries.op11_warc_zip(spark, SF)) == _expected(pages)


def test_odd_pages_come_back(spark, monkeypatch):
    df = spark.createDataFrame(PAGES, SCHEMA)
    packages = warc_zip.archive_pages(df)
    records = warc_zip.read_packages(packages).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records) == _expected(PAGES)
    assert len({r["record_id"] for r in records if r["payload_bytes"] >= 100}) == sum(r["payload_bytes"] >= 100 for r in records)
    texts = {(p, h or "") for p, _, h, _ in PAGES}
    for r in records:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None:
            assert (r["page_id"], r["payload"].decode()) in texts
    assert {r["url"] for r in records} == {None, "", "u", "n", "http://d.org/a%20b%0D%0AX:%20y", "http://e.org/é",
                                           "http://e.org/", "http://a.org/1", "http://a.org/2", "http://b.org/", "http://c.org/"}
    assert packages.agg({"records": "sum"}).first()[0] == len(PAGES)
    assert _got(warc_zip.read_packages(warc_zip.packages_in(spark, packages.first()["file"].rpartition("/")[0]))) == _expected(PAGES)
    empty = spark.createDataFrame([], SCHEMA)
    assert warc_zip.read_packages(warc_zip.archive_pages(empty)).count() == 0
    assert none(spark).count() == 0
    # Frequent payloads take the way of the broadcast.
    monkeypatch.setattr(warc_zip, "SHARES", 10**9)
    assert _got(warc_zip.read_packages(warc_zip.archive_pages(df))) == _expected(PAGES)
    monkeypatch.setattr(warc_zip, "SHARES", 4)
    many = [(k, f"u{k}", BIG, None) for k in range(40)] + PAGES
    assert _got(warc_zip.read_packages(warc_zip.archive_pages(spark.createDataFrame(many, SCHEMA)))) == _expected(many)


def _open(raw):
    return pa.BufferReader(raw)


def _record(i, payload=b"hello"):
    return warc_zip.write_record(i, f"http://x/{i}", hashlib.sha256(payload).hexdigest(), len(payload), payload)


def _package(records, index=True, extra=0):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(warc_zip.DATA, b"".join(records))
        if index:
            at, lines = 0, []
            for r in records:
                lines.append('org,x)/ 2020 {"offset": "%d", "length": "%d", "filename": "data.warc.gz"}' % (at, len(r)))
                at += len(r)
            z.writestr(warc_zip.INDEX, "\n".join(lines))
        for i in range(extra):
            z.writestr(f"pages/{i}.txt", b"")
        z.comment = b"a comment with PK\x05\x06 inside"
    return out.getvalue()


def _read(raw):
    with _open(raw) as file:
        return [warc_zip.read_record(zlib.decompress(raw[at : at + n], 31))["page_id"] for at, n in warc_zip.index_of(file)]


def test_packages_of_other_writers():
    records = [_record(i, b"p" * (i * 1000)) for i in range(50)]
    assert _read(_package(records)) == list(range(50))
    assert _read(_package(records, index=False)) == list(range(50))
    assert _read(b"MZ" * 500 + _package(records)) == list(range(50))


def test_wide_directories():
    records = [_record(i) for i in range(3)]
    raw = _package(records, extra=66_000)  # more entries than 16 bits count
    assert b"PK\x06\x06" in raw[-3000:]
    with _open(raw) as file:
        assert len(list(warc_zip.members(file, window=10_000))) == 66_002
    assert _read(raw) == [0, 1, 2]
    # Wide sizes and places in an entry, as packages beyond 4 GB have them.
    out = b"".join(records)
    name = warc_zip.DATA.encode()
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(out), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(out), len(out))
    wide = struct.pack("<HHQQQ", 1, 24, len(out), len(out), 0)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(out), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide
    body = local + out
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), len(body))
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(body) + len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for front in (b"", b"#!/bin/sh\n" * 30):
        raw = front + body + entry + end64 + locator + end
        assert _read(raw) == [0, 1, 2]


def test_damaged_packages_are_refused():
    raw = _package([_record(1)])
    with pytest.raises(warc_zip.BadPackage), _open(raw[:-40]) as file:
        list(warc_zip.members(file))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.DATA, _record(1) * 50)
    with pytest.raises(warc_zip.BadPackage, match="not stored"), _open(out.getvalue()) as file:
        list(warc_zip.index_of(file))
    with pytest.raises(warc_zip.BadPackage, match="digest"):
        warc_zip.read_record(zlib.decompress(warc_zip.write_record(1, "u", "0" * 64, 3, b"abc"), 31))
    with pytest.raises(warc_zip.BadPackage, match="as long"):
        warc_zip.read_record(zlib.decompress(_record(1), 31)[:-6])
    with pytest.raises(zlib.error):
        zlib.decompress(_record(1)[:-1], 31)
