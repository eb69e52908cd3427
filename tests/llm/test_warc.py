"""The archive against its plain restatement, and records byte for byte through tables and files."""

import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from stationfill.llm import op_queries, warc

GIVEN = "/root/testdata/sf0.001"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
PAGES = "page_id long, url string, html string"


def brute(rows, least_bytes=0):
    """For (page_id, html) rows with different ids."""
    data = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(data):
        first.setdefault(data[i], i)
    out = {}
    for i, d in data.items():
        to = first[d] if len(d) >= least_bytes and first[d] != i else None
        out[i] = (len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if to is None else "revisit", to)
    return out


def got(df):
    assert df.columns == COLUMNS
    return {r[0]: tuple(r[1:]) for r in df.collect()}


ROWS = [(7, "u7", "same"), (3, "u3", "same"), (5, None, "same"), (1, "u1", None), (2, "u 2\r\nX: y é", ""), (4, "", "é😀 \r\n\r\n WARC/1.1\r\n\r\n"), (6, "u6", "x" * 300_000), (8, "u8", "x" * 300_000), (9, "u9", " ")]


@pytest.mark.parametrize("least_bytes, per_part", [(0, 1024), (0, 1), (5, 2)])
def test_archive(spark, monkeypatch, least_bytes, per_part):
    monkeypatch.setattr(warc, "RECORDS_PER_PART", per_part)
    rows = ROWS + [(100 + i, f"h{i}", "hot page") for i in range(40)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    assert got(warc.digests(pages, least_bytes)) == brute([(i, t) for i, _, t in rows], least_bytes)


@pytest.mark.skipif(not os.path.isdir(GIVEN), reason="given tables not present")
def test_given(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{GIVEN}/pages.parquet").collect()]
    assert got(op_queries.op11_warc_archive(spark, GIVEN)) == brute(rows)


def test_awkward_rows(spark):
    names = ["sha256", "sha1", "n", "packed", "parts", "part", "copy", "copies", "first", "salt", "record", "payload"]
    rows = [(None, "a", "twice"), (None, "b", "twice"), (5, "c", "twice"), (6, "c", "six"), (6, "c", "six"), (6, None, "six"), (None, None, None), (None, None, "alone")]
    pages = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("mine") for c in names})
    found = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.digests(pages).collect()), key=str)
    expected = [(5, "response", None), (6, "response", None), (6, "revisit", 6), (6, "revisit", 6)]
    expected += [(None, "response", None)] * 2 + [(None, "revisit", 5)] * 2
    assert found == sorted(expected, key=str)
    empty = warc.digests(pages.limit(0))
    assert empty.columns == COLUMNS and empty.count() == 0


def test_payloads_are_stored_once(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES)
    warc.write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({t or "" for _, _, t in ROWS})
    assert spark.read.parquet(str(tmp_path / "a/records")).count() == len(ROWS)


def any_records():
    """Records of other kinds: no HTTP, folded header lines, binary payloads, shared payloads."""
    draw, out = random.Random(4), []
    for i in range(30):
        body = draw.randbytes(draw.randrange(0, 400)) if i % 3 else b"shared \xff\x00\r\n\r\nbytes"
        block = b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\n" + body if i % 2 else body
        kind = b"application/http; msgtype=response" if i % 2 else b"text/plain"
        out.append(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\nX-Folded: a\r\n b\r\ncontent-type: %s\r\nContent-Length: %d\r\n\r\n" % (i, kind, len(block)) + block + b"\r\n\r\n")
    return out


@pytest.mark.parametrize("compressed", [True, False])
def test_files_and_archive_give_every_byte_back(spark, tmp_path, monkeypatch, compressed):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 4)
    monkeypatch.setattr(warc, "RECORDS_PER_PART", 3)
    records = any_records()
    table = spark.createDataFrame([(x,) for x in records], "record binary").repartition(3)
    warc.write_files(table, str(tmp_path / "files"), compressed)
    back = warc.read_files(spark, str(tmp_path / "files"))
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(records)
    assert back.select("file").distinct().count() > 3
    warc.ingest(back, str(tmp_path / "archive"))
    again = warc.read_archive(spark, str(tmp_path / "archive"))
    assert sorted(bytes(r.record) for r in again.collect()) == sorted(records)
    assert spark.read.parquet(str(tmp_path / "archive/payloads")).count() < len(records) - 5


def test_pages_through_files(spark, tmp_path):
    warc.write_archive(spark.createDataFrame(ROWS, PAGES), str(tmp_path / "a"))
    rebuilt = warc.read_archive(spark, str(tmp_path / "a"))
    warc.write_files(rebuilt, str(tmp_path / "f"))
    back = {bytes(r.record) for r in warc.read_files(spark, str(tmp_path / "f")).collect()}
    assert back == {bytes(r.record) for r in rebuilt.collect()}
    said = warc.fields(next(x for x in back if b"x-page:2:" in x.split(b"WARC-Date")[0]).split(b"\r\n\r\n")[0])
    assert said["warc-target-uri"] == "u%202%0D%0AX:%20y%20%C3%A9" and said["warc-type"] == "revisit" and said["warc-refers-to"].startswith("<urn:x-page:1:1:")


def test_gzip_members_and_broken_files():
    records = any_records()[:3]
    assert list(warc.parse(b"".join(map(gzip.compress, records)))) == records
    assert list(warc.parse(b"")) == []
    for data in (records[0][:-9], b"nothing", gzip.compress(records[0])[:-9], records[0] + b"tail"):
        with pytest.raises(ValueError):
            list(warc.parse(data))


def test_damage_is_an_error(spark, tmp_path):
    warc.write_archive(spark.createDataFrame(ROWS, PAGES), str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a/payloads")).collect()
    swapped = [(a.sha256, b.n, a.parts, b.packed) for a, b in zip(stored, stored[1:] + stored[:1])]
    spark.createDataFrame(swapped, "sha256 binary, n long, parts int, packed binary").write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "b/records"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()
    rows = [(b"same", "A", 1, b"x"), (b"same", "B", 1, b"y")]
    with pytest.raises(Exception, match="different payloads"):
        warc.payload_table(spark.createDataFrame(rows, "sha256 binary, sha1 string, n long, packed binary")).collect()
