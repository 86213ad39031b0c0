import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.llm import warc, zips
from codestrata.session import Scratch


def opened(data):
    return pa.BufferReader(data)


@pytest.mark.parametrize("limit", [1 << 31, 100])
@pytest.mark.parametrize("comment", [b"", b"a PK\x05\x06 in a comment" + b"x" * 60_000])
def test_directories(monkeypatch, limit, comment):
    """Plain and ZIP64 archives; a low limit makes the writer put sizes and the end record into ZIP64 fields."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3 if limit == 100 else 65535)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(8):
            z.writestr(f"häuser/{k}", bytes([k]) * (60 * k))
        z.writestr("packed", b"y" * 500, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = comment
    file = opened(out.getvalue())
    found = {m.name: m for m in zips.members(file, len(out.getvalue()))}
    assert len(found) == 9
    for k in range(8):
        m = found[f"häuser/{k}"]
        assert file.read_at(m.size, zips.data_start(file, m)) == bytes([k]) * (60 * k)
    with pytest.raises(ValueError, match="compressed"):
        zips.data_start(file, found["packed"])


def test_damage():
    with pytest.raises(ValueError, match="not a ZIP"):
        zips.members(opened(b"x" * 100), 100)
    with pytest.raises(ValueError, match="digest"):
        warc.decode(warc.encode(1, "u", b"abc", None).replace(b"abc", b"abd"))


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, monkeypatch, least):
    html = ["<p>a</p>", "<p>a</p>", None, "", "abc", "abc", "é" * 9000, "\r\n\r\nWARC/1.1\r\n", "<p>a</p>"]
    rows = [(k, f"http://x/{k}\r\nInjected: 1" if k == 4 else None if k == 5 else f"http://x/{k}", h, "s") for k, h in enumerate(html)]
    rows += [rows[0], (None, "http://n", "<p>a</p>", "t"), (None, "http://n", "alone", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    with Scratch(spark) as scratch:
        records = warc.with_originals(scratch, pages, "page_id", "url", "html", least)
        paths = scratch.keep(warc.write_packages(records, scratch.path("zips"), limit=9000))
        assert paths.agg({"records": "sum"}).first()[0] == len(rows)
        got = warc.read_records(scratch.keep(warc.record_places(paths))).collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(r[2] or "", r[0])
    want = []
    for page, _, text, _ in rows:
        payload = (text or "").encode()
        same = first[text or ""] if len(payload) >= least else page
        revisit = same is not None and same != page
        want.append((str(page), len(payload), warc.digest(payload), "revisit" if revisit else "response", same if revisit else None, None if revisit else payload))
    assert sorted(map(repr, want)) == sorted(repr((str(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in got)
    assert {r.url for r in got if r.id == 4} == {"http://x/4%0D%0AInjected: 1"} and {r.url for r in got if r.id == 5} == {None}


def test_no_pages(spark):
    with Scratch(spark) as scratch:
        records = warc.with_originals(scratch, spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url", "html")
        paths = scratch.keep(warc.write_packages(records, scratch.path("zips")))
        assert warc.read_records(scratch.keep(warc.record_places(paths))).count() == 0


def test_many_tasks_read_one_package(spark):
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat('z', 50) || id as html").coalesce(1)
    with Scratch(spark) as scratch:
        records = warc.with_originals(scratch, pages, "page_id", "url", "html").coalesce(1)
        paths = scratch.keep(warc.write_packages(records, scratch.path("zips")))
        assert paths.count() == 1
        read = warc.read_records(scratch.keep(warc.record_places(paths)))
        assert read.select(F.spark_partition_id()).distinct().count() > 1
