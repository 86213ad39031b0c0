"""WARC records in ZIP packages: written, indexed, and read back by byte ranges.

A package is a ZIP archive whose members are stored, not compressed: ``archive/data.warc``
with the records and ``indexes/index.cdxj`` with the place of each. Reading parses the
directories, range-reads the indexes, and then range-reads records, so tasks share an
archive by records and nothing is extracted.

Equal payloads of at least ``least`` bytes are stored once: the record with the smallest
id is a response, the others revisit it.

Defined results: a null payload is empty; rows that repeat the smallest id are responses
each; a null id revisits a twin that has one and is a response without; a null URL leaves
out the target header; an empty table gives no archives and no records; other columns
are not read. A damaged or compressed archive raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import stores, zips
from codestrata.llm.bitmaps import bitmap, flagged
from codestrata.session import Scratch

ARCHIVE_BYTES = 64_000_000
RANGE_BYTES = 4_000_000
DATE = "2000-01-01T00:00:00Z"
WARC, INDEX = "archive/data.warc", "indexes/index.cdxj"
PLACES = "path string, start long, size long"
RECORDS = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def with_originals(scratch: Scratch, pages: DataFrame, id: str, url: str, payload: str, least: int = 0) -> DataFrame:
    """``(id, url, payload, original)``: the smallest id with the same payload, null for a short payload.

    Digests and sizes are grouped, with partial sums per task. Only payloads that may occur more than
    once, by a bitmap of fixed size, move to meet their group's row; the others are originals.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload"))
    groups = rows.groupBy("digest", "length").agg(F.min("id").alias("original"), F.count("*").alias("copies"))
    groups = scratch.keep(groups.where((F.col("copies") > 1) & (F.col("length") >= least)).drop("copies"))
    marked = flagged(rows, "digest", bitmap(groups, "digest"), "shared")
    joined = marked.where("shared").join(groups, ["digest", "length"], "left").withColumn("original", F.coalesce("original", "id"))
    return marked.where("not shared").withColumn("original", F.col("id")).unionByName(joined).select("id", "url", "payload", "original")


def write_packages(records: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of ``with_originals`` to ZIP packages of about ``limit`` bytes: ``(path, records)``.

    Names are new in each attempt; only those in the returned rows belong to the result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                package = package or _Package(f"{folder}/{uuid.uuid4().hex}.zip")
                package.add(*row)
                if package.size >= limit:
                    yield package.close()
                    package = None
        if package:
            yield package.close()

    return records.mapInArrow(run, "path string, records long")


class _Package:
    """One ZIP package under way. Records stream to the store; only index lines are held."""

    def __init__(self, path: str):
        self.path, self.size, self.lines = path, 0, []
        self.stream = stores.writer(path)
        self.zip = zipfile.ZipFile(_OneWay(self.stream), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(WARC, "w", force_zip64=True)

    def add(self, id: int | None, url: str | None, payload: bytes, original: int | None) -> None:
        record = encode(id, url, payload, original)
        self.lines.append(json.dumps({"url": url, "offset": self.size, "length": len(record)}))
        self.member.write(record)
        self.size += len(record)

    def close(self) -> pa.RecordBatch:
        self.member.close()
        self.zip.writestr(INDEX, "".join(x + "\n" for x in self.lines))
        self.zip.close()
        self.stream.close()
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([len(self.lines)], pa.int64())], names=["path", "records"])


class _OneWay:
    """A stream that cannot seek, as in any store."""

    def __init__(self, stream):
        self.write, self.flush = stream.write, stream.flush


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode(id: int | None, url: str | None, payload: bytes, original: int | None) -> bytes:
    """One record. A revisit keeps the headers of its response and leaves out the body."""
    revisit = original is not None and original != id
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if id is None else id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{original}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode(record: bytes) -> tuple:
    """The fields of ``RECORDS``. A response's digest is checked against its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record is shorter than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and digest(payload) != named:
        raise ValueError("a payload does not have its digest")
    number = lambda text: int(text) if (text := text.removeprefix("<urn:page:").removesuffix(">")) else None
    kept = payload if fields["warc-type"] == "response" else None
    return number(fields["warc-record-id"]), fields.get("warc-target-uri"), int(_fields(http)["content-length"]), named, fields["warc-type"], number(fields.get("warc-refers-to", "")), kept


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v.strip() for k, _, v in pairs}


def record_places(paths: DataFrame) -> DataFrame:
    """``(path, start, size)`` of every record that the packages' indexes name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with stores.reader(path) as file:
                    found = {m.name: m for m in zips.members(file, file.size())}
                    base = zips.data_start(file, found[WARC])
                    for lines in _lines(file, zips.data_start(file, found[INDEX]), found[INDEX].size):
                        at = [json.loads(x) for x in lines]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * len(at)), pa.array([base + x["offset"] for x in at], pa.int64()), pa.array([x["length"] for x in at], pa.int64())], names=["path", "start", "size"]
                        )

    return paths.select("path").mapInArrow(run, PLACES)


def _lines(file, start: int, size: int) -> Iterator[list[bytes]]:
    rest = b""
    for at in range(start, start + size, RANGE_BYTES):
        *lines, rest = (rest + file.read_at(min(RANGE_BYTES, start + size - at), at)).split(b"\n")
        yield lines


def read_records(places: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at ``(path, start, size)``. Neighbouring ranges are fetched together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [f.strip().split() for f in RECORDS.split(",")]
        of = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, of[k]) for n, k in kinds])
        path, file = None, None
        for batch in batches:
            for run_path, ranges in _together(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if run_path != path:
                    if file:
                        file.close()
                    path, file = run_path, stores.reader(run_path)
                first = ranges[0][0]
                data = file.read_at(ranges[-1][0] + ranges[-1][1] - first, first)
                rows = [decode(data[s - first : s - first + n]) for s, n in ranges]
                if not payloads:
                    rows = [(*r[:-1], None) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
        if file:
            file.close()

    tasks = stores.reading_tasks(places, places.columns[2])
    return places.repartitionByRange(tasks, "path", "start").sortWithinPartitions("path", "start").mapInArrow(run, RECORDS)


def _together(rows: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Join ranges of one file that touch, up to ``RANGE_BYTES`` unless one record is longer."""
    path, ranges = None, []
    for p, start, size in rows:
        if ranges and (p != path or start != ranges[-1][0] + ranges[-1][1] or start + size - ranges[0][0] > RANGE_BYTES):
            yield path, ranges
            ranges = []
        path = p
        ranges.append((start, size))
    if ranges:
        yield path, ranges
