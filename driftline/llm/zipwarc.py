"""WARC records in ZIP-packaged archives: writer, directory parser and range reader.

Each archive is a ZIP of stored members: ``archive/data.warc.gz`` (one gzip member per record)
and ``indexes/index.cdxj`` (one line per record with its offset and length in the first).  The
reader fetches the end of a file, follows the central directory (ZIP64 records and extra fields
included), locates the members, reads the index, and then fetches each record by its byte range;
nothing is extracted.

Each attempt of a task writes archives of its own names, first under temporary ones.  Spark commits
the manifest of one attempt for each partition, and readers open only what it lists; so an attempt that
meets its rows in another order, and cuts them elsewhere, loses and doubles nothing.

Defined cases: a null payload is empty; a null id is the smallest and is written without
a name; rows that repeat both id and payload are responses together when that id is the
largest of its payload, else revisits together; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import table
from driftline.session import scratch_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads of fewer bytes are never revisits.
MIN_PAYLOAD = 0
#: Bytes of pages that one archive takes, and records that one reading task takes.
ARCHIVE_BYTES, RANGE_RECORDS = 64 << 20, 2000
LIMIT32, LIMIT16 = 0xFFFFFFFF, 0xFFFF


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- storage -----------------------------------------------------------------------------

def locate(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a shared folder or file."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# --- ZIP ---------------------------------------------------------------------------------

class StoredZip:
    """Writes stored members to a stream; sizes follow the data, ZIP64 wherever they need it."""

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.members, self.force64 = out, 0, [], force64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.head, self.crc, self.size = name.encode(), self.at, 0, 0
        # flag 8: checksum and sizes come after the data, in 64 bits as the extra field says
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 8, 0, 0, 33, 0, LIMIT32, LIMIT32,
                              len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)

    def end(self) -> None:
        self._put(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.head, self.crc, self.size))

    def close(self) -> None:
        start = self.at
        for name, head, crc, size in self.members:
            wide, extra = self.force64, b""
            big = wide or size >= LIMIT32
            far = wide or head >= LIMIT32
            if big:
                extra += struct.pack("<QQ", size, size)
            if far:
                extra += struct.pack("<Q", head)
            if extra:
                extra = struct.pack("<HH", 1, len(extra)) + extra
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 8, 0, 0, 33, crc,
                                  LIMIT32 if big else size, LIMIT32 if big else size, len(name), len(extra),
                                  0, 0, 0, 0, LIMIT32 if far else head) + name + extra)
        size, n = self.at - start, len(self.members)
        if self.force64 or start >= LIMIT32 or size >= LIMIT32 or n >= LIMIT16:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end64, 1))
            n, size, start = LIMIT16, LIMIT32, LIMIT32
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, start, 0))


def _fetch(file, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"the file ends inside bytes {at} to {at + size}")
    return data


def directory(file, length: int) -> dict[str, tuple[int, int]]:
    """Stored members of an archive: name -> (first byte of the data, size)."""
    tail_at = max(0, length - 22 - LIMIT16)
    tail = _fetch(file, tail_at, length - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    n, size, start = struct.unpack_from("<HII", tail, end + 10)
    if LIMIT16 == n or LIMIT32 in (size, start):
        locator = _fetch(file, tail_at + end - 20, 20) if tail_at + end >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            record = _fetch(file, struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("bad ZIP64 end of central directory")
            n, size, start = struct.unpack_from("<QQQ", record, 32)
    listing, at, members = _fetch(file, start, size), 0, {}
    for _ in range(n):
        sign, method = struct.unpack_from("<I6xH", listing, at)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", listing, at + 20)
        head = struct.unpack_from("<I", listing, at + 42)[0]
        if sign != 0x02014B50:
            raise ValueError("bad entry in central directory")
        name = listing[at + 46:at + 46 + n_name].decode("utf-8", "replace")
        extra = listing[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = io.BytesIO(extra[4:4 + width])
                full = struct.unpack("<Q", wide.read(8))[0] if full == LIMIT32 else full
                packed = struct.unpack("<Q", wide.read(8))[0] if packed == LIMIT32 else packed
                head = struct.unpack("<Q", wide.read(8))[0] if head == LIMIT32 else head
            extra = extra[4 + width:]
        at += 46 + n_name + n_extra + n_note
        if method == 0:
            local = _fetch(file, head, 30)
            members[name] = (head + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
    return members


# --- WARC ----------------------------------------------------------------------------------

def record(kind: str, page_id, url, digest: str, payload: bytes, length: int, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit names its original and has no payload."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
            "WARC-Target-URI": json.dumps(url) if url is not None else None,
            "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": length,
            "WARC-Page-ID": page_id, "WARC-Refers-To-Page": refers_to,
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None,
            "Content-Type": "text/html", "Content-Length": len(payload)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


def digests(pages: DataFrame) -> DataFrame:
    """Payload, its length and digest of each row; the digest is hex here."""
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    return (pages.select("page_id", "url", payload.alias("payload"))
            .withColumn("length", F.length("payload").cast("long")).withColumn("sha1", F.sha1("payload")))


def _rows(batch: pa.RecordBatch, step: int = 128) -> Iterator[tuple]:
    """Rows of a batch as Python values, made a few at a time."""
    for lo in range(0, batch.num_rows, step):
        yield from zip(*[c.to_pylist() for c in batch.slice(lo, step).columns])


def write_archives(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, force64: bool = False) -> DataFrame:
    """Write all rows as WARC records; returns (archive, records) of the archives written.

    Of equal payloads, the row of the largest id is the response; the group is found from
    digests alone, so that one payload with any number of rows costs one row a task.
    """
    rows = digests(pages)
    firsts = (rows.where(F.col("length") >= min_payload).groupBy("sha1", "length")
              .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    marked = rows.join(firsts, ["sha1", "length"], "left").select(
        "page_id", "url", "payload", "length",
        F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        where, base = locate(folder)
        where.create_dir(base, recursive=True)
        part, serial, out = TaskContext.get().partitionId(), 0, None
        done: list[tuple[str, int]] = []

        def finish():
            zipped.end()
            zipped.begin(INDEX)
            zipped.write("".join(index).encode())
            zipped.end()
            zipped.close()
            out.close()
            where.move(f"{base}/{temp}", f"{base}/{name}")
            done.append((f"{folder}/{name}", len(index)))

        for b in batches:
            for page_id, url, payload, length, refers_to in _rows(b):
                if out is None:
                    # an own name for each attempt: only the manifest of the attempt that Spark commits lists it
                    name, index = f"part-{part:05d}-{serial:04d}-{uuid.uuid4().hex}.wacz", []
                    temp = f"_{name}"
                    out = where.open_output_stream(f"{base}/{temp}")
                    zipped = StoredZip(out, force64)
                    zipped.begin(DATA)
                kind = "response" if refers_to is None else "revisit"
                digest = base32_sha1(payload)
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = squeeze.compress(record(kind, page_id, url, digest, payload if kind == "response" else b"",
                                              length, refers_to)) + squeeze.flush()
                index.append(json.dumps({"offset": zipped.size, "length": len(raw), "page": page_id}) + "\n")
                zipped.write(raw)
                if zipped.size >= ARCHIVE_BYTES:
                    finish()
                    out, serial = None, serial + 1
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    written = marked.mapInArrow(write, "archive string, records long")
    written.write.mode("overwrite").parquet(f"{folder}-manifest")
    return pages.sparkSession.read.schema("archive string, records long").parquet(f"{folder}-manifest")


def read_ranges(archives: DataFrame) -> DataFrame:
    """(archive, ranges) from the directories and indexes of ``archives``; a range is (offset, length)."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = locate(path)
                with where.open_input_file(name) as file:
                    members = directory(file, file.size())
                    base, _ = members[DATA]
                    lines = _fetch(file, *members[INDEX]).decode().splitlines()
                spans = [(base + r["offset"], r["length"]) for r in map(json.loads, lines)]
                for lo in range(0, len(spans), RANGE_RECORDS):
                    part = spans[lo:lo + RANGE_RECORDS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([[s[0] for s in part]], pa.list_(pa.int64())),
                         pa.array([[s[1] for s in part]], pa.list_(pa.int64()))], ["archive", "offsets", "lengths"])

    return archives.select("archive").mapInArrow(listed, "archive string, offsets array<long>, lengths array<long>")


def read_records(archives: DataFrame) -> DataFrame:
    """All records of ``archives``: page_id, url, record_type, refers_to, digest, length, payload."""
    schema = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
              "payload_bytes long, payload binary")

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for path, offsets, lengths in zip(*[c.to_pylist() for c in b.columns]):
                where, name = locate(path)
                rows, held = [], 0
                with where.open_input_file(name) as file:
                    for at, size in zip(offsets, lengths):
                        head, payload = parse(zlib.decompress(_fetch(file, at, size), 31))
                        number = lambda k: int(head[k]) if k in head else None
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"{path} at {at}: the payload does not fit its digest")
                        uri = head.get("WARC-Target-URI")
                        rows.append((number("WARC-Page-ID"), json.loads(uri) if uri else None, head["WARC-Type"],
                                     number("WARC-Refers-To-Page"), digest, number("WARC-Payload-Length"), payload))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    ranges = read_ranges(archives)
    return ranges.repartition(F.xxhash64("archive", "offsets")).mapInArrow(fetched, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to and read back from ZIP-packaged WARC archives."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html")
    folder = f"{scratch_dir(spark)}/wacz-{uuid.uuid4().hex}"
    return read_records(write_archives(pages, folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base32 in SQL: a SHA-1 has 160 bits, 32 groups of five.
ORACLES = {"op6_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, payload_bytes, max(page_id) AS first FROM p GROUP BY ALL),
b AS (SELECT p.*, first, array_to_string([lpad(bin(instr('0123456789abcdef', h[i]) - 1), 4, '0') FOR i IN range(1, 41)], '') AS bits
  FROM p JOIN g USING (h, payload_bytes))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(['{_LETTERS}'[1 + CAST('0b' || bits[5 * i + 1:5 * i + 5] AS INTEGER)] FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b"""}
