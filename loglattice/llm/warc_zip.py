"""Web pages as WARC records in ZIP packages, read back by ranges.

A package is a ZIP file with stored members only:

    archive/data.warc.gz    records, each compressed on its own
    indexes/index.cdxj      a line per record: its place and size in the archive

As members are stored, a record's bytes lie at a known place of the package. The reader parses the
end record, its ZIP64 form where there is one, and the central directory, and then reads single records by
offset; nothing is extracted and no other byte is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import work_dir, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads from this size on are stored once; equal ones revisit that record.
LEAST_REVISIT = 1000
#: A package is closed once it holds so many payload bytes.
PACKAGE_BYTES = 64_000_000
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    if refers_to is not None:
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = fields["WARC-Type"] == "response"
    if response and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")

    def number(field: str) -> int | None:
        value = fields.get(field, "<urn:page:>").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    return {
        "page_id": number("WARC-Record-ID"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "url": fields.get("WARC-Target-URI"),
        "payload": body if response else None,
    }


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset, size) of the stored members of a ZIP file, from its directories alone."""
    tail_at = max(0, size - 65_557)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, begin = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", tail, locator + 8)
        file.seek(at)
        wide = file.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, begin = struct.unpack_from("<QQQ", wide, 32)
    file.seek(begin)
    directory, at, out = file.read(length), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full = struct.unpack_from("<H", directory, at + 10)[0], *struct.unpack_from("<II", directory, at + 20)
        names, extras, remarks = struct.unpack_from("<HHH", directory, at + 28)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + names].decode()
        extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                # The 64-bit values of those fields that are all ones, in this order.
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            k += 4 + n
        if method == 0:
            file.seek(local)
            header = file.read(30)
            if header[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            out[name] = (local + 30 + sum(struct.unpack_from("<HH", header, 26)), packed)
        at += 46 + names + extras + remarks
    return out


class Package:
    """Writes one ZIP package to a stream; `force_zip64` is for packages beyond 4 GB, and for tests."""

    def __init__(self, stream, force_zip64: bool = False):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.wide = force_zip64
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = self.payload = 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        packed = gzip.compress(record(page_id, url, payload, digest, refers_to), compresslevel=4, mtime=0)
        self.archive.write(packed)
        self.lines.append(json.dumps({"page": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)
        self.payload += len(payload)

    def close(self) -> None:
        self.archive.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()


def read_package(file, size: int) -> Iterator[dict]:
    """The records of a package, each by one read of its own range."""
    found = members(file, size)
    at, length = found[INDEX]
    file.seek(at)
    index = file.read(length).decode()
    begin, _ = found[ARCHIVE]
    for line in index.split("\n") if index else ():
        entry = json.loads(line)
        file.seek(begin + entry["offset"])
        yield parse_record(gzip.decompress(file.read(entry["length"])))


def write_packages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes a record per row of `pages` to packages in the shared folder; returns the manifest (file, records).

    Missing payloads are empty. Of rows with equal payloads of at least `LEAST_REVISIT` bytes, those with the
    largest key are responses, all others revisit it; smaller ones, and rows without a key where no
    equal row has one, are responses. A missing URL is left out. A package's name is its own, so a task that
    runs twice leaves a file that the manifest does not name. Other columns are not used.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"))
    marked = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= LEAST_REVISIT
    # A row per payload, combined before it is shuffled: however many copies, they meet as one row.
    holders = (
        rows.where(large)
        .groupBy(F.sha1(F.col("html").cast("binary")).alias("digest"))
        .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "holder")
    )
    linked = marked.join(holders, "digest", "left").select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(large & ~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"),
    )
    folder = work_dir(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = f"file://{folder}"
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder)
        package = stream = name = None

        def closed() -> pa.RecordBatch:
            package.close()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(package.lines)])], names=["file", "records"])

        for batch in batches:
            columns = [batch.column(k) for k in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                if package is None:
                    name = f"{folder}/{uuid.uuid4().hex}.wacz"
                    stream = target.open_output_stream(f"{base}/{name.rsplit('/', 1)[1]}")
                    package = Package(stream)
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in columns)
                package.add(page_id, url, html.encode(), digest, refers_to)
                if package.payload >= PACKAGE_BYTES:
                    yield closed()
                    package = None
        if package is not None:
            yield closed()

    return written(linked.mapInArrow(put, "file string, records long"), "warc-manifest")


def read_packages(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of all packages: page_id, payload_bytes, payload_digest, record_type, refers_to, on demand payload and url."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payloads:
        names, types = [*names, "url", "payload"], [*types, pa.string(), pa.binary()]
        schema += ", url string, payload binary"

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=t) for n, t in zip(names, types)], names=names)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                system, place = fs.FileSystem.from_uri(name)
                with system.open_input_file(place) as file:
                    rows = []
                    for found in read_package(file, file.size()):
                        rows.append(found)
                        if len(rows) == 1000:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(parts, "file").mapInArrow(get, schema)
