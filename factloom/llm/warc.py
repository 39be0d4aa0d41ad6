"""Web archives packaged in ZIP files.

A package holds ``archive/data.warc.gz`` (one gzip member per record), its index
``indexes/index.cdxj`` and ``datapackage.json``, all stored without further compression,
so that a record is a byte range of the package.  The reader parses the central and ZIP64
directories, finds where the stored members begin, reads the index, and range-reads the
records that the index names; nothing is extracted.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, shared_path, stored, whole, width

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PACKAGE_BYTES = 64 << 20
#: payloads shorter than this are always written in full
LEAST_PAYLOAD = 100
#: ranges of the index that lie this close are read together
READ_BYTES = 4 << 20

# ------------------------------------------------------------------ records


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member.  A revisit keeps the HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_number(page_id)}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + _header_text(url))
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{_number(refers_to)}>", f"WARC-Truncated: length",
        ]
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _number(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _page(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix("urn:page:")
    return None if name == "none" else int(name)


def _header_text(value: str) -> str:
    """Line breaks and the escape sign itself are percent-encoded: a header is one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _header_value(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def parse_record(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": _header_value(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "record_type": fields["WARC-Type"], "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
        "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload,
    }


# ------------------------------------------------------------------ packages


class _Package:
    """Writes records to one ZIP package; nothing but the index lines stays in memory."""

    def __init__(self, path: str):
        fs, name = filesystem(path)
        self.path, self.offset, self.lines, self._fs = path, 0, [], fs
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        self._out = fs.open_output_stream(name)
        self._zip = zipfile.ZipFile(self._out, "w", zipfile.ZIP_STORED)
        self._member = self._zip.open(ARCHIVE, "w", force_zip64=True)

    def add(self, page_id: int | None, url: str | None, kind: str, digest: str, data: bytes) -> None:
        self._member.write(data)
        about = {"page": page_id, "url": url, "type": kind, "digest": digest, "offset": self.offset, "length": len(data)}
        self.lines.append(f"{_number(page_id)} {DATE} {json.dumps(about)}\n")
        self.offset += len(data)

    def close(self) -> int:
        self._member.close()
        self._zip.writestr(INDEX, "".join(self.lines))
        self._zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}))
        self._zip.close()
        self._out.close()
        return len(self.lines)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write one record per row; returns the manifest ``path, records`` of the packages.

    Of rows with equal payloads of at least ``LEAST_PAYLOAD`` bytes, the one with the
    smallest id (null last, then the first row) is a response, the others revisit it.
    Null html is an empty payload; null ids and urls are written as absent.  The manifest
    names only packages of tasks that succeeded, so a lost executor leaves at most files
    that nobody reads.  ``pages`` must give the same rows when read twice (a table).
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(whole(html_col), "UTF-8").alias("payload"), F.monotonically_increasing_id().alias("row"),
    )
    facts = rows.select("row", "page_id", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    first = (
        facts.filter(F.col("size") >= LEAST_PAYLOAD).groupBy("digest")
        .agg(F.min(F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("order"), "row", "page_id")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", "first")
    )
    marked = facts.join(first, "digest", "left").select(
        "row", "size", "digest", (F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))).alias("revisit"), F.col("first.page_id").alias("response")
    )
    full = rows.join(marked, "row").select(
        "page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "size", "digest", "revisit", F.when(F.col("revisit"), F.col("response")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for b in batches:
            for page_id, url, payload, size, digest, revisit, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if package is None:
                    package = _Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                package.add(page_id, url, "revisit" if revisit else "response", digest, record(page_id, url, payload, size, digest, refers_to, revisit))
                if package.offset >= package_bytes:
                    done.append((package.path, package.close()))
                    package = None
        if package is not None:
            done.append((package.path, package.close()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return stored(full.mapInArrow(write, "path string, records long"), "manifest")


# ------------------------------------------------------------------ ZIP directories


def _range(source, offset: int, length: int) -> bytes:
    source.seek(offset)
    got = source.read(length)
    if len(got) != length:
        raise ValueError("package ends early")
    return got


def central_directory(source, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file: name -> (method, stored size, offset of the local header)."""
    tail_at = max(0, size - 65557)  # the end record is 22 bytes and a comment of at most 65,535
    tail = _range(source, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == entries or 0xFFFFFFFF in (length, offset):
        locator = _range(source, tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end64 = _range(source, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
    directory, members, p = _range(source, offset, length), {}, 0
    for _ in range(entries):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", directory, p + 10)
        packed, plain = struct.unpack_from("<II", directory, p + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, p + 28)
        header, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # ZIP64: only the fields that overflow, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            q += 4 + n
        members[name] = (method, packed, header)
        p += 46 + n_name + n_extra + n_comment
    return members


def stored_member(source, members: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    """Offset and length of a stored member's bytes in the package."""
    method, length, header = members[name]
    if method != zipfile.ZIP_STORED:
        raise ValueError(f"{name} is compressed: it can't be read by ranges")
    local = _range(source, header, 30)
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return header + 30 + n_name + n_extra, length


def _lines(source, offset: int, length: int) -> Iterator[bytes]:
    rest, end = b"", offset + length
    while offset < end:
        n = min(READ_BYTES, end - offset)
        *whole_lines, rest = (rest + _range(source, offset, n)).split(b"\n")
        offset += n
        yield from whole_lines


def package_records(path: str) -> Iterator[dict]:
    """Records of one package by its index, read in ranges of about ``READ_BYTES``."""
    fs, name = filesystem(path)
    with contextlib.closing(fs.open_input_file(name)) as source:
        members = central_directory(source, source.size())
        base, length = stored_member(source, members, ARCHIVE)
        index = stored_member(source, members, INDEX)
        group: list[tuple[int, int]] = []

        def read() -> Iterator[dict]:
            start, stop = group[0][0], group[-1][0] + group[-1][1]
            data = _range(source, base + start, stop - start)
            for at, n in group:
                yield parse_record(data[at - start : at - start + n])
            group.clear()

        for line in _lines(source, *index):
            about = json.loads(line.split(b" ", 2)[2])
            if about["offset"] + about["length"] > length:
                raise ValueError("index points outside the archive")
            if group and (about["offset"] != group[-1][0] + group[-1][1] or about["offset"] - group[0][0] >= READ_BYTES):
                yield from read()
            group.append((about["offset"], about["length"]))
        if group:
            yield from read()


_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)
RECORD_DDL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the packages in ``manifest.path``; payloads of revisits are null.

    A package is one task's work and of bounded size.  Damaged packages fail the job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                for r in package_records(path):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if size > 16 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return manifest.select("path").repartition(width(manifest.sparkSession), "path").mapInArrow(read, RECORD_DDL)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to packages in the shared folder and read every record back."""
    return read_archives(write_archives(pages, shared_path(spark, "archives")))
