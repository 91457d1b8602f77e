"""Web archives packaged in ZIP files: written as stored members with an index, read by byte ranges without extraction."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, scratch_path, stored
from .files import Ranges, write_file

# Fixed values of the ZIP format: signatures, sizes and markers.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
STORED, DEFLATED, ZIP64_EXTRA = 0, 8, 1

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which a task begins a new package.
PACKAGE_BYTES = 256 << 20
#: Values of the digest bucket: the most rows that are ever broadcast.
BUCKETS = 1 << 20


class ZipError(ValueError):
    """The bytes are not a ZIP package that this reader understands."""


@dataclass
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


Read = Callable[[int, int], bytes]


def read_directory(read: Read, size: int) -> list[Member]:
    """The central directory, found from the end of the package; ZIP64 records count where the plain ones overflow."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ZipError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == count or FULL32 in (length, start):
        locator_at = tail_at + at - 20
        locator = read(locator_at, 20) if locator_at >= 0 else b""
        if locator[:4] == LOCATOR64:
            record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != END64:
                raise ZipError("no ZIP64 end of central directory where its locator points")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
    if start + length > size:
        raise ZipError("the central directory lies outside the package")
    directory, at, members = read(start, length), 0, []
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL or at + 46 > len(directory):
            raise ZipError("the central directory breaks off")
        flags, method, _, _, crc, packed, whole, names, extras, comments = struct.unpack_from("<HHHHIIIHHH", directory, at + 8)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + names : at + 46 + names + extras]
        whole, packed, header = _zip64(extra, whole, packed, header)
        members.append(Member(name, method, crc, packed, whole, header))
        at += 46 + names + extras + comments
    return members


def _zip64(extra: bytes, *fields: int) -> tuple[int, ...]:
    """Size, packed size and header place; each that is full stands, in this order, in the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_EXTRA:
            longs = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            try:
                return tuple(next(longs) if f == FULL32 else f for f in fields)
            except (StopIteration, RuntimeError) as e:
                raise ZipError("a ZIP64 field is too short") from e
        at += 4 + length
    return fields


def data_start(read: Read, member: Member) -> int:
    """Where a member's bytes begin: behind its local header, whose own name and extra lengths count."""
    header = read(member.header, 30)
    if header[:4] != LOCAL:
        raise ZipError(f"no local header for {member.name}")
    names, extras = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + names + extras


def member_bytes(read: Read, member: Member) -> bytes:
    """A small member, such as an index, whole."""
    data = read(data_start(read, member), member.packed)
    if member.method == DEFLATED:
        data = zlib.decompress(data, -15)
    elif member.method != STORED:
        raise ZipError(f"method {member.method} of {member.name}")
    if zlib.crc32(data) != member.crc:
        raise ZipError(f"{member.name} is damaged")
    return data


class ZipWriter:
    """Stored members written in one go: sizes follow the data and stand in the central directory. ``zip64``: long records even where short ones would do."""

    def __init__(self, stream, zip64: bool = False) -> None:
        self.stream, self.zip64, self.at, self.members = stream, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append(Member(name, STORED, 0, 0, 0, self.at))
        raw = name.encode()
        # flags: sizes follow (bit 3), name in UTF-8 (bit 11); 1980-01-01 as the time
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x808, STORED, 0, 33, 0, 0, 0, len(raw), 0) + raw)

    def write(self, data: bytes) -> None:
        m = self.members[-1]
        m.crc, m.size, m.packed = zlib.crc32(data, m.crc), m.size + len(data), m.packed + len(data)
        self._put(data)

    def end(self) -> None:
        m = self.members[-1]
        long = self.zip64 or m.size >= FULL32
        self._put(b"PK\7\10" + struct.pack("<IQQ" if long else "<III", m.crc, m.packed, m.size))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            raw = m.name.encode()
            long = self.zip64 or max(m.size, m.header) >= FULL32
            extra = struct.pack("<HHQQQ", ZIP64_EXTRA, 24, m.size, m.packed, m.header) if long else b""
            sizes = (FULL32, FULL32) if long else (m.packed, m.size)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x808, STORED, 0, 33, m.crc, *sizes, len(raw), len(extra), 0, 0, 0, 0, FULL32 if long else m.header) + raw + extra)
        length, n, at = self.at - start, len(self.members), self.at
        if long := self.zip64 or n >= FULL16 or at >= FULL32:
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start) + LOCATOR64 + struct.pack("<IQI", 0, at, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, *((FULL16, FULL16, FULL32, FULL32) if long else (n, n, length, start)), 0))
        self.stream.close()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member. Line ends in field values become spaces, so that no value can forge a field."""
    lines = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in lines) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one record, gzipped or plain."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ZipError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields.get("content-length", 0))
    if len(rest) < length:
        raise ZipError("a record breaks off")
    return fields, rest[:length]


def http_payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def record_uuid(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def page_record(page_id: int | None, url: str | None, data: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """A response with its payload, or a revisit without; both tell the digest and length of the full payload."""
    digest = base32_sha1(data)
    fields = [("WARC-Record-ID", record_uuid(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url or f"urn:page:{page_id}"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Payload-Length", str(len(data)))]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(data)
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_uuid(refers_to)), ("Refers-To-Page-ID", str(refers_to)), ("Content-Type", "application/http;msgtype=response")]
        return warc_record("revisit", fields, head), digest
    fields.append(("Content-Type", "application/http;msgtype=response"))
    return warc_record("response", fields, head + data), digest


class Package:
    """One package being written: archive, then index, then a description."""

    def __init__(self, folder: str, zip64: bool) -> None:
        self.uri, stream = write_file(folder, ".wacz")
        self.zip, self.lines, self.at = ZipWriter(stream, zip64), [], 0
        self.zip.begin(ARCHIVE)

    def add(self, page_id: int | None, url: str | None, data: bytes, refers_to: int | None, revisit: bool) -> None:
        record, digest = page_record(page_id, url, data, refers_to, revisit)
        key = " ".join((url or f"urn:page:{page_id}").split()) or "-"
        self.lines.append(f"{key.replace(' ', '%20')} 19700101000000 " + json.dumps({"filename": ARCHIVE, "offset": self.at, "length": len(record), "digest": digest}))
        self.zip.write(record)
        self.at += len(record)

    def close(self) -> tuple[str, int]:
        self.zip.end()
        for name, data in ((INDEX, "".join(x + "\n" for x in self.lines)), ("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE, "bytes": self.at}, {"path": INDEX}]}))):
            self.zip.begin(name)
            self.zip.write(data.encode())
            self.zip.end()
        self.zip.close()
        return self.uri, len(self.lines)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """A record per page in packages in the shared folder; returns the manifest: uri, records.

    Of pages with equal payloads (by SHA-256) of ``least_bytes`` at least, that with the largest id is a response and the
    others revisit it. Pages whose digest falls in no bucket with a repeated digest, nearly all of them, are written where they are
    read; only the others are shuffled, by a join that Spark can split.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    data = F.coalesce(quoted(html_col), F.lit("")).cast("binary")
    base = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), data.alias("data"))
    base = base.withColumn("h", F.when(F.length("data") >= least_bytes, F.unhex(F.sha2("data", 256)))).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(BUCKETS)))
    groups = stored(base.where("h is not null").groupBy("h").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("gh"), "first_id"), "revisits")
    repeated = F.broadcast(groups.select(F.pmod(F.xxhash64("gh"), F.lit(BUCKETS)).alias("bucket")).distinct())
    fields = ["page_id", "url", "data"]
    alone = base.join(repeated, "bucket", "left_anti").select(*fields, F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    joined = base.join(repeated, "bucket", "left_semi").join(groups, F.col("h") == F.col("gh"), "left")
    revisit = F.col("gh").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    several = joined.select(*fields, F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))
    folder = scratch_path(spark, "warc")

    def run(batches):
        package = None
        for b in batches:
            done = []
            for row in zip(*(b.column(c) for c in (*fields, "refers_to", "revisit")), strict=True):
                package = package or Package(folder, zip64)
                package.add(*(x.as_py() for x in row))
                if package.at >= package_bytes:
                    done.append(package.close())
                    package = None
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["uri", "records"])
        if package is not None:
            uri, n = package.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["uri", "records"])

    return stored(alone.unionByName(several).mapInArrow(run, "uri string, records long"), "packages")


def package_records(reader: Ranges, uri: str) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """(member, offset, fields, block) of each record that the package's indexes name, or, without an index, of each in its archives one after another."""
    reader.open(uri)

    def read(at: int, length: int) -> bytes:
        return reader.read(uri, at, length)

    members = {m.name: m for m in read_directory(read, reader.size)}
    archives = {}
    for name, m in members.items():
        if name.startswith("archive/"):
            if m.method != STORED:
                raise ZipError(f"{name} is not stored, so it has no ranges")
            archives[name] = (data_start(read, m), m.size)
    indexes = [m for n, m in members.items() if n.startswith("indexes/") and n.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))]
    if indexes:
        for m in indexes:
            raw = member_bytes(read, m)
            if m.name.endswith(".gz"):
                raw = zlib.decompress(raw, 47)
            entries = [json.loads(line.split(" ", 2)[2]) for line in raw.decode().splitlines() if line.strip() and not line.startswith("!")]
            for e in sorted(entries, key=lambda e: (e["filename"], int(e["offset"]))):
                name = e["filename"] if e["filename"] in archives else f"archive/{e['filename']}"
                start, size = archives[name]
                offset, length = int(e["offset"]), int(e["length"])
                if not 0 <= offset <= offset + length <= size:
                    raise ZipError(f"the index points outside {name}")
                yield name, offset, *parse_record(read(start + offset, length))
        return
    for name, (start, size) in archives.items():
        at = 0
        while at < size:
            length = _record_length(lambda a, n, s=start: read(s + a, n), at, size)
            yield name, at, *parse_record(read(start + at, length))
            at += length


def _record_length(read: Read, at: int, size: int) -> int:
    """Of the record at ``at``: a gzip member ends where its stream does, a plain record after its Content-Length and two line ends."""
    if read(at, min(2, size - at)) == b"\x1f\x8b":
        unpack, n = zlib.decompressobj(31), 0
        while not unpack.eof:
            part = read(at + n, min(1 << 16, size - at - n))
            if not part:
                raise ZipError("a gzip member breaks off")
            unpack.decompress(part)
            n += len(part) - len(unpack.unused_data)
        return n
    n = 1 << 12
    while b"\r\n\r\n" not in (head := read(at, min(n, size - at))):
        if n >= size - at:
            raise ZipError("a record has no end of fields")
        n *= 2
    head = head.partition(b"\r\n\r\n")[0]
    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    return min(len(head) + 8 + length, size - at)


def read_archives(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record: uri, member, record_offset, record_type, target_uri, record_id, page_id, refers_to, payload_bytes, payload_digest and, if asked for, payload.

    A task reads whole packages by range. Of a response, length and digest are those of the payload that was
    read and must be those that the record tells; of a revisit, whose payload lies elsewhere, those that it tells. page_id and refers_to
    are null where a record has none.
    """
    spark = packages.sparkSession
    n = max(1, min(packages.count(), 100_000))

    def number(x: str | None) -> int | None:
        return None if x in (None, "None") else int(x)

    def run(batches):
        reader = Ranges()
        for b in batches:
            for uri in b.column("uri").to_pylist():
                rows = []
                for member, offset, f, block in package_records(reader, uri):
                    if f.get("warc-type") not in ("response", "revisit", "resource"):
                        continue
                    told = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    payload = None if f["warc-type"] == "revisit" else http_payload(block)
                    length, digest = (number(f.get("payload-length")), told) if payload is None else (len(payload), base32_sha1(payload))
                    if told and told != digest:
                        raise ZipError(f"the payload at {offset} of {uri} isn't the one that its record tells")
                    rows.append((uri, member, offset, f["warc-type"], f.get("warc-target-uri"), f.get("warc-record-id"), number(f.get("page-id")), number(f.get("refers-to-page-id")), length, digest, payload if payloads else None))
                    if len(rows) >= 500:
                        yield batch(rows)
                        rows = []
                yield batch(rows)
        reader.close()

    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["uri", "member", "record_offset", "record_type", "target_uri", "record_id", "page_id", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    schema = "uri string, member string, record_offset long, record_type string, target_uri string, record_id string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
    out = packages.select("uri").repartition(n).mapInArrow(run, schema)
    bounded_batches(spark)
    return out if payloads else out.drop("payload")


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **how) -> DataFrame:
    """One row per row of ``pages``, written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html counts as empty, and empty payloads are equal payloads like others. A null id is below all others. Rows repeated with the largest id of
    their group are responses each. A null url becomes urn:page:<id>. An empty table gives no rows.
    """
    return read_archives(write_archives(pages, id_col, url_col, html_col, **how), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
