"""TIFF media columns: read and write images held as bytes, one row per page."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, bounded_batches, quoted, stored

# Fixed values of TIFF 6.0: tag numbers, field sizes and codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
RAW, LZW, ADOBE_DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


class TiffError(ValueError):
    """The bytes are not a TIFF that this reader decodes."""


@dataclass
class Page:
    """pixels: height x width x samples, of 8- or 16-bit unsigned integers."""

    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """PackBits: a count n below 128 copies n + 1 bytes, above 128 repeats a byte 257 - n times, and 128 does nothing. Ends at ``most`` bytes."""
    out, i = bytearray(), 0
    while i < len(data) and (most is None or len(out) < most):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out)


_RUN = re.compile(rb"(.)\1{1,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            part = data[k : min(end, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        literal(run.start())
        at = run.end()
        out += bytes((257 - (at - run.start()), data[run.start()]))
    literal(len(data))
    return bytes(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early; 256 clears the table and 257 ends, as do ``most`` bytes."""
    out, table, width, before = [], [], 9, None
    bits = have = 0
    left = float("inf") if most is None else most
    for byte in data:
        bits = (bits << 8 | byte) & 0xFFFFFF
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes((k,)) for k in range(256)] + [b"", b""], 9, None
            continue
        if not table:
            raise TiffError("LZW data doesn't begin with a clear code")
        if before is None:
            entry = table[code] if code < 256 else None
        elif code < len(table):
            entry = table[code]
        else:
            entry = before + before[:1] if code == len(table) else None
        if entry is None:
            raise TiffError(f"LZW code {code} isn't in the table")
        if before is not None and len(table) < 4096:
            table.append(before + entry[:1])
        out.append(entry)
        left -= len(entry)
        if left <= 0:
            break
        before = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    bits = have = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    width, table, seen = 9, {bytes((k,)): k for k in range(256)}, b""
    put(256, width)
    for k in range(len(data)):
        byte = data[k : k + 1]
        if seen + byte in table:
            seen += byte
            continue
        put(table[seen], width)
        table[seen + byte] = len(table) + 2
        seen = byte
        width = 9 + (len(table) + 2 >= 512) + (len(table) + 2 >= 1024) + (len(table) + 2 >= 2048)
        if len(table) + 2 >= 4094:
            put(256, width)
            width, table = 9, {bytes((k,)): k for k in range(256)}
    if seen:
        put(table[seen], width)
        # the reader has added an entry for this code as well
        width = 9 + (len(table) + 3 >= 512) + (len(table) + 3 >= 1024) + (len(table) + 3 >= 2048)
    put(257, width)
    if have:
        put(0, 8 - have)
    return bytes(out)


def expand(data: bytes, compression: int, size: int) -> bytes:
    """One strip or tile, ``size`` bytes after decoding; what it would expand to beyond them isn't made."""
    if compression == RAW:
        got = data
    elif compression == PACKBITS:
        got = unpack_bits(data, size)
    elif compression == LZW:
        got = lzw_decode(data, size)
    elif compression in (ADOBE_DEFLATE, OLD_DEFLATE):
        got = zlib.decompressobj().decompress(data, max(1, size))
    else:
        raise TiffError(f"compression {compression} isn't known")
    if len(got) < size:
        raise TiffError(f"a strip or tile has {len(got)} bytes, not {size}")
    return got[:size]


class Directories:
    """Walks the chain of image directories of a classic TIFF or BigTIFF; a chain that comes back to itself is an error."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None or len(data) < 8:
            raise TiffError("no TIFF header")
        self.order = order
        magic = self.take("H", 2)[0]
        if magic not in (42, 43):
            raise TiffError(f"magic number {magic}")
        self.big = magic == 43
        self.first = self.take("Q", 8)[0] if self.big else self.take("I", 4)[0]

    def take(self, form: str, at: int, n: int = 1) -> tuple:
        try:
            return struct.unpack_from(f"{self.order}{n}{form}", self.data, at)
        except struct.error as e:
            raise TiffError(f"it ends before byte {at}") from e

    def __iter__(self) -> Iterator[dict[int, tuple]]:
        at, seen = self.first, set()
        count, step, inline, place = ("Q", 20, 8, 12) if self.big else ("H", 12, 4, 8)
        word = "Q" if self.big else "I"
        while at:
            if at in seen:
                raise TiffError("the directories form a ring")
            seen.add(at)
            n = self.take(count, at)[0]
            start = at + struct.calcsize(f"={count}")
            tags = {}
            for k in range(n):
                entry = start + k * step
                tag, kind = self.take("H", entry, 2)
                if kind not in FIELD:
                    continue
                number = self.take(word, entry + 4)[0]
                fits = number * struct.calcsize(f"={FIELD[kind]}") <= inline
                tags[tag] = self.take(FIELD[kind], entry + place if fits else self.take(word, entry + place)[0], number)
            yield tags
            at = self.take(word, start + n * step)[0]


def _one(tags: dict[int, tuple], tag: int, default: int | None = None) -> int:
    got = tags.get(tag)
    if not got:
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default
    return got[0]


#: A page may have so many bytes after decoding, unless a reader is told otherwise.
PAGE_BYTES = 1 << 28


def read_pages(data: bytes, page_bytes: int = PAGE_BYTES) -> Iterator[Page]:
    """The pages in the order of the directories: samples of 1, 8 or 16 bits, together or in planes, in strips or tiles. Samples of one bit
    are a byte each, 0 or 1. A page of over ``page_bytes`` is an error before any memory is taken for it."""
    walk = Directories(data)
    for number, tags in enumerate(walk):
        width, height = _one(tags, WIDTH), _one(tags, HEIGHT)
        samples, packing, predictor = _one(tags, SAMPLES, 1), _one(tags, COMPRESSION, 1), _one(tags, PREDICTOR, 1)
        bits = tags.get(BITS, (1,))
        if len(set(bits)) > 1 or bits[0] not in (1, 8, 16):
            raise TiffError(f"samples of {bits[:4]} bits aren't decoded")
        if predictor not in (1, 2) or (predictor == 2 and bits[0] == 1):
            raise TiffError(f"predictor {predictor} isn't known for samples of {bits[0]} bits")
        kind = np.dtype(f"{walk.order}u{max(8, bits[0]) // 8}")
        if width * height * samples * kind.itemsize > page_bytes:
            raise TiffError(f"a page of {width} x {height} x {samples} samples has over {page_bytes} bytes")
        planes = samples if _one(tags, PLANAR, 1) == 2 else 1
        inside = samples // planes
        tiled = TILE_OFFSETS in tags
        if tiled:
            wide, high = _one(tags, TILE_WIDTH), _one(tags, TILE_HEIGHT)
            offsets, counts = tags[TILE_OFFSETS], tags.get(TILE_COUNTS, ())
        else:
            wide, high = width, min(_one(tags, ROWS_PER_STRIP, height), height)
            offsets, counts = tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ())
        if wide * high * inside * kind.itemsize > page_bytes:
            raise TiffError(f"tiles of {wide} x {high} have over {page_bytes} bytes")
        across, down = -(-width // max(1, wide)), -(-height // max(1, high))
        if min(len(offsets), len(counts)) < across * down * planes:
            raise TiffError("too few strips or tiles")
        line = -(-wide * inside * bits[0] // 8)
        pixels = np.zeros((height, width, samples), kind.newbyteorder("="))
        for k in range(across * down * planes):
            plane, place = divmod(k, across * down)
            y, x = place // across * high, place % across * wide
            rows = high if tiled else min(high, height - y)
            part = expand(data[offsets[k] : offsets[k] + counts[k]], packing, rows * line)
            if bits[0] == 1:
                block = np.unpackbits(np.frombuffer(part, np.uint8).reshape(rows, line), axis=1)[:, : wide * inside].reshape(rows, wide, inside)
            else:
                block = np.frombuffer(part, kind).reshape(rows, wide, inside).astype(pixels.dtype)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=pixels.dtype)
            pixels[y : y + rows, x : x + wide, plane * inside : (plane + 1) * inside] = block[: height - y, : width - x]
        yield Page(number, width, height, samples, bits[0], packing, predictor, tiled, pixels)


def write_pages(pages: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """A classic TIFF of pages (height x width x samples, 8 or 16 bits), in strips, or in tiles of (width, height)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for pixels in pages:
        height, width, samples = pixels.shape
        kind = pixels.dtype.newbyteorder(order)
        wide, high = tile or (width, min(rows_per_strip, height))
        offsets, counts = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                block = pixels[y : y + high, x : x + wide]
                if tile:
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                raw = block.astype(kind).tobytes()
                packed = {RAW: lambda b: b, PACKBITS: pack_bits, LZW: lzw_encode}.get(compression, lambda b: zlib.compress(b, level))(raw)
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed
        out += b"\0" * (len(out) % 2)
        bits = 8 * kind.itemsize
        tags = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [bits] * samples), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if samples >= 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_WIDTH: (4, [wide]), TILE_HEIGHT: (4, [high]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [high]), STRIP_COUNTS: (4, counts)}
        entries = b""
        for tag, (kind_code, values) in sorted(tags.items()):
            body = struct.pack(f"{order}{len(values)}{FIELD[kind_code]}", *values)
            if len(body) > 4:
                place = struct.pack(f"{order}I", len(out))
                out += body + b"\0" * (len(body) % 2)
            else:
                place = body.ljust(4, b"\0")
            entries += struct.pack(f"{order}HHI", tag, kind_code, len(values)) + place
        struct.pack_into(f"{order}I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack(f"{order}H", len(tags)) + entries + b"\0\0\0\0"
    return bytes(out)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
_PAGE_FIELDS = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())]


def tiff_pages(df: DataFrame, keys: str | list[str], media_col: str, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """One row per page of each image: the columns ``keys``, what its directory says, and the decoded samples (row by row, little-endian).

    Bytes that aren't a TIFF, or break off, or claim a page of over ``page_bytes``, give one more row with page null and the reason in
    ``error``; so does null. Pages before the fault are kept. Images are read one by one in the task that scans them, without a
    shuffle; an image's pages follow each other.
    """
    bounded_batches(df.sparkSession)
    keys = [keys] if isinstance(keys, str) else keys

    def pages(data: bytes | None) -> Iterator[tuple]:
        try:
            if data is None:
                raise TiffError("no bytes")
            for p in read_pages(data, page_bytes):
                yield p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes(), None
        except (TiffError, zlib.error) as e:
            yield *[None] * 9, str(e)

    def run(batches):
        for b in batches:
            at, rows, size = [], [], 0

            def out(b=b, at=at, rows=rows):
                own = b.select([f"__key{k}" for k in range(len(keys))]).take(pa.array(at, pa.int32()))
                return pa.RecordBatch.from_arrays([*own.columns, *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_PAGE_FIELDS))], [*own.schema.names, *(n for n, _ in _PAGE_FIELDS)])

            for k, data in enumerate(b.column("media")):
                for row in pages(data.as_py()):
                    at.append(k)
                    rows.append(row)
                    size += len(row[8] or b"")
                    if size > BATCH_BYTES:
                        yield out()
                        at.clear()
                        rows.clear()
                        size = 0
            if rows:
                yield out()

    chosen = df.select(*[quoted(c).alias(f"__key{k}") for k, c in enumerate(keys)], quoted(media_col).cast("binary").alias("media"))
    kinds = "".join(f"__key{k} {chosen.schema[f'__key{k}'].dataType.simpleString()}, " for k in range(len(keys)))
    return chosen.mapInArrow(run, kinds + PAGE_SCHEMA).select(*[F.col(f"__key{k}").alias(c) for k, c in enumerate(keys)], *[n for n, _ in _PAGE_FIELDS])


#: A payload is laid out in pixels of three samples, so many to a row, and in pages of at most so many rows. Decoded bytes handed on at once.
ROW_PIXELS, SAMPLES_PER_PIXEL, PAGE_ROWS, BATCH_BYTES = 64, 3, 4096, 8 << 20
ROW_BYTES = ROW_PIXELS * SAMPLES_PER_PIXEL
#: Codec, predictor and tile of a payload, dealt by the payload's CRC-32.
LAYOUTS = ((ADOBE_DEFLATE, 1, None), (PACKBITS, 1, None), (LZW, 1, None), (ADOBE_DEFLATE, 2, (32, 16)))


def payload_image(data: bytes) -> bytes:
    """The bytes, padded with spaces to a positive multiple of ROW_BYTES, as samples of a TIFF of one page or more, in one of LAYOUTS."""
    data += b" " * (max(ROW_BYTES, -(-len(data) // ROW_BYTES) * ROW_BYTES) - len(data))
    rows = np.frombuffer(data, np.uint8).reshape(-1, ROW_PIXELS, SAMPLES_PER_PIXEL)
    codec, predictor, tile = LAYOUTS[zlib.crc32(data) % len(LAYOUTS)]
    return write_pages([rows[y : y + PAGE_ROWS] for y in range(0, len(rows), PAGE_ROWS)], codec, predictor, tile=tile)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, the text as a TIFF in ``media``, and which image of its partition that is, written to the shared folder and read from there."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        n = 0
        for b in batches:
            data = b.column("data").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array([payload_image(x) for x in data], pa.binary()), pa.array(range(n, n + len(data)), pa.int64())], ["doc_id", "n_bytes", "media", "image"])
            n += len(data)

    return stored(blobs(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary, image long"), "tiff")


class Digest:
    """What the page rows of one image add up to: digests of the samples, and a feature string of pages, size, the mean of each channel, the mean
    step between neighbours in a row, and entropy."""

    def __init__(self, head: dict) -> None:
        self.head, self.hash, self.tail, self.size = head, hashlib.sha256(), b"", 0
        self.counts, self.sums, self.step, self.pages, self.rows, self.width = np.zeros(256, np.int64), np.zeros(SAMPLES_PER_PIXEL), 0, 0, 0, 0

    def add(self, width: int, height: int, pixels: bytes) -> None:
        self.hash.update(pixels)
        self.tail = (self.tail + pixels[-16:])[-16:]
        self.size += len(pixels)
        x = np.frombuffer(pixels, np.uint8).reshape(height, width, -1)
        self.counts += np.bincount(x.reshape(-1), minlength=256)
        self.sums += x.sum((0, 1))
        self.step += int(np.abs(np.diff(x.astype(np.int16), axis=1)).sum())
        self.pages, self.rows, self.width = self.pages + 1, self.rows + height, width

    def row(self) -> tuple:
        share = self.counts[self.counts > 0] / self.size
        means = ",".join(f"{x:.3f}" for x in self.sums / (self.size / SAMPLES_PER_PIXEL))
        feature = f"pages={self.pages};size={self.width}x{self.rows};mean={means};step={self.step / self.size:.3f};entropy={abs(-(share * np.log2(share)).sum()):.4f}"
        h = self.head
        return h["doc_id"], h["n_bytes"], self.size, self.hash.hexdigest(), zlib.crc32(self.tail), h["media_bytes"], h["media_sha256"], feature


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: what the text, stored as a TIFF and read back as rows of pages, holds.

    Codec, tiles and predictor are dealt by the payload's CRC-32 (see LAYOUTS), so that each is on the path and equal texts give equal
    values. Null text counts as empty: one row of spaces. A null id stays null; rows repeated are images of their own. A damaged stored
    image fails the query rather than lose a row. An empty table gives no rows.
    """
    images = store_texts(docs, id_col, text_col).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "image", "media")
    heads = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "image"]
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    def fold(batches):
        now, done = None, []
        for b in batches:
            columns = {c: b.column(c).to_pylist() for c in (*heads, "page", "width", "height", "pixels", "error")}
            for k in range(b.num_rows):
                if columns["error"][k] is not None:
                    raise TiffError(columns["error"][k])
                if columns["page"][k] == 0:
                    if now is not None:
                        done.append(now.row())
                    now = Digest({c: columns[c][k] for c in heads})
                now.add(columns["width"][k], columns["height"][k], columns["pixels"][k])
            if done:
                yield batch(done)
                done = []
        if now is not None:
            yield batch([now.row()])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return tiff_pages(images, heads, "media").mapInArrow(fold, schema)
