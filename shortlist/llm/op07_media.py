"""Media columns by signature sniffing.

A payload is stored as 8-bit samples in one of three containers (WAV mono, BMP of 24 bits, PNG of 8-bit RGB with stored
deflate blocks); ``sniff`` finds media in any blob: an Aho-Corasick automaton locates magic bytes and a validator for each
format walks its structure: the chunks of WAV (8 to 32 bits, any channels), the headers of BMP (bottom-up and top-down), the
chunks, checksums, filters and colour types of PNG, the blocks of GIF, the segments of JPEG.  What passes corrects the declared
type, and media inside other bytes come out by their place and length (``carve``: a row each).

Scale: one pass without a shuffle; a task looks at ``common.BLOCK_BYTES`` (or one blob) at a time.  Equal texts give equal values.

Nulls and odd input: a null text counts as empty (one unit of padding); a null blob holds no media; a blob in which nothing is
found keeps its bytes, type null; an empty table gives an empty result; further columns don't matter; repeated rows each get a
row; long texts are stored whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Fixed by the contract.
UNIT = 192
PAD = b" "
#: Magic bytes of the formats; fixed values.
MAGIC = {b"RIFF": "wav", b"BM": "bmp", b"\x89PNG\r\n\x1a\n": "png", b"GIF87a": "gif", b"GIF89a": "gif", b"\xff\xd8\xff": "jpeg"}
#: Corrected types; fixed values.
TYPES = {"wav": "audio/wav", "bmp": "image/bmp", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg"}
WIDTH = 64


class Media(NamedTuple):
    """Media in a blob.  samples: row by row from the top without padding; as coded for GIF and JPEG and for interlaced PNG pass by pass."""

    start: int
    length: int
    kind: str
    shape: str
    samples: bytes


def _automaton():
    machine = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        machine.add_word(magic.decode("latin-1"), (kind, len(magic)))
    machine.make_automaton()
    return machine


def store(payload: bytes, kind: str) -> bytes:
    """``payload`` (whole units) as the samples of a file of this kind."""
    if kind == "wav":
        odd = b"\0" * (len(payload) % 2)
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(odd), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
        return head + payload + odd
    rows = len(payload) // UNIT
    if kind == "bmp":
        return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(payload), 0, 0, 54, 40, WIDTH, -rows, 1, 24, 0, len(payload), 2835, 2835, 0, 0) + payload
    lines = np.zeros((rows, UNIT + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 0)) + chunk(b"IEND", b"")


def _wav(blob: memoryview, at: int) -> tuple[int, bytes, str] | None:
    if len(blob) < at + 12 or blob[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", blob, at + 4)[0]
    place, form, data = at + 12, None, None
    while place + 8 <= end <= len(blob):
        name, (size,) = bytes(blob[place : place + 4]), struct.unpack_from("<I", blob, place + 4)
        body = place + 8
        if body + size > end:
            return None
        if name == b"fmt " and size >= 16 and form is None:
            code, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", blob, body)
            if code not in (1, 3, 0xFFFE) or not channels or bits not in (8, 16, 24, 32, 64) or align != channels * bits // 8:
                return None
            form = f"{channels}x{rate}x{bits}"
        elif name == b"data":
            if form is None or data is not None:
                return None
            data = bytes(blob[body : body + size])
        place = body + size + size % 2
    if data is None or place not in (end, end + 1) or end > len(blob):
        return None
    return min(end + (end - at) % 2, len(blob)) - at if place > end else end - at, data, form


def _bmp(blob: memoryview, at: int) -> tuple[int, bytes, str] | None:
    if len(blob) < at + 54:
        return None
    size, a, b, begin, head = struct.unpack_from("<IHHII", blob, at + 2)
    if a or b or head not in (40, 52, 56, 64, 108, 124) or begin < 14 + head or size < begin or at + size > len(blob):
        return None
    width, height, planes, bits, packed = struct.unpack_from("<iiHHI", blob, at + 18)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width < 1 or not height or packed not in (0, 3) or (packed == 3 and bits < 16):
        return None
    line, used = (width * bits + 31) // 32 * 4, (width * bits + 7) // 8
    if begin + line * abs(height) > size:
        return None
    rows = np.frombuffer(blob, np.uint8, line * abs(height), at + begin).reshape(abs(height), line)[:, :used]
    return size, (rows if height < 0 else rows[::-1]).tobytes(), f"{width}x{abs(height)}x{bits}"


#: Channels of each PNG colour type and its sample depths; first column, first row and steps of the seven interlace passes. Fixed values.
COLOURS = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfilter(lines: np.ndarray, step: int) -> np.ndarray | None:
    """Samples of filtered lines (first byte: the filter); ``step`` bytes a pixel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if not kinds.any():
        return out
    if kinds.max() > 4:
        return None
    above = np.zeros(out.shape[1], np.uint8)
    for kind, row in zip(kinds.tolist(), out):
        if kind == 1:
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind > 2:
            values, up = row.tolist(), above.tolist()
            for i, x in enumerate(values):
                left, corner = (values[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:  # the neighbour that is nearest to left + up - corner
                    base = left + up[i] - corner
                    guess = min((abs(base - left), 0, left), (abs(base - up[i]), 1, up[i]), (abs(base - corner), 2, corner))[2]
                values[i] = (x + guess) & 255
            row[:] = values
        above = row
    return out


def _png(blob: memoryview, at: int) -> tuple[int, bytes, str] | None:
    place, packed, shape = at + 8, [], None
    while place + 12 <= len(blob):
        n, = struct.unpack_from(">I", blob, place)
        if place + 12 + n > len(blob):
            return None
        name, body = bytes(blob[place + 4 : place + 8]), blob[place + 8 : place + 8 + n]
        if (shape is None) != (name == b"IHDR") or struct.unpack_from(">I", blob, place + 8 + n)[0] != zlib.crc32(body, zlib.crc32(name)):
            return None
        place += 12 + n
        if name == b"IHDR":
            if n != 13:
                return None
            width, height, depth, colour, method, filters, interlace = shape = struct.unpack(">IIBBBBB", body)
            if not width or not height or colour not in COLOURS or depth not in COLOURS[colour][1] or method or filters or interlace > 1:
                return None
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
    else:
        return None
    bits = COLOURS[colour][0] * depth
    parts = [(width, height)]
    if interlace:
        parts = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in PASSES]
    parts = [(1 + (w * bits + 7) // 8, h) for w, h in parts if w > 0 and h > 0]
    coded, whole = b"".join(packed), sum(w * h for w, h in parts)
    if whole > 1040 * (len(coded) + 1):  # deflate can't hold so much
        return None
    try:
        unpack = zlib.decompressobj()
        lines = np.frombuffer(unpack.decompress(coded, whole + 1), np.uint8)
    except zlib.error:
        return None
    if len(lines) != whole or not (unpack.eof or not unpack.decompress(unpack.unconsumed_tail, 1)):
        return None
    samples, upto = [], 0
    for w, h in parts:
        part = _unfilter(lines[upto : upto + w * h].reshape(h, w), max(1, bits // 8))
        if part is None:
            return None
        samples.append(part.tobytes())
        upto += w * h
    return place - at, b"".join(samples), f"{width}x{height}x{bits}"


def _gif(blob: memoryview, at: int) -> tuple[int, bytes, str] | None:
    if len(blob) < at + 13:
        return None
    width, height, flags = struct.unpack_from("<HHB", blob, at + 6)
    place, coded, images = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), [], 0
    while place < len(blob):
        mark = blob[place]
        if mark == 0x3B:
            return (place + 1 - at, b"".join(coded), f"{width}x{height}x{images}") if images and width and height else None
        if mark == 0x21:
            place += 2
        elif mark == 0x2C and place + 10 < len(blob):
            local = blob[place + 9]
            place += 11 + (3 << (local & 7) + 1 if local & 128 else 0)
            images += 1
        else:
            return None
        while place < len(blob) and blob[place]:
            if mark == 0x2C:
                coded.append(bytes(blob[place + 1 : place + 1 + blob[place]]))
            place += 1 + blob[place]
        place += 1
    return None


def _jpeg(blob: memoryview, at: int, last: int) -> tuple[int, bytes, str] | None:
    """``last``: the place of the blob's last end marker; before it a scan need not be walked in vain."""
    raw, place, shape, coded = blob.obj, at + 2, None, []
    while place + 4 <= len(blob) and place <= last and blob[place] == 0xFF:
        mark = blob[place + 1]
        if mark == 0xD9:
            return (place + 2 - at, b"".join(coded), shape) if shape and coded else None
        if mark == 0xFF:  # fill
            place += 1
            continue
        if mark < 0xC0 or 0xD0 <= mark <= 0xD8:
            return None
        size, = struct.unpack_from(">H", blob, place + 2)
        if size < 2 or place + 2 + size > len(blob):
            return None
        if mark in (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)) and size >= 8:
            depth, height, width, parts = struct.unpack_from(">BHHB", blob, place + 4)
            if not width or size != 8 + 3 * parts:
                return None
            shape = f"{width}x{height}x{depth * parts}"
        place += 2 + size
        if mark == 0xDA:
            if not shape:
                return None
            begin = place
            while True:  # the scan ends at a marker other than a stuffed zero or a restart
                place = raw.find(b"\xff", place)
                if place < 0 or place + 1 >= len(blob):
                    return None
                if blob[place + 1] and not 0xD0 <= blob[place + 1] <= 0xD7:
                    break
                place += 2
            coded.append(bytes(blob[begin:place]))
    if place + 2 <= len(blob) and bytes(blob[place : place + 2]) == b"\xff\xd9" and shape and coded:
        return place + 2 - at, b"".join(coded), shape
    return None


def sniff(blob: bytes, machine=None) -> list[Media]:
    """All media in ``blob``, leftmost first; what lies inside another isn't listed."""
    out, free = [], 0
    view, last = memoryview(blob), blob.rfind(b"\xff\xd9")
    valid = {"wav": _wav, "bmp": _bmp, "png": _png, "gif": _gif, "jpeg": lambda view, at: _jpeg(view, at, last)}
    hits = sorted((end - n + 1, kind) for end, (kind, n) in (machine or _automaton()).iter(blob.decode("latin-1")))
    for at, kind in hits:
        if at >= free and (found := valid[kind](view, at)):
            length, samples, shape = found
            out.append(Media(at, length, kind, shape, samples))
            free = at + length
    return out


def media(docs: DataFrame) -> DataFrame:
    """doc_id, declared, n_bytes, media binary: every text as stored media.

    The format follows the payload's checksum; the declared type is that of the wrapper, not of the media.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in C.by_bytes(whole, "text", 256):
                blobs, sizes = [], []
                for t in part.column("text"):
                    body = (t.as_py() or "").encode()
                    payload = body + PAD * (-len(body) % UNIT or (UNIT if not body else 0))
                    blobs.append(store(payload, ("wav", "bmp", "png")[zlib.crc32(payload) % 3]))
                    sizes.append(len(body))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(["application/octet-stream"] * len(blobs)), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())],
                    ["doc_id", "declared", "n_bytes", "media"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(write, "doc_id long, declared string, n_bytes long, media binary")


def carve(blobs: DataFrame) -> DataFrame:
    """A row for each media in ``blobs`` (doc_id, declared, media): doc_id, n (from 0), declared, type, start, length, shape, bytes."""
    schema = "doc_id long, n int, declared string, type string, start long, length long, shape string, bytes binary"
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton()
        for whole in batches:
            for part in C.by_bytes(whole, "media", 256):
                rows = []
                for id_, declared, blob in zip(part.column("doc_id").to_pylist(), part.column("declared").to_pylist(), part.column("media")):
                    blob = blob.as_py() or b""
                    for i, m in enumerate(sniff(blob, machine)):
                        rows.append((id_, i, declared, TYPES[m.kind], m.start, m.length, m.shape, blob[m.start : m.start + m.length]))
                columns = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return blobs.select(F.col("doc_id").cast("long").alias("doc_id"), "declared", "media").mapInArrow(cut, schema)


def read_back(stored: DataFrame) -> DataFrame:
    """Sniff ``stored`` (doc_id, declared, n_bytes, media): corrected type, number of media, digests of the first one's samples, features."""
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
              ("media_sha256", pa.string()), ("feature", pa.string()), ("type", pa.string()), ("n_media", pa.int32())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton()
        for whole in batches:
            for batch in C.by_bytes(whole, "media", 256):
                rows = []
                for blob in batch.column("media"):
                    blob = blob.as_py() or b""
                    found = sniff(blob, machine)
                    m = found[0] if found else Media(0, len(blob), "none", "", blob)
                    levels = np.frombuffer(m.samples, np.uint8)
                    mean = int(levels.astype(np.int64).sum()) * 1000 // max(1, len(levels))
                    edges = f"{int(levels[0])}-{int(levels[-1])}" if len(levels) else "-"
                    feature = f"{m.kind}:{m.shape}:{m.start}:{m.length}:mean{mean}:edge{edges}"
                    rows.append((len(m.samples), hashlib.sha256(m.samples).hexdigest(), zlib.crc32(m.samples[-16:]), len(blob),
                                 hashlib.sha256(blob).hexdigest(), feature, TYPES.get(m.kind), len(found)))
                columns = list(zip(*rows)) if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "declared", "n_bytes")), *[pa.array(c, k) for c, (_, k) in zip(columns, fields)]],
                    ["doc_id", "declared", "n_bytes", *[name for name, _ in fields]],
                )

    return stored.mapInArrow(
        read,
        "doc_id long, declared string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "feature string, type string, n_media int",
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(media(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "type", "n_media"
    )
