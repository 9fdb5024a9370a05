"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

parse() reads any MPEG audio stream of layers I to III: it skips ID3v2, looks for frame headers and
resynchronises after damage (a header counts if the frame it announces is followed by another like it,
by a tag or by the end), verifies the CRC-16 of protected frames of all layers, reads Xing, Info and VBRI tables
and ID3v1, and gives the exact duration in samples and the offset of every frame. Streams of free format, whose
headers don't state a bitrate, have no frames here.

carry() stores bytes in a silent stream: MPEG-1 layer III, 48 kHz, mono, 224 kbit/s, so frames are 672
bytes; each holds UNIT payload bytes and their CRC-32 as ancillary data behind an empty granule.
An Info frame with a seek table, an ID3v2 and an ID3v1 tag frame it as players expect.

Defined results: null text counts as empty, and a payload is padded with bytes 255 to a positive
multiple of UNIT. Nothing but the text decides the stored bytes. Damaged streams don't raise: they
have fewer frames and `bad` counts what failed. Null media has no frames. A text of any length is one stream, and text and
stream are one object each of a task (7/6 of the text's bytes). Rows that repeat, and equal texts, have equal streams. Columns other than
doc_id and text (or media) aren't returned. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

UNIT = 576

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by version (1, or 2 and 2.5), layer and index; Hz by version and index.
_KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


#: Layers I and II: bits of allocation by groups of subbands, for layer I, MPEG-1 layer II, its low rates, MPEG-2 layer II.
_ALLOCATION = {"I": ((4, 32),), "II": ((4, 11), (3, 12), (2, 7)), "low": ((4, 2), (3, 10)), "2": ((4, 4), (3, 7), (2, 19))}


def _table() -> list[int]:
    out = []
    for x in range(256):
        c = x << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out.append(c)
    return out


_CRC = _table()
_seen: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """The CRC of protected frames: polynomial 0x8005, from 0xFFFF. Side information repeats, so results are kept."""
    found = _seen.get(data)
    if found is None:
        c = 0xFFFF
        for x in data:
            c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ x]
        if len(_seen) > 50_000:
            _seen.clear()
        _seen[data] = found = c
    return found


def crc16_bits(value: int, n: int) -> int:
    """The same CRC over the n bits of a number, first bit highest."""
    c = 0xFFFF
    for i in range(n - 1, -1, -1):
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ (value >> i & 1) else 0)
    return c


def allocation_crc(data: bytes, at: int, h: Header) -> int:
    """What the checksum of a protected frame of layer I or II must be: over the header's last two bytes, the bit
    allocation and, in layer II, the scale factor selection of the subbands that have bits."""
    if h.layer == 1:
        groups, bands = _ALLOCATION["I"], 32
    elif h.version != 3:
        groups, bands = _ALLOCATION["2"], 30
    else:
        kbits = h.kbits if h.mono else h.kbits // 2
        low = kbits < 56
        groups = _ALLOCATION["low" if low else "II"]
        bands = (12 if h.rate == 32000 else 8) if low else 30 if kbits >= 96 and h.rate != 48000 else 27
    channels = 1 if h.mono else 2
    parted = 0 if h.mono else min(bands, 4 * h.extension + 4) if h.joint else bands
    widths = [w for w, k in groups for _ in range(k)][:bands]
    # no frame has more than 32 subbands of 2 channels of 4 + 2 bits
    bits = int.from_bytes(data[at + 6 : at + 6 + 48].ljust(48, b"\0"), "big")
    read, selected = 0, 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < parted else 1):
            given = bits >> (384 - read - width) & ((1 << width) - 1)
            read += width
            selected += (1 if band < parted or h.mono else channels) * bool(given)
    n = read + (2 * selected if h.layer == 2 else 0)
    return crc16_bits(int.from_bytes(data[at + 2 : at + 4], "big") << n | bits >> (384 - n), 16 + n)


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    rate: int
    mono: bool
    size: int
    samples: int
    kbits: int
    joint: bool
    extension: int

    @property
    def side(self) -> int:
        """Bytes of side information of layer III."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


_headers: dict[bytes, Header | None] = {}


def header(data: bytes) -> Header | None:
    """The frame header in four bytes, or None. There are few different ones, so they are kept."""
    if data not in _headers:
        if len(_headers) > 50_000:
            _headers.clear()
        _headers[data] = _header(data)
    return _headers[data]


def _header(data: bytes) -> Header | None:
    if len(data) < 4 or data[0] != 0xFF or data[1] & 0xE0 != 0xE0:
        return None
    version, layer = data[1] >> 3 & 3, 4 - (data[1] >> 1 & 3)
    index, rate_index, padding = data[2] >> 4, data[2] >> 2 & 3, data[2] >> 1 & 1
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3 or data[3] & 3 == 2:
        return None
    rate = _RATES[version][rate_index]
    bits = 1000 * _KBITS[1 if version == 3 else 2, layer][index]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12 * bits // rate + padding) * 4 if layer == 1 else samples // 8 * bits // rate + padding
    return Header(version, layer, not data[1] & 1, rate, data[3] >> 6 == 3, size, samples, bits // 1000, data[3] >> 6 == 1, data[3] >> 4 & 3)


@dataclass
class Stream:
    """What parse() finds. offsets: of audio frames; duration: samples / rate seconds, exactly."""

    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bad: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] = field(default_factory=list)


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads text frames of an ID3v2.3 or 2.4 tag at the start; gives its length, 0 without one."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end = 10 + _syncsafe(data[6:10])
    at = 10
    while at + 10 <= min(end, len(data)) and data[at] != 0:
        n = _syncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + n]
        if name[0] == "T" and body:
            encoding = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)]
            parts = body[1:].decode(encoding, "replace").split("\0")
            tags[f"{name}:{parts[0]}" if name == "TXXX" and len(parts) > 1 else name] = parts[1] if name == "TXXX" and len(parts) > 1 else parts[0]
        at += 10 + n
    return end + 10 * bool(data[5] & 0x10)


def _vbr(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Reads a Xing, Info or VBRI table if the frame at `at` holds one."""
    x = at + 4 + 2 * h.protected + h.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        out.table = data[x : x + 4].decode()
        if flags & 1:
            out.table_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 2:
            out.table_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out.toc = list(data[p : p + 100])
        return True
    x = at + 36
    if data[x : x + 4] == b"VBRI":
        out.table = "VBRI"
        out.table_bytes, out.table_frames, n, scale, width = struct.unpack(">IIHHH", data[x + 10 : x + 24])
        p = x + 26
        out.toc = [int.from_bytes(data[p + i * width : p + (i + 1) * width], "big") * scale for i in range(min(n, max(0, len(data) - p) // max(1, width)))]
        return True
    return False


def parse(data: bytes | None) -> Stream:
    out = Stream()
    data = data or b""
    at, end = _id3v2(data, out.tags), len(data)
    if data[-128:-125] == b"TAG" and end >= 128:
        end -= 128
        out.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    lost, first = False, True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and out.rate and h.rate != out.rate:
            h = None
        ok = h is not None and at + h.size <= end
        if ok and at + h.size + 4 <= end and (first or lost):
            n = header(data[at + h.size : at + h.size + 4])  # a true frame is followed by one like it
            ok = n is not None and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate)
        if not ok:
            out.bad += not lost
            lost = True
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        lost = False
        if h.protected:
            want = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) if h.layer == 3 else allocation_crc(data, at, h)
            out.bad += want != int.from_bytes(data[at + 4 : at + 6], "big")
        out.rate = h.rate
        if not (first and h.layer == 3 and _vbr(data, at, h, out)):
            out.offsets.append(at)
            out.samples += h.samples
        first = False
        at += h.size
    return out


_HEAD4 = bytes((0xFF, 0xFA, 0xC4, 0xC0))
_SIDE = bytes(17)
_HEAD = _HEAD4 + crc16(_HEAD4[2:] + _SIDE).to_bytes(2, "big") + _SIDE
FRAME = header(_HEAD4).size
_REST = bytes(FRAME - len(_HEAD) - UNIT - 4)


def _text_frame(name: str, body: str) -> bytes:
    raw = b"\3" + body.encode()
    n = len(raw)
    return name.encode() + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + b"\0\0" + raw


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT or (UNIT if not raw else 0))


def carry(raw: bytes) -> bytes:
    """The stream that holds padded(raw)."""
    payload = padded(raw)
    n = len(payload) // UNIT
    samples = n * 1152
    tags = _text_frame("TLEN", str(samples * 1000 // 48000)) + _text_frame("TXXX", f"bytes\0{len(raw)}")
    k = len(tags)
    id3 = b"ID3\4\0\0" + bytes((k >> 21 & 127, k >> 14 & 127, k >> 7 & 127, k & 127)) + tags
    # frames are of one size, so byte and time shares agree but for the Info frame itself
    toc = bytes(min(255, 256 * (FRAME + i * n // 100 * FRAME) // ((n + 1) * FRAME)) for i in range(100))
    info = _HEAD + b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc
    parts = [id3, info.ljust(FRAME, b"\0")]
    for i in range(0, len(payload), UNIT):
        unit = payload[i : i + UNIT]
        parts += (_HEAD, unit, zlib.crc32(unit).to_bytes(4, "big"), _REST)
    parts.append(b"TAG" + bytes(125))
    return b"".join(parts)


def carried(data: bytes, stream: Stream) -> tuple[bytes, int]:
    """The payload of a stream made by carry(), and how many units fail their CRC-32."""
    units, bad = [], 0
    for at in stream.offsets:
        x = at + len(_HEAD)
        unit = data[x : x + UNIT]
        bad += zlib.crc32(unit) != int.from_bytes(data[x + UNIT : x + UNIT + 4], "big")
        units.append(unit)
    return b"".join(units), bad


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, media binary of docs(doc_id, text): each whole text as an MPEG audio stream."""

    def run(batches):
        for piece, _ in slices(batches, "text"):
            media = [carry(t or b"") for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, media binary")


PROBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, samples long, rate int, seek array<long>, table string, bad int"


def probed(media: DataFrame) -> DataFrame:
    """What the stored streams of media(doc_id, media) hold: payload digests, duration, seek offsets, failures.

    n_bytes is the length before padding that the stream's tag states. The duration is samples / rate.
    """

    def run(batches):
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.int32()), ("samples", pa.int64()), ("rate", pa.int32()), ("seek", pa.list_(pa.int64())), ("table", pa.string()), ("bad", pa.int32())]
        )
        for piece, _ in slices(batches, "media"):
            rows = []
            for doc_id, data in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                data = data or b""
                s = parse(data)
                payload, bad = carried(data, s)
                stated = s.tags.get("TXXX:bytes", "")
                rows.append(
                    (doc_id, int(stated) if stated.isdigit() else None, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), len(s.offsets), s.samples, s.rate, np.array(s.offsets, dtype=np.int64), s.table, s.bad + bad)
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return media.mapInArrow(run, PROBED)
