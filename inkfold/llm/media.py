"""Media columns: storing payloads losslessly, and sniffing what bytes really are.

One Aho-Corasick pass locates the magic bytes of all known formats, and the end marks of those
whose length no header tells. At each hit the format's validator confirms structure and lengths and
tells where the file ends; hits that don't hold are dropped. The file that starts at 0 corrects the
declared type; others, at any offset and not inside one already confirmed, are carved as
embedded media. Samples of a confirmed WAV, AU or PGM file are read back from its own headers. AU
samples are stored with their sign, so they are searched as read back as well.

Validators find end marks by bisection in the list that the one pass made, so many hits in a long
text cost no more than the text's length, nearly.

Defined cases: a null payload is the empty payload. A payload is padded with zero bytes to
a positive multiple of 64 before it is stored. Bytes of no known format keep the type
``bin`` and have no samples. Equal payloads give equal values. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import columns, prepare

UNIT = 64
STORED = ["wav", "au", "pgm"]

#: Magic bytes, the format, and where in the file they stand.
MAGIC = [
    (b"RIFF", "riff", 0), (b".snd", "au", 0), (b"P5\n", "pgm", 0), (b"\x89PNG\r\n\x1a\n", "png", 0), (b"GIF87a", "gif", 0), (b"GIF89a", "gif", 0),
    (b"\xff\xd8\xff", "jpeg", 0), (b"%PDF-", "pdf", 0), (b"PK\x03\x04", "zip", 0), (b"\x1f\x8b\x08", "gzip", 0), (b"fLaC", "flac", 0), (b"ftyp", "mp4", 4),
]
#: End marks, and the format that they end.
ENDS = [(b"PK\x05\x06", "zip"), (b"startxref", "xref"), (b"%%EOF", "pdf"), (b"\xff\xd9", "jpeg")]


class Marks:
    """Where the end marks of each format stand, in order, and which ZIP files they end."""

    def __init__(self, b: bytes, marks: dict[str, list[int]]):
        self.at, self.zips = marks, {}
        for end in marks.get("zip", ()):
            if end + 22 <= len(b):
                size, offset, comment = struct.unpack_from("<IIH", b, end + 12)
                start, stop = end - offset - size, end + 22 + comment
                if start >= 0 and stop <= len(b) and (size == 0 or b[end - size : end - size + 4] == b"PK\x01\x02"):
                    self.zips[start] = stop

    def after(self, kind: str, at: int) -> int:
        """The first mark from ``at`` on, or -1."""
        own = self.at.get(kind, ())
        i = bisect_left(own, at)
        return own[i] if i < len(own) else -1


def _riff(b: bytes, at: int, marks: Marks):
    """WAV and WebP: chunks must fill exactly the length that the header gives."""
    if at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    kind = {b"WAVE": "wav", b"WEBP": "webp"}.get(b[at + 8 : at + 12])
    if kind is None or end > len(b):
        return None
    pos, names = at + 12, []
    while pos + 8 <= end:
        names.append(b[pos : pos + 4])
        size = struct.unpack_from("<I", b, pos + 4)[0]
        pos += 8 + size + size % 2
    if pos != end or kind == "wav" and not {b"fmt ", b"data"} <= set(names) or kind == "webp" and not {b"VP8 ", b"VP8L", b"VP8X"} & set(names):
        return None
    return kind, end


def _au(b: bytes, at: int, marks: Marks):
    if at + 24 > len(b):
        return None
    offset, size, coding, rate, channels = struct.unpack_from(">5I", b, at + 4)
    if offset < 24 or size == 0xFFFFFFFF or at + offset + size > len(b) or not 1 <= coding <= 27 or not rate or not 1 <= channels <= 8:
        return None
    return "au", at + offset + size


def _pgm_header(b: bytes, at: int):
    fields, pos = [], at + 2
    while len(fields) < 3:
        while pos < len(b) and b[pos : pos + 1].isspace():
            pos += 1
        start = pos
        while pos < len(b) and 48 <= b[pos] <= 57:
            pos += 1
        if start == pos or pos - start > 9:
            return None
        fields.append(int(b[start:pos]))
    return (*fields, pos + 1) if pos < len(b) and b[pos : pos + 1].isspace() else None


def _pgm(b: bytes, at: int, marks: Marks):
    head = _pgm_header(b, at)
    if not head or not head[0] or not head[1] or head[2] != 255 or head[3] + head[0] * head[1] > len(b):
        return None
    return "pgm", head[3] + head[0] * head[1]


def _png(b: bytes, at: int, marks: Marks):
    """Every chunk's length and checksum, IHDR first, IEND last."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + size
        if end > len(b) or first != (name == b"IHDR") or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if name == b"IEND":
            return "png", end
        pos, first = end, False
    return None


def _gif(b: bytes, at: int, marks: Marks):
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    while pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return "gif", pos + 1
        if mark == 0x2C and pos + 10 <= len(b):
            local = b[pos + 9]
            pos += 11 + (3 << ((local & 7) + 1) if local & 128 else 0)
        elif mark == 0x21:
            pos += 2
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _jpeg(b: bytes, at: int, marks: Marks):
    """Marker segments up to the scan, then the end marker."""
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        name, size = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2:
            return None
        pos += 2 + size
        if name == 0xDA:
            end = marks.after("jpeg", pos)
            return ("jpeg", end + 2) if end >= 0 else None
    return None


def _pdf(b: bytes, at: int, marks: Marks):
    if not b[at + 5 : at + 8].replace(b".", b"0").isdigit():
        return None
    xref, end = marks.after("xref", at), marks.after("pdf", at)
    return ("pdf", end + 5) if 0 <= xref < end else None


def _zip(b: bytes, at: int, marks: Marks):
    """An end of central directory whose size and offset lead back to this very place."""
    stop = marks.zips.get(at)
    return ("zip", stop) if stop else None


def _gzip(b: bytes, at: int, marks: Marks):
    z = zlib.decompressobj(31)
    try:
        for pos in range(at, len(b), 1 << 16):
            z.decompress(b[pos : pos + (1 << 16)])
            if z.eof:
                return "gzip", min(pos + (1 << 16), len(b)) - len(z.unused_data)
    except zlib.error:
        pass
    return None


def _crc_table(poly: int, bits: int) -> list[int]:
    out, top = [], 1 << bits - 1
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ (poly if x & top else 0)) & (1 << bits) - 1
        out.append(x)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(b: bytes, at: int) -> tuple[int, int] | None:
    """(end of the head, samples) of a frame whose head's checksum holds."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFC != 0xF8:
        return None
    size, rate = b[at + 2] >> 4, b[at + 2] & 15
    lead = b[at + 4]
    pos = at + 5 + (0 if lead < 0x80 else 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3 if lead < 0xF8 else 4 if lead < 0xFC else 5 if lead < 0xFE else 6)
    samples = 192 if size == 1 else 576 << size - 2 if 2 <= size <= 5 else 256 << size - 8 if size >= 8 else 0
    if size in (6, 7):
        samples = int.from_bytes(b[pos : pos + size - 5], "big") + 1
        pos += size - 5
    pos += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not samples or rate == 15 or pos >= len(b):
        return None
    crc = 0
    for x in b[at:pos]:
        crc = _CRC8[crc ^ x]
    return (pos + 1, samples) if crc == b[pos] else None


def _flac(b: bytes, at: int, marks: Marks):
    """Metadata blocks, then frames until the stream's number of samples is reached; every head and every frame must hold its checksum.

    A stream that doesn't tell its number of samples has no end that could be confirmed.
    """
    pos, last, total = at + 4, False, 0
    while not last:
        if pos + 4 > len(b):
            return None
        kind, size = b[pos] & 127, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if pos == at + 4:
            if kind or size != 34 or pos + 38 > len(b):
                return None
            total = int.from_bytes(b[pos + 17 : pos + 22], "big") & (1 << 36) - 1
        last, pos = bool(b[pos] & 128), pos + 4 + size
    if not total:
        return None
    while total > 0:
        head = _flac_frame(b, pos)
        if head is None:
            return None
        crc, i, total = 0, pos, total - head[1]
        while True:  # a frame ends where its checksum stands, followed by the next frame's head or the stream's end
            if i + 2 > len(b):
                return None
            if i >= head[0] + 2 and crc == b[i] << 8 | b[i + 1] and (total <= 0 or _flac_frame(b, i + 2)):
                break
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[i]]
            i += 1
        pos = i + 2
    return "flac", pos


def _mp4(b: bytes, at: int, marks: Marks):
    """Boxes that follow each other; among them the file's type first, and its movie, a fragment or its data."""
    pos, names = at, []
    while pos + 8 <= len(b):
        size, name = struct.unpack_from(">I4s", b, pos)
        head = 8
        if size == 1 and pos + 16 <= len(b):
            size, head = struct.unpack_from(">Q", b, pos + 8)[0], 16
        if size < head or pos + size > len(b) or not name.isalnum() or not names and (size < 16 or size % 4 or not b[pos + 8 : pos + 12].isascii()):
            break
        names.append(name)
        pos += size
    return ("mp4", pos) if names[:1] == [b"ftyp"] and {b"moov", b"moof", b"mdat"} & set(names) else None


VALIDATORS = {"riff": _riff, "au": _au, "pgm": _pgm, "png": _png, "gif": _gif, "jpeg": _jpeg, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "flac": _flac, "mp4": _mp4}

_AUTOMATON = None


def automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = ahocorasick.Automaton()
        for magic, kind, offset in MAGIC:
            _AUTOMATON.add_word(magic.decode("latin-1"), (kind, len(magic), offset))
        for mark, kind in ENDS:
            _AUTOMATON.add_word(mark.decode("latin-1"), (kind, len(mark), None))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def sniff(b: bytes) -> list[tuple[str, int, int]]:
    """Confirmed files as (type, start, end), by start; none begins inside an earlier one that is not the whole."""
    out, stop, hits, ends = [], 0, [], {}
    for last, (kind, size, offset) in automaton().iter(b.decode("latin-1")):
        if offset is None:
            ends.setdefault(kind, []).append(last - size + 1)
        else:
            hits.append((last - size + 1 - offset, kind))
    marks = Marks(b, ends)
    for at, kind in sorted(hits):
        if at < 0 or at < stop:
            continue
        if found := VALIDATORS[kind](b, at, marks):
            out.append((found[0], at, found[1]))
            stop = found[1] if at else 0
    return out


def pad(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -len(data) // UNIT * -UNIT) - len(data))


def store(payload: bytes, kind: str) -> bytes:
    """A padded payload as 8-bit samples in a WAV, AU or PGM file."""
    n = len(payload)
    if kind == "wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if kind == "au":  # its 8-bit samples are signed
        return struct.pack(">4s5I", b".snd", 24, n, 2, 8000, 1) + (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
    return b"P5\n%d %d\n255\n" % (UNIT, n // UNIT) + payload


def samples(b: bytes, kind: str) -> bytes | None:
    """The 8-bit samples of a confirmed file at 0, as unsigned bytes."""
    if kind == "wav":
        pos = 12
        while b[pos : pos + 4] != b"data":
            size = struct.unpack_from("<I", b, pos + 4)[0]
            pos += 8 + size + size % 2
        return b[pos + 8 : pos + 8 + struct.unpack_from("<I", b, pos + 4)[0]]
    if kind == "au":
        offset, size = struct.unpack_from(">2I", b, 4)
        return (np.frombuffer(b, np.uint8, size, offset) ^ 128).tobytes()
    if kind == "pgm":
        width, height, _, at = _pgm_header(b, 0)
        return b[at : at + width * height]
    return None


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, declared, media): each text's UTF-8 bytes stored as samples.

    The format follows from the payload, as does the declared type, which may be wrong.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            n, declared, media = [], [], []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                payload = pad(data)
                pick = zlib.crc32(payload)
                n.append(len(data))
                declared.append(STORED[pick // 3 % 3])
                media.append(store(payload, STORED[pick % 3]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(*(c.alias(n) for c, n in zip(columns([id_col, text_col]), ["doc_id", "text"], strict=True))).mapInArrow(run, f"doc_id {kind}, n_bytes long, declared string, media binary")


CARVED = "array<struct<type: string, start: long, end: long>>"


def inspect(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, type, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, embedded, feature).

    ``type`` is the confirmed type; ``embedded`` lists carved files; payload columns are of
    the samples read back from the stored bytes (null for types without samples).
    """
    prepare(media.sparkSession)
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = []
            for declared, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                b = b or b""
                found = sniff(b)
                real = found[0][0] if found and found[0][1] == 0 else "bin"
                inner = [f for f in found if f[1]]
                if real == "au":  # what the samples hold can't be seen in the file, their sign bits being turned
                    offset = struct.unpack_from(">I", b, 4)[0]
                    inner = sorted({*inner, *((t, s + offset, e + offset) for t, s, e in sniff(samples(b, real)))}, key=lambda f: (f[1], f[2], f[0]))
                data = samples(b, real) if real != "bin" else None
                feature = f"{real}{'' if real == declared else f' (declared {declared})'}"
                if data:
                    v = np.frombuffer(data, np.uint8)
                    p = np.bincount(v, minlength=256) / len(v)
                    p = p[p > 0]
                    feature += f" mean={v.mean():.4f} entropy={-(p * np.log2(p)).sum() + 0.0:.4f} range={v.min()}-{v.max()}"
                feature += "".join(f" {t}@{s}-{e}" for t, s, e in inner)
                rows.append(
                    (
                        declared, real, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None if data is None else zlib.crc32(data[-UNIT:]),
                        len(b), hashlib.sha256(b).hexdigest(), [{"type": t, "start": s, "end": e} for t, s, e in inner], feature,
                    )
                )
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), kind, pa.string()]
            names = ["declared", "type", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "embedded", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", *names])

    own = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {own}, n_bytes long, declared string, type string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, embedded {CARVED}, feature string"
    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, schema)
