"""Media columns: signature sniffing, validation, and carving of embedded media.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass; a format's
validator then follows its structure and confirms it with its length, or rejects the hit.
The media that begins a value is its detected type, which corrects a declared one; others
inside it are carved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import texts, written

UNIT, RATE = 64, 8000


def png(b: bytes, at: int) -> int | None:
    """Length of the PNG at `at`: chunks with right checksums, from IHDR to IEND."""
    i, first = at + 8, True
    while i + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + size
        if end > len(b) or first and (kind != b"IHDR" or size != 13) or zlib.crc32(b[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at
        i, first = end, False
    return None


def gif(b: bytes, at: int) -> int | None:
    """Length of the GIF: colour tables, blocks with their sub-blocks, trailer."""
    if at + 13 > len(b):
        return None
    flags, i = b[at + 10], at + 13
    i += 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += b[i] + 1
        return i + 1

    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 < len(b):
            table = b[i + 9]
            i = blocks(i + 11 + (3 << (table & 7) + 1 if table & 0x80 else 0))
        else:
            return None
    return None


def jpeg(b: bytes, at: int) -> int | None:
    """Length of the JPEG: marker segments, and scans up to the end marker."""
    i = at + 2
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return None
        mark = b[i + 1]
        if mark == 0xD9:
            return i + 2 - at
        size = struct.unpack_from(">H", b, i + 2)[0]
        if mark in (0x00, 0xFF) or size < 2:
            return None
        i += 2 + size
        if mark == 0xDA:
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return None
    return i + 2 - at if b[i : i + 2] == b"\xff\xd9" else None


def riff(b: bytes, at: int) -> int | None:
    """Length of the RIFF file: chunks that fill the declared size; a WAVE has fmt before data."""
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end, i, seen = at + 8 + size, at + 12, []
    if end > len(b) or form not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    while i + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, i)
        seen.append(kind)
        i += 8 + n + (n & 1)
    return size + 8 if i == end and (form != b"WAVE" or b"fmt " in seen and b"data" in seen[seen.index(b"fmt ") :]) else None


class Marks:
    """A value and the places of its end marks, each found once whatever refers to it."""

    def __init__(self, b: bytes):
        self.b, self.found, self.ends = b, {}, None

    def places(self, mark: bytes) -> list[int]:
        if mark not in self.found:
            self.found[mark] = [m.start() for m in re.finditer(mark, self.b)]
        return self.found[mark]

    def within(self, mark: bytes, lo: int, hi: int) -> int | None:
        """The last place of a mark from lo, before hi."""
        places = self.places(mark)
        i = bisect_left(places, hi) - 1
        return places[i] if i >= 0 and places[i] >= lo else None

    def zips(self) -> dict[int, int]:
        """End of the ZIP by its start, for every end record whose directory lies where it says."""
        if self.ends is None:
            self.ends = {}
            for end in self.places(rb"PK\x05\x06"):
                if end + 22 <= len(self.b):
                    size, offset, note = struct.unpack_from("<IIH", self.b, end + 12)
                    if end + 22 + note <= len(self.b):
                        self.ends.setdefault(end - size - offset, end + 22 + note)
        return self.ends


def pdf(b: bytes, at: int, marks: Marks) -> int | None:
    """Length of the PDF: version, a startxref, and the last end-of-file mark before the next header, so that its updates are in it."""
    headers = marks.places(rb"%PDF-\d\.")
    i = bisect_left(headers, at)
    if i == len(headers) or headers[i] != at:
        return None
    end = marks.within(b"%%EOF", at, headers[i + 1] if i + 1 < len(headers) else len(b))
    return end + 5 - at if end is not None and marks.within(b"startxref", at, end) is not None else None


def archive(b: bytes, at: int, marks: Marks) -> int | None:
    """Length of the ZIP: end record whose directory lies where it says."""
    end = marks.zips().get(at)
    return end - at if end is not None else None


def gzip(b: bytes, at: int) -> int | None:
    """Length of the gzip member: it inflates, and its checksum and size are right."""
    if b[at + 3 : at + 4] > b"\x1f":
        return None
    stream = zlib.decompressobj(31)
    try:
        rest = memoryview(b)[at:]
        while not stream.eof and len(rest):
            stream.decompress(rest, 1 << 20)
            rest = stream.unconsumed_tail
    except zlib.error:
        return None
    return len(b) - at - len(stream.unused_data) if stream.eof else None


def _table(polynomial: int, bits: int) -> list[int]:
    out = []
    for i in range(256):
        x = i << bits - 8
        for _ in range(8):
            x = (x << 1 ^ polynomial if x >> bits - 1 else x << 1) & (1 << bits) - 1
        out.append(x)
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def flac_frame(b: bytes, at: int) -> tuple[int, int] | None:
    """(bytes of the header, samples) of the FLAC frame at `at`, if its header's checksum is right."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 3] & 1:
        return None
    size, rate = b[at + 2] >> 4, b[at + 2] & 15
    lead = (~b[at + 4] & 0xFF).bit_length()
    number = 1 if lead == 8 else 8 - lead  # of a number written as UTF-8
    i = at + 4 + number
    extra = {6: 1, 7: 2}.get(size, 0)
    end = i + extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if size == 0 or rate == 15 or number == 8 or end >= len(b):
        return None
    crc = 0
    for x in b[at:end]:
        crc = _CRC8[crc ^ x]
    known = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    return (end + 1 - at, int.from_bytes(b[i : i + extra], "big") + 1 if extra else known) if crc == b[end] else None


def flac(b: bytes, at: int) -> int | None:
    """Length of the FLAC: metadata from STREAMINFO, then frames with right checksums, up to the samples that it declares, or as far as they go."""
    i, first, total = at + 4, True, 0
    while i + 4 <= len(b):
        head, size = b[i], int.from_bytes(b[i + 1 : i + 4], "big")
        if first and (head & 127 or size != 34) or head & 127 == 127:
            return None
        if first:
            total = int.from_bytes(b[i + 14 : i + 22], "big") & (1 << 36) - 1
        i, first = i + 4 + size, False
        if head & 128:
            break
    frame, done, last = flac_frame(b, i), 0, None
    while frame:
        crc, end, following, start = 0, None, None, i + frame[0]
        for j in range(i, len(b)):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[j]]
            if crc == 0 and j > start:  # a frame and its checksum leave no remainder
                end = end or j + 1
                following = flac_frame(b, j + 1)
                if following or total and done + frame[1] >= total:
                    end = j + 1
                    break
        if end is None:
            return None
        done, last = done + frame[1], end
        if total and done >= total:
            break
        i, frame = end, following
    return last - at if last is not None and done >= total else None


def ogg(b: bytes, at: int) -> int | None:
    """Length of the Ogg stream: a page that begins it, and pages one after another up to one that ends it."""
    if at + 27 > len(b) or not b[at + 5] & 2:
        return None
    i = at
    while b[i : i + 5] == b"OggS\0" and i + 27 <= len(b):
        end = i + 27 + b[i + 26]
        size = sum(b[i + 27 : end])
        if end + size > len(b):
            return None
        last, i = b[i + 5] & 4, end + size
        if last:
            return i - at
    return None


#: Magic bytes, format, and validator.
SIGNATURES: tuple[tuple[bytes, str, Callable], ...] = (  # of pdf and zip with the value's marks
    (b"\x89PNG\r\n\x1a\n", "png", png),
    (b"GIF87a", "gif", gif),
    (b"GIF89a", "gif", gif),
    (b"\xff\xd8\xff", "jpeg", jpeg),
    (b"RIFF", "riff", riff),
    (b"%PDF-", "pdf", pdf),
    (b"PK\x03\x04", "zip", archive),
    (b"\x1f\x8b\x08", "gzip", gzip),
    (b"fLaC", "flac", flac),
    (b"OggS", "ogg", ogg),
)
FORMS = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for magic, kind, valid in SIGNATURES:
            made.add_word(magic.decode("latin-1"), (len(magic), kind, valid))
        made.make_automaton()
        _automaton = made
    return _automaton


def sniffed(b: bytes) -> list[tuple[str, int, int]]:
    """(format, offset, length) of the media confirmed in b, by offset; the parts of a confirmed ZIP aren't ZIPs of their own."""
    found, marks, zipped = [], Marks(b), 0
    for last, (size, kind, valid) in automaton().iter(b.decode("latin-1")):
        at = last + 1 - size
        if kind == "zip" and at < zipped:
            continue
        n = valid(b, at, marks) if kind in ("pdf", "zip") else valid(b, at)
        if n is not None:
            zipped = at + n if kind == "zip" else zipped
            found.append((FORMS.get(b[at + 8 : at + 12], kind) if kind == "riff" else kind, at, n))
    return found


def sniff(df: DataFrame, media: str, declared: str | None = None) -> DataFrame:
    """Adds to each row: media_type (detected; null if none begins the value), type_corrected, embedded (format, offset, length, bytes).

    A null value has no type and nothing embedded. Rows, repeats and other columns stay;
    columns of these names are replaced. An empty table gives an empty result.
    """
    kept = df.drop("media_type", "type_corrected", "embedded")
    at, told = kept.columns.index(media), kept.columns.index(declared) if declared else None
    item = T.StructType([T.StructField("format", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("bytes", T.BinaryType())])
    schema = T.StructType([*kept.schema.fields, T.StructField("media_type", T.StringType()), T.StructField("type_corrected", T.BooleanType()), T.StructField("embedded", T.ArrayType(item))])
    arrow = pa.list_(pa.struct([("format", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, inside = [], []
            for v in b.column(at).to_pylist():
                hits = sniffed(v) if v else []
                kinds.append(next((k for k, o, _ in hits if o == 0), None))
                inside.append([{"format": k, "offset": o, "length": n, "bytes": v[o : o + n]} for k, o, n in hits if o])
            named = b.column(told).to_pylist() if told is not None else [None] * len(b)
            wrong = [k is not None and k != n for k, n in zip(kinds, named)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), pa.array(inside, arrow)], names=schema.names)

    return kept.mapInArrow(work, schema)


def payload(text: bytes) -> bytes:
    """The text with zeros up to a positive multiple of UNIT bytes."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def wave(samples: bytes) -> bytes:
    """A mono WAVE of unsigned 8-bit samples."""
    body = samples + b"\0" * (len(samples) & 1)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + body


def samples(media: bytes) -> bytes:
    """The samples of a WAVE, found by its chunks."""
    i = 12
    while i + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, i)
        if kind == b"data":
            return media[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def stored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, declared): each text as a WAVE, declared as plain bytes; written and read back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                own = texts(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in own], pa.int64()), pa.array([wave(payload(t)) for t in own], pa.binary()), pa.array(["bin"] * len(own))],
                    names=["doc_id", "n_bytes", "media", "declared"],
                )

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return written(chosen.mapInArrow(work, "doc_id bigint, n_bytes bigint, media binary, declared string"), "media")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    `feature` has the detected type, whether it corrected the declared one, format and number
    of samples, their mean and deviation, and what is embedded. It depends on the text alone.
    Null texts are empty; null and repeated doc_ids keep their rows; an empty table: no rows.
    """
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m, kind, wrong, inside in zip(b.column("media"), *(b.column(c).to_pylist() for c in ("media_type", "type_corrected", "inside"))):
                m = m.as_py()
                p = samples(m)
                x = np.frombuffer(p, np.uint8)
                s, q = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
                mean = s / len(x)
                feature = f"{kind};corrected={str(wrong).lower()};1x8@{RATE};n={len(x)};mean={mean:.4f};dev={max(0.0, q / len(x) - mean * mean) ** 0.5:.4f};embedded={inside}"
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            cols = zip(*rows) if rows else ((),) * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = sniff(stored(docs), "media", "declared")
    inside = F.concat_ws(",", F.transform("embedded", lambda e: F.concat(e["format"], F.lit("@"), e["offset"], F.lit("+"), e["length"])))
    return found.withColumn("inside", inside).drop("embedded", "declared").mapInArrow(work, schema)
