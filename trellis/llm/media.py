"""Media columns and signature sniffing.

A payload is stored as the 8-bit samples of a mono WAV file, losslessly, and read back. Sniffing runs one Aho-Corasick
automaton of magic bytes over the stored bytes; a validator per format then confirms structure and gives the length, so
chance magic is rejected. What is confirmed is carved: kind, offset, length. A declared type is corrected by what lies
at offset 0.

A null or empty text gives the 64 bytes 0. Very long texts are one row. Equal texts have equal values. Rows with a null
or repeated doc_id are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship, table, written

RATE = 8000
UNIT = 64
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "png", b"\xff\xd8\xff": "jpeg", b"GIF87a": "gif", b"GIF89a": "gif", b"RIFF": "riff", b"BM": "bmp",
    b"PK\x03\x04": "zip", b"%PDF-": "pdf", b"OggS": "ogg", b"fLaC": "flac", b"\x1f\x8b\x08": "gzip", b"MThd": "midi",
}
MIME = {"png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "wav": "audio/wav", "webp": "image/webp", "avi": "video/avi", "bmp": "image/bmp", "zip": "application/zip", "pdf": "application/pdf", "ogg": "audio/ogg", "flac": "audio/flac", "gzip": "application/gzip", "midi": "audio/midi"}


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of 64, and the length before that."""
    b = (text or "").encode()
    return b + bytes(-len(b) % UNIT or (0 if b else UNIT)), len(b)


def to_wav(samples: bytes) -> bytes:
    """8-bit mono PCM; a chunk of odd length is padded as the format asks."""
    pad = len(samples) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples + bytes(pad)


def from_wav(data: bytes) -> bytes:
    """The samples, found by walking the chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        if kind == b"data":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no samples")


def _png(d, o):
    at = o + 8
    while at + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        if at + 12 + n > len(d) or zlib.crc32(d[at + 4 : at + 8 + n]) != struct.unpack_from(">I", d, at + 8 + n)[0]:
            return None
        at += 12 + n
        if kind == b"IEND":
            return "png", at - o
    return None


def _jpeg(d, o):
    at = o + 2
    while at + 4 <= len(d) and d[at] == 0xFF:
        m = d[at + 1]
        n = struct.unpack_from(">H", d, at + 2)[0]
        if n < 2:
            return None
        at += 2 + n
        if m == 0xDA:
            end = d.find(b"\xff\xd9", at)
            return ("jpeg", end + 2 - o) if end >= 0 else None
    return None


def _gif(d, o):
    if o + 13 > len(d):
        return None
    flags = d[o + 10]
    at = o + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(at):
        while at < len(d) and d[at]:
            at += d[at] + 1
        return at + 1

    while at < len(d):
        if d[at] == 0x3B:
            return "gif", at + 1 - o
        if d[at] == 0x21:
            at = blocks(at + 2)
        elif d[at] == 0x2C and at + 10 <= len(d):
            f = d[at + 9]
            at = blocks(at + 11 + (3 << ((f & 7) + 1) if f & 0x80 else 0))
        else:
            return None
    return None


def _riff(d, o):
    if o + 12 > len(d):
        return None
    n = struct.unpack_from("<I", d, o + 4)[0]
    kind = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}.get(bytes(d[o + 8 : o + 12]))
    return (kind, 8 + n) if kind and n >= 4 and o + 8 + n <= len(d) else None


def _bmp(d, o):
    if o + 30 > len(d):
        return None
    n, zero, start, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", d, o + 2)
    ok = head in (12, 40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and w > 0 and zero == 0
    return ("bmp", n) if ok and 14 + head <= start <= n and o + n <= len(d) else None


def _zip(d, o):
    end = d.find(b"PK\x05\x06", o)
    while 0 <= end <= len(d) - 22:  # the first may be that of a zip stored within
        size, at, note = struct.unpack_from("<IIH", d, end + 12)
        if at + size == end - o and end + 22 + note <= len(d):
            return "zip", end + 22 + note - o
        end = d.find(b"PK\x05\x06", end + 1)
    return None


_startxref = re.compile(rb"startxref\s+(\d{1,15})\s+%%EOF")
_xref = re.compile(rb"\s*(?:xref|\d+\s+\d+\s+obj)\b")


def _pdf(d, o):
    """Up to the last end mark whose offset of the cross references, from o, holds: there is one per update, and one near
    the start of a linearized file. Where none holds, up to the last end mark before the next file's header."""
    last = None
    for m in _startxref.finditer(d, o):
        at = o + int(m[1])
        if o < at < m.start() and _xref.match(d, at):
            last = m.end()
    if last is None:
        first = _startxref.search(d, o)
        if first is None:
            return None
        after = d.find(b"%PDF-", first.end())
        last = max(m.end() for m in _startxref.finditer(d, o, after if after >= 0 else len(d)))
    return "pdf", last - o


def _ogg(d, o):
    at = o
    while at + 27 <= len(d) and d[at : at + 4] == b"OggS" and d[at + 4] == 0:
        n = d[at + 26]
        size = 27 + n + sum(d[at + 27 : at + 27 + n])
        if at + size > len(d):
            break
        at += size
    return ("ogg", at - o) if at > o else None


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ (poly if x >> bits - 1 else 0)) & (1 << bits) - 1
        out.append(x)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_header(d, at):
    """(length, samples, number) of the FLAC frame header at `at`, by its CRC-8; None if there is none. The number is that
    of the frame, or of its first sample where block sizes vary."""
    if at + 6 > len(d) or d[at] != 0xFF or d[at + 1] & 0xFE != 0xF8 or d[at + 3] & 1:
        return None
    size, rate = d[at + 2] >> 4, d[at + 2] & 15
    if size == 0 or rate == 15 or d[at + 3] >> 4 > 10 or d[at + 3] >> 1 & 7 == 3:
        return None
    lead = 8 - (d[at + 4] ^ 0xFF).bit_length()  # ones that the coded number begins with
    if lead in (1, 8):
        return None
    k = max(1, lead)
    number = d[at + 4] & (0x7F >> lead)
    for x in d[at + 5 : at + 4 + k]:
        if x & 0xC0 != 0x80:
            return None
        number = number << 6 | x & 0x3F
    p = at + 4 + k
    end = p + (size in (6, 7)) + (size == 7) + (rate >= 12) + (rate > 12)
    if end >= len(d):
        return None
    crc = 0
    for x in d[at:end]:
        crc = _CRC8[crc ^ x]
    if crc != d[end]:
        return None
    if size in (6, 7):
        samples = int.from_bytes(d[p : p + size - 5], "big") + 1
    else:
        samples = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    return end + 1 - at, samples, number


def _flac_end(d, at, n, samples, depth):
    """The end of the FLAC frame at `at` with a header of n bytes, by walking its subframes, if its CRC-16 holds."""
    channels = d[at + 3] >> 4
    depth = (depth, 8, 12, 0, 16, 20, 24, 32)[d[at + 3] >> 1 & 7]
    count = channels + 1 if channels < 8 else 2
    most = 4 * count * (samples * (depth + 1) // 8 + 64) + 4096
    bits = bin(int.from_bytes(b"\1" + d[at + n : at + n + most], "big"))[3:]
    i = 0

    def take(k):
        nonlocal i
        i += k
        if i > len(bits):
            raise ValueError
        return int(bits[i - k : i] or "0", 2)

    def zeros():
        nonlocal i
        a, i = i, bits.index("1", i) + 1  # raises ValueError where there is none
        return i - a - 1

    try:
        for c in range(count):
            b = depth + (channels in (8, 10) and c == 1 or channels == 9 and c == 0)
            pad, kind, wasted = take(1), take(6), take(1)
            b -= zeros() + 1 if wasted else 0
            if pad or b < 1:
                return None
            if kind < 2:
                take(b * (samples if kind else 1))
                continue
            order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else None
            if order is None or order > samples:
                return None
            take(b * order)
            if kind >= 32:
                precision = take(4) + 1
                take(5 + precision * order)
            method, parts = take(2), take(4)
            if method > 1:
                return None
            for part in range(1 << parts):
                k = (samples >> parts) - (0 if part else order)
                rice = take(4 + method)
                if rice == (31 if method else 15):
                    take(take(5) * max(k, 0))
                    continue
                for _ in range(k):
                    zeros()
                    take(rice)
    except ValueError:
        return None
    end = at + n + (i + 7) // 8 + 2
    if end > len(d):
        return None
    crc = 0
    for x in d[at:end]:
        crc = (crc << 8 & 0xFF00) ^ _CRC16[crc >> 8 ^ x]
    return None if crc else end


def _flac(d, o):
    """All metadata blocks, then frames, as many as the number of samples says; where it says none, as many as follow."""
    at, last, total, depth = o + 4, False, None, 0
    while not last:
        if at + 4 > len(d):
            return None
        last, kind, n = bool(d[at] & 0x80), d[at] & 0x7F, int.from_bytes(d[at + 1 : at + 4], "big")
        if kind == 127 or (total is None) != (kind == 0) or kind == 0 and n != 34 or at + 4 + n > len(d):
            return None
        if kind == 0:
            depth = ((d[at + 16] & 1) << 4 | d[at + 17] >> 4) + 1
            total = int.from_bytes(d[at + 17 : at + 22], "big") & (1 << 36) - 1
        at += 4 + n
    done, number = 0, 0
    while not total or done < total:
        head = _flac_header(d, at)
        end = _flac_end(d, at, head[0], head[1], depth) if head and head[2] == number else None
        if end is None:
            return None if total else ("flac", at - o)
        done += head[1]
        number += head[1] if d[at + 1] & 1 else 1
        at = end
    return "flac", at - o


def _gzip(d, o):
    try:
        z = zlib.decompressobj(31)
        part = d[o:]
        while part and not z.eof:
            z.decompress(part, 1 << 20)
            part = z.unconsumed_tail
        return ("gzip", len(d) - o - len(z.unused_data)) if z.eof else None
    except zlib.error:
        return None


def _midi(d, o):
    if o + 14 > len(d) or struct.unpack_from(">I", d, o + 4)[0] != 6:
        return None
    at, tracks = o + 14, struct.unpack_from(">H", d, o + 10)[0]
    for _ in range(tracks):
        if d[at : at + 4] != b"MTrk" or at + 8 > len(d):
            return None
        at += 8 + struct.unpack_from(">I", d, at + 4)[0]
    return ("midi", at - o) if at <= len(d) else None


CHECK = {"png": _png, "jpeg": _jpeg, "gif": _gif, "riff": _riff, "bmp": _bmp, "zip": _zip, "pdf": _pdf, "ogg": _ogg, "flac": _flac, "gzip": _gzip, "midi": _midi}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for m, kind in MAGIC.items():
        a.add_word(m.decode("latin-1"), (len(m), kind))
    a.make_automaton()
    return a


def sniff(data: bytes, a=None) -> list[tuple[str, int, int]]:
    """(kind, offset, length) of all confirmed media, by offset. A file within another is given as well."""
    out = []
    for end, (n, kind) in (a or automaton()).iter(data.decode("latin-1")):
        hit = CHECK[kind](data, end + 1 - n)
        if hit:
            out.append((hit[0], end + 1 - n, hit[1]))
    return sorted(out, key=lambda x: (x[1], x[0]))


def true_type(data: bytes, declared: str | None, a=None) -> str | None:
    """The type by what lies at the start of data; the declared one where nothing is confirmed."""
    return next((MIME[k] for k, o, _ in sniff(data, a) if o == 0), declared)


def sniffed(df: DataFrame, data: str = "data", declared: str = "declared", added: tuple[str, str] = ("true_type", "carved")) -> DataFrame:
    """Appends the true type and what was carved (array of kind, offset, length) to df, as columns `added`, which df must not
    have. Null data has a null type and nothing carved."""
    if set(added) & set(df.columns):
        raise ValueError(f"there are columns {added}")
    ship(df.sparkSession)
    i, j, names = df.columns.index(data), df.columns.index(declared), [*df.columns, *added]
    kind_ = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))
    out = T.StructType([*df.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], kind_)])

    def run(batches):
        import pyarrow as pa

        a = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for b in batches:
            types, carved = [], []
            for x, t in zip(b.column(i), b.column(j)):
                d = x.as_py()
                found = [] if d is None else sniff(d, a)
                types.append(None if d is None else next((MIME[k] for k, o, _ in found if o == 0), t.as_py()))
                carved.append([{"kind": k, "offset": o, "length": n} for k, o, n in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(types, pa.string()), pa.array(carved, kind)], names)

    return df.mapInArrow(run, out)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a WAV file."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            both = [padded(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in both], pa.int64()), pa.array([to_wav(p) for p, _ in both], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> the digest columns, from the stored bytes alone."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        import pyarrow as pa

        a = automaton()
        for b in batches:
            rows = []
            for x in b.column(2):
                m = x.as_py()
                p = from_wav(m)
                found = sniff(m, a)
                feature = f"{MIME.get(found[0][0]) if found else None};{RATE};8;1;{len(p)};" + ",".join(f"{k}@{o}+{n}" for k, o, n in found)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media(spark, sf_dir: str) -> DataFrame:
    return features(written(stored(table(spark, sf_dir, "documents", "doc_id", "text")), "media"))
