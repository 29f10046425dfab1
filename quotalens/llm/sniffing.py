"""Media columns: bytes stored as 8-bit audio, their true type sniffed from signatures.

One Aho-Corasick pass over the stored bytes finds every magic number; a validator for its format then
follows the structure and confirms the length.  The outermost confirmed find at byte 0 is the true type,
whatever was declared; confirmed finds inside it are embedded media and can be carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quotalens.llm.store import saved

UNIT, RATE = 64, 8000


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit PCM: each byte is a sample.  Data is padded to even length by the format."""
    n = len(payload)
    body = b"WAVE" + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8) + struct.pack("<4sI", b"data", n) + payload + b"\0" * (n % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _wav(raw: bytes, at: int) -> int | None:
    if raw[at + 8 : at + 12] != b"WAVE" or at + 12 > len(raw):
        return None
    end = at + 8 + struct.unpack_from("<I", raw, at + 4)[0]
    if end > len(raw):
        return None
    return end if wav_data(raw, at, end) else None


def wav_data(raw: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Begin and size of the samples of a checked RIFF file."""
    p, known = at + 12, False
    while p + 8 <= end:
        size = struct.unpack_from("<I", raw, p + 4)[0]
        if p + 8 + size > end:
            return None
        if raw[p : p + 4] == b"fmt ":
            known = size >= 16
        elif raw[p : p + 4] == b"data":
            return (p + 8, size) if known else None
        p += 8 + size + size % 2
    return None


def _png(raw: bytes, at: int) -> int | None:
    p = at + 8
    while p + 12 <= len(raw):
        size = struct.unpack_from(">I", raw, p)[0]
        stop = p + 12 + size
        if stop > len(raw) or zlib.crc32(raw[p + 4 : p + 8 + size]) != struct.unpack_from(">I", raw, p + 8 + size)[0]:
            return None
        if raw[p + 4 : p + 8] == b"IEND":
            return stop
        p = stop
    return None


def _gif(raw: bytes, at: int) -> int | None:
    if at + 13 > len(raw):
        return None
    flags, p = raw[at + 10], at + 13
    p += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    while p < len(raw):
        kind = raw[p]
        if kind == 0x3B:
            return p + 1
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= len(raw):
            local = raw[p + 9]
            p += 11 + (3 << (local & 7) + 1 if local & 0x80 else 0)
        else:
            return None
        while p < len(raw) and raw[p]:
            p += 1 + raw[p]
        p += 1
    return None


def _jpeg(raw: bytes, at: int) -> int | None:
    p = at + 2
    while p + 4 <= len(raw):
        if raw[p] != 0xFF:
            return None
        kind, size = raw[p + 1], struct.unpack_from(">H", raw, p + 2)[0]
        if size < 2:
            return None
        p += 2 + size
        if kind == 0xDA:
            stop = raw.find(b"\xff\xd9", p)
            return stop + 2 if stop >= 0 else None
    return None


def _pdf(raw: bytes, at: int) -> int | None:
    stop = raw.find(b"%%EOF", at)
    return stop + 5 if stop >= 0 and raw.find(b"startxref", at, stop) >= 0 else None


def _gzip(raw: bytes, at: int) -> int | None:
    inflater = zlib.decompressobj(31)
    left = raw[at:]
    try:
        while left and not inflater.eof:
            inflater.decompress(left, 1 << 20)
            left = inflater.unconsumed_tail
    except zlib.error:
        return None
    return len(raw) - len(inflater.unused_data) if inflater.eof else None


#: Magic numbers of the formats.
SIGNATURES = {
    b"RIFF": ("audio/wav", _wav),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"%PDF-": ("application/pdf", _pdf),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
}
_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        import ahocorasick

        made = ahocorasick.Automaton()
        for magic in SIGNATURES:
            made.add_word(magic.decode("latin-1"), magic)
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def sniff(raw: bytes) -> list[tuple[str, int, int]]:
    """(type, begin, end) of every confirmed find, in order.  Inside a find that is not a container of raw bytes nothing is sought."""
    out, skip = [], 0
    for last, magic in automaton().iter(raw.decode("latin-1")):
        at = last - len(magic) + 1
        if at < skip:
            continue
        kind, check = SIGNATURES[magic]
        end = check(raw, at)
        if end is not None:
            out.append((kind, at, end))
            if kind != "audio/wav":  # samples may hold anything; compressed formats are opaque
                skip = end
    return out


def media_column(docs: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """Store each text's bytes, padded with 0 to a positive multiple of 64, as audio; returns the written table.

    ``docs`` needs doc_id and text; a column ``declared``, if any, is the declared type.  Columns:
    doc_id, n_bytes (unpadded), declared, media.
    """

    def run(batches):
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text")]
            media = [to_wav(t + b"\0" * ((-len(t)) % UNIT if t else UNIT)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), batch.column("declared"), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"]
            )

    kind = F.coalesce(F.col("declared").cast("string"), F.lit(declared)) if "declared" in docs.columns else F.lit(declared)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", kind.alias("declared"))
    return saved(rows.mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary"), "media", "zstd")


def features(payload: bytes) -> str:
    """Level, spread and sign changes of the samples in whole numbers, and their loudest tenth."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    total, square = int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    parts = np.array_split(np.abs(x), 10)
    loudest = int(np.argmax([int(p.sum()) / max(len(p), 1) for p in parts]))
    return f"samples={len(x)};sum={total};squares={square};crossings={crossings};peak={int(np.abs(x).max())};loudest={loudest}"


def read_media(media: DataFrame) -> DataFrame:
    """Sniff and read stored media.

    ``media`` needs doc_id, n_bytes, declared and media.  Returns per row doc_id, n_bytes, declared,
    sniffed (null where nothing is confirmed at byte 0), corrected (whether they differ), embedded (array
    of type, begin, end), payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), media_bytes,
    media_sha256 and feature.  Where the media is not audio the payload is the media itself; null media
    is empty and has no features.  Equal bytes give equal values.  An empty table gives an empty table.
    """
    schema = (
        "doc_id long, n_bytes long, declared string, sniffed string, corrected boolean, embedded array<struct<kind string, begin long, end long>>, "
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
    types = [pa.string(), pa.bool_(), found_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["sniffed", "corrected", "embedded", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(raw: bytes, declared: str | None) -> tuple:
        finds = sniff(raw)
        whole = next((f for f in finds if f[1] == 0), None)
        kind, payload = whole[0] if whole else None, raw
        if kind == "audio/wav":
            begin, size = wav_data(raw, 0, whole[2])
            payload = raw[begin : begin + size]
        embedded = [{"kind": k, "begin": a, "end": b} for k, a, b in finds if (k, a, b) != whole]
        feature = f"{kind};embedded={len(embedded)}" + (f";{features(payload)}" if payload else "")
        return (kind, kind is not None and kind != declared, embedded, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                rows = [one(m or b"", d) for m, d in zip(part.column("media").to_pylist(), part.column("declared").to_pylist())]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "n_bytes", "declared")] + columns, names=["doc_id", "n_bytes", "declared", *names])

    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, schema)


def carved(media: DataFrame) -> DataFrame:
    """Embedded media cut out: doc_id, kind, begin, bytes."""

    def run(batches):
        for batch in batches:
            rows = [(d, k, a, raw[a:b]) for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()) if raw for k, a, b in sniff(raw) if a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.binary()))], names=["doc_id", "kind", "begin", "bytes"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, kind string, begin long, bytes binary")
