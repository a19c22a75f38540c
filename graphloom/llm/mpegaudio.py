"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

The parser reads a binary column.  It skips an ID3v2 tag, finds frame headers and, after damage, resynchronises
on a header that a second header follows at the right distance.  The writer stores any byte string in the main
data of Layer III frames, so that what is stored can be read back without loss.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.shared import stored

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index 1-14, samples a second by index 0-2.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

INFO = (
    "media_bytes: long, frames: long, samples: long, sample_rate: int, duration_s: double, bytes_skipped: long, resyncs: int, "
    "crc_frames: long, crc_errors: long, vbr_frames: long, vbr_bytes: long, seek_step: int, seek_offsets: array<long>, tags: map<string,string>"
)
#: Main-data bytes a granule and the side information's length in the frames that are written.
GRANULE, SIDE = 511, 17


def crc16(data: bytes) -> int:
    """The checksum of protected frames: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for x in data:
        crc ^= x << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@lru_cache(4096)
def header(h: bytes) -> tuple | None:
    """(frame bytes, samples, rate, layer, side bytes, protected) of four header bytes; None if they are no header.

    Free-format frames (bitrate index 0) have no declared length and count as no header.
    """
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3), h[2] >> 4, h[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or h[3] & 3 == 2:
        return None
    first = version == 3
    kbits, hertz, pad = BITRATES[1 if first else 2, layer][index - 1], RATES[version][rate], h[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * kbits * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hertz + pad
    mono = h[3] >> 6 == 3
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return size, samples, hertz, layer, side if layer == 3 else 0, not h[1] & 1


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def read_tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """(tags, where audio starts, where it ends): ID3v2.3/2.4 text frames in front, ID3v1 at the end."""
    tags, start, end = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        start = min(len(data), 10 + _syncsafe(data[6:10]) + (10 if data[5] & 16 else 0))
        at = 10
        while at + 10 <= start and data[at : at + 1].isalnum():
            size = _syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            body = data[at + 10 : at + 10 + size]
            if data[at : at + 1] == b"T" and body:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                tags[data[at : at + 4].decode("latin-1")] = body[1:].decode(code, "replace").strip("\0")
            at += 10 + size
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG" and not _in_frame(data, start, end):
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            tags.setdefault(name, data[end - 128 + a : end - 128 + b].split(b"\0")[0].decode("latin-1").strip())
        end -= 128
    return tags, start, end


def _in_frame(data: bytes, start: int, end: int) -> bool:
    """Whether the place of an ID3v1 tag is inside a whole frame, with frames up to the file's very end."""
    last, inside = start, False
    for at, f, _ in walk(data, start, end):
        last = at + f[0]
        inside |= at < end - 128 < last
    return inside and last == end


def _next_frame(data: bytes, at: int, end: int) -> int:
    """The next offset from ``at`` whose header is followed by another header, or that ends the file; ``end`` if none."""
    while 0 <= (at := data.find(b"\xff", at, end)):
        if f := header(data[at : at + 4]):
            after = at + f[0]
            if after == end or after < end and header(data[after : after + 4]):
                return at
        at += 1
    return end


def walk(data: bytes, start: int, end: int) -> Iterator[tuple[int, tuple, int]]:
    """(offset, header, bytes skipped before it) of each whole frame."""
    at, from_ = start, start
    while at < end:
        f = header(data[at : at + 4])
        if f is None or at + f[0] > end:
            at = _next_frame(data, at + 1, end)
            continue
        yield at, f, at - from_
        at += f[0]
        from_ = at


def vbr_table(data: bytes, at: int, f: tuple) -> dict | None:
    """frames and bytes of a Xing, Info or VBRI table in the frame at ``at``; None if it has none."""
    x = at + 4 + 2 * f[5] + f[4]
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, y, out = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8, {"frames": None, "bytes": None}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[y : y + 4], "big")
                y += 4
        if flags & 4:
            out["toc"] = data[y : y + 100]
        return out
    x = at + 36
    if data[x : x + 4] == b"VBRI":
        return {"frames": int.from_bytes(data[x + 14 : x + 18], "big"), "bytes": int.from_bytes(data[x + 10 : x + 14], "big")}
    return None


def parse_mpeg(data: bytes, seek_step: int = 256) -> dict:
    """What INFO names, for one file.  A byte string without a frame has no frames, no rate and no duration."""
    tags, start, end = read_tags(data)
    out = {"media_bytes": len(data), "frames": 0, "samples": 0, "sample_rate": None, "duration_s": None, "bytes_skipped": 0, "resyncs": 0, "crc_frames": 0, "crc_errors": 0, "vbr_frames": None, "vbr_bytes": None, "seek_step": seek_step, "seek_offsets": [], "tags": tags}
    last, first, seconds = start, True, {}
    for at, f, skipped in walk(data, start, end):
        size, samples, hertz, layer, side, protected = f
        if skipped:
            out["bytes_skipped"] += skipped
            out["resyncs"] += 1
        last = at + size
        if protected and layer == 3:
            out["crc_frames"] += 1
            out["crc_errors"] += _crc(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]) != int.from_bytes(data[at + 4 : at + 6], "big")
        if first:
            first = False
            if (v := vbr_table(data, at, f)) is not None:
                out["vbr_frames"], out["vbr_bytes"] = v["frames"], v["bytes"]
                continue
        if out["frames"] % seek_step == 0:
            out["seek_offsets"].append(at)
        out["frames"] += 1
        out["samples"] += samples
        seconds[hertz] = seconds.get(hertz, 0) + samples
        out["sample_rate"] = out["sample_rate"] or hertz
    out["bytes_skipped"] += end - last
    if out["frames"]:
        out["duration_s"] = sum(n / hertz for hertz, n in sorted(seconds.items()))
    return out


_crc = lru_cache(65536)(crc16)


# ---------------------------------------------------------------- bytes stored in frames


@lru_cache(None)
def _sizes() -> list[tuple[int, bytes]]:
    """(room for main data, header) of the protected mono MPEG-1 Layer III frames at 44,100 Hz, smallest first."""
    heads = [bytes((0xFF, 0xFA, index << 4, 0xC0)) for index in range(1, 15)]
    return [(header(h)[0] - 6 - SIDE, h) for h in heads]


@lru_cache(4096)
def _front(h: bytes, n: int) -> bytes:
    """Header, checksum and side information of a frame whose two granules hold n bytes of main data."""
    one = min(n, GRANULE) * 8
    two = min(n - min(n, GRANULE), GRANULE) * 8
    # main_data_begin 9, private 5, scfsi 4, then per granule part2_3_length 12 and 47 more bits
    bits = (one << 47 << 59) | (two << 47)
    side = bits.to_bytes(SIDE, "big")
    return h + crc16(h[2:4] + side).to_bytes(2, "big") + side


def _held(data: bytes, at: int) -> int:
    """Bytes of main data that the side information of the frame at ``at`` declares."""
    bits = int.from_bytes(data[at + 6 : at + 6 + SIDE], "big")
    return ((bits >> 106 & 0xFFF) + (bits >> 47 & 0xFFF)) // 8


def store_bytes(payload: bytes, title: str = "payload") -> bytes:
    """An MPEG-1 Layer III file with an ID3v2.4 tag and a Xing table whose frames' main data are ``payload``.

    Frames take the largest bitrate until what is left fits a smaller one, and the side information of each
    declares how many of its bytes are data.
    """
    room, big = _sizes()[-1]
    room = min(room, 2 * GRANULE)
    parts, sizes = [], []
    for at in range(0, len(payload), room):
        chunk = payload[at : at + room]
        n = len(chunk)
        free, h = (room, big) if n == room else next((x for x in _sizes() if x[0] >= n), (room, big))
        frame = _front(h, n) + chunk
        frame += bytes(header(h)[0] - len(frame))
        parts.append(frame)
        sizes.append(len(frame))
    total = sum(sizes)
    head = bytes((0xFF, 0xFA, 5 << 4, 0xC0))
    body = b"Xing" + (7).to_bytes(4, "big") + len(parts).to_bytes(4, "big") + total.to_bytes(4, "big")
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    toc = bytes(min(255, 256 * ends[len(sizes) * k // 100] // max(1, total)) for k in range(100))
    xing = _front(head, 0) + body + toc
    xing += bytes(header(head)[0] - len(xing))
    text = b"\x03" + title.encode()
    n = 10 + len(text)
    safe = lambda v: bytes((v >> 21 & 127, v >> 14 & 127, v >> 7 & 127, v & 127))
    return b"".join((b"ID3\x04\x00\x00", safe(n), b"TIT2", safe(len(text)), b"\0\0", text, xing, *parts))


def load_bytes(data: bytes) -> bytes:
    """What store_bytes() stored."""
    _, start, end = read_tags(data)
    parts = []
    for k, (at, f, _) in enumerate(walk(data, start, end)):
        if k:  # the first frame has the table
            x = at + 6 + f[4]
            parts.append(data[x : x + _held(data, at)])
    return b"".join(parts)


# ---------------------------------------------------------------- Spark


def _mapped(df: DataFrame, column: str, new: str, ddl: str, make) -> DataFrame:
    """df with column ``new`` of type ``ddl``: ``make`` of the bytes in ``column``, one value at a time, null for null.

    Batches are cut to some 16 MB of output, however long the values are.
    """
    rest = [c for c in df.columns if c != new]
    target = df.select(*rest).limit(0).withColumn(new, F.lit(None).cast(ddl)).schema
    place, names = rest.index(column), [*rest, new]

    def run(batches):
        for b in batches:
            kept, held = [], 0
            values, start = b.column(place), 0
            for i in range(b.num_rows):
                kept.append(make(values[i].as_py()) if values[i].is_valid else None)
                held += len(kept[-1] or ()) if isinstance(kept[-1], bytes) else 64
                if held >= 16 << 20 or i == b.num_rows - 1:
                    part = b.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kept, kind)], names=names)
                    kept, held, start = [], 0, i + 1

    kind = to_arrow_type(target[new].dataType)
    return df.select(*rest).mapInArrow(run, target)


def store_audio(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """Adds the binary column ``media``: an MPEG audio file whose frames hold the binary column ``payload``."""
    return _mapped(df, payload, media, "binary", store_bytes)


def load_audio(df: DataFrame, media: str = "media", payload: str = "payload") -> DataFrame:
    """Adds the binary column ``payload`` that store_audio() stored in ``media``."""
    return _mapped(df, media, payload, "binary", load_bytes)


def audio_info(df: DataFrame, media: str = "media", info: str = "info", seek_step: int = 256) -> DataFrame:
    """Adds the struct ``info`` (INFO) of the MPEG audio file in the binary column ``media``; null for null.

    A byte string without frames gives no frames and no duration.  The duration is the sum of the frames'
    samples over their rate, not an estimate from the bitrate; every ``seek_step``-th frame's offset is kept.
    Other columns stay; one named like ``info`` is replaced.
    """
    return _mapped(df, media, info, f"struct<{INFO}>", lambda x: parse_mpeg(x, seek_step))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """DIGEST of a table (doc_id, n_bytes, media), from the stored bytes alone."""
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for doc, n, m in zip(*(b.column(i) for i in range(3)), strict=True):
                data = m.as_py()
                got, i = load_bytes(data), parse_mpeg(data)
                feature = f"frames={i['frames']} samples={i['samples']} rate={i['sample_rate']} table={i['vbr_frames']}/{i['vbr_bytes']} crc={i['crc_frames']}/{i['crc_errors']} skipped={i['bytes_skipped']} seek={zlib.crc32(','.join(map(str, i['seek_offsets'])).encode())}"
                rows.append((doc.as_py(), n.as_py(), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)


def op2_mpegaudio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an MPEG audio file in the shared folder, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(text)
    pad = F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64)))
    zeros = F.unhex(F.repeat(F.lit("00"), 64))
    docs = docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat(text, F.substring(zeros, F.lit(1), pad)).alias("payload"))
    return media_digests(stored(store_audio(docs, "payload").select("doc_id", "n_bytes", "media"), "media"))

