"""Legacy ARC archives converted to WARC, WARC files written by Spark, and read back.

An ARC file starts with a version block (``filedesc://...``) whose third line names the fields of every header
line that follows: version 1 has five, version 2 ten.  A record is one such line and exactly the declared
number of bytes.  The converter gives each record what WARC asks for and ARC lacks: an identifier, an ISO
timestamp, a record type and digests.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import new_path, stored

FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = (
    "record_id string, url string, ip string, date string, content_type string, warc_type string, block binary, "
    "head_bytes long, payload_bytes long, payload_digest string, block_digest string, page_id long"
)
READ_BACK = (
    "record_id string, url string, date string, record_type string, payload_bytes long, payload_digest string, "
    "page_id long, refers_to long, stored_digest string"
)
#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 100
END = b"\r\n\r\n"


# ---------------------------------------------------------------- ARC


def arc_head(name: str, version: int, date: str = "20200101000000") -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 graphloom\n{FIELDS[version]}\n\n".encode()
    extra = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(url: str, date: str, block: bytes, name: str, version: int, ip: str = "0.0.0.0") -> bytes:
    extra = "" if version == 1 else f" 200 {zlib.crc32(block):08x} - 0 {name}"
    url = re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    return f"{url} {ip} {date} text/html{extra} {len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file after its version block.

    Fields are taken from the right, so a blank within a URL does no harm.  Blank lines between records are
    skipped.  A header line that does not parse, or a length that runs past the end, ends the file: what was
    read before it is kept.
    """
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if names is None and line.startswith("filedesc://"):
            try:
                size = int(line.rpartition(" ")[2])
            except ValueError:
                return
            names = data[end + 1 : end + 1 + size].decode("utf-8", "replace").split("\n")[1].split()
            at = end + 1 + size
            continue
        parts = line.rsplit(" ", len(names) - 1) if names else []
        if not names or len(parts) != len(names) or not parts[-1].isdigit():
            return
        size = int(parts[-1])
        if end + 1 + size > len(data):
            return
        yield dict(zip(names, parts, strict=True)) | {"block": data[end + 1 : end + 1 + size]}
        at = end + 1 + size


def warc_date(date: str) -> str:
    """ARC's yyyymmddhhmmss as an ISO timestamp; missing digits become the start of the period."""
    d = re.sub(r"\D", "", date)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def payload_start(block: bytes) -> int:
    """Where the entity of an HTTP message starts; 0 if the block has no HTTP header."""
    if not block.startswith(b"HTTP/"):
        return 0
    end = block.find(END)
    return end + 4 if end >= 0 else 0


def _page_id(head: bytes) -> int | None:
    m = re.search(rb"(?im)^X-Page-Id: *(-?\d+)", head)
    return int(m[1]) if m else None


def _converted(arc: dict) -> tuple:
    block = arc["block"]
    start = payload_start(block)
    payload = hashlib.sha256(memoryview(block)[start:]).hexdigest()
    whole = hashlib.sha256(block).hexdigest()
    date = warc_date(arc["Archive-date"])
    page = _page_id(block[:start])
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{arc['URL']} {date} {whole}")
    kind = "response" if start else "resource"
    return (f"<urn:uuid:{name}>", arc["URL"], arc["IP-address"], date, arc["Content-type"], kind, block, start, len(block) - start, payload, whole, page)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _in_batches(rows: Iterable[tuple], schema: pa.Schema, size, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of some 8 MB, whatever the length of a row."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit or len(held) >= 4096:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def arc_archives(pages: DataFrame, part_bytes: int = 4 << 20) -> DataFrame:
    """(name, content): ARC archives of rows with page_id, url and html; versions 1 and 2 in turn.

    The network document of a row is an HTTP response that carries the page's number in a header; null html
    is an empty entity, a null url is written "-".
    """

    def build(batches):
        k, held, total = 0, [], 0
        out = pa.schema([("name", pa.string()), ("content", pa.binary())])

        def close():
            name = f"part-{k}.arc"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join([arc_head(name, 1 + k % 2), *held])], pa.binary())], schema=out)

        for b in batches:
            for page, url, html in zip(b.column("page_id"), b.column("url"), b.column("html"), strict=True):
                body = (html.as_py() or "").encode()
                page = page.as_py()
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "")
                record = arc_record(url.as_py() or "-", "20200101000000", f"{head}Content-Length: {len(body)}\r\n\r\n".encode() + body, f"part-{k}.arc", 1 + k % 2)
                held.append(record)
                total += len(record)
                if total >= part_bytes:
                    yield close()
                    k, held, total = k + 1, [], 0
        if held:
            yield close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(build, "name string, content binary")


def arc_to_warc(archives: DataFrame, content: str = "content") -> DataFrame:
    """A row (RECORD) for each record of the ARC archives in the binary column ``content``; null archives give none."""
    schema = _arrow(RECORD)

    def convert(batches):
        rows = (_converted(r) for b in batches for x in b.column(0) if x.is_valid for r in parse_arc(x.as_py()))
        yield from _in_batches(rows, schema, lambda r: len(r[6]))

    return archives.select(content).mapInArrow(convert, RECORD)


# ---------------------------------------------------------------- WARC


def mark_revisits(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds first_page: of records with equal payloads of at least ``least`` bytes, the smallest page_id; else null.

    Only digests that occur more than once are joined back; Spark sees that table's true size and broadcasts
    it if small, and otherwise shuffles with skew splitting.  Records without page_id take no part as first.
    """
    small = records.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))
    firsts = stored(small.where("n > 1 and first_page is not null").select(F.col("payload_digest").alias("first_digest"), "first_page"), "firsts")
    match = (F.col("payload_digest") == F.col("first_digest")) & (F.col("payload_bytes") >= least)
    return records.join(firsts, match, "left").drop("first_digest")


def warc_texts(records: DataFrame) -> DataFrame:
    """(value): the WARC record of each row, up to the blank lines that end it."""
    revisit = F.col("first_page").isNotNull() & ~F.col("first_page").eqNullSafe(F.col("page_id"))
    block = F.when(revisit, F.substring("block", F.lit(1), F.col("head_bytes").cast("int"))).otherwise(F.col("block"))

    def field(name, value):
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))

    lines = [
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("warc_type"))),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-IP-Address", F.col("ip")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.lit("")).otherwise(field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("block_digest")))),
        field("X-Payload-Length", F.col("payload_bytes")),
        F.coalesce(field("X-Page-Id", F.col("page_id")), F.lit("")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), field("X-Refers-To-Page-Id", F.col("first_page")))).otherwise(F.lit("")),
        field("Content-Type", F.when(F.col("head_bytes") > 0, F.lit("application/http; msgtype=response")).otherwise(F.col("content_type"))),
        field("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    ]
    return records.select(F.concat(*lines, block.cast("string")).alias("value"))


def write_warc(records: DataFrame, path: str, file_bytes: int = 32 << 20, mean_bytes: float | None = None) -> None:
    """Writes records with first_page (mark_revisits) as gzipped WARC files of about ``file_bytes`` before compression.

    Spark's text writer ends each row with the blank lines that end a WARC record, so every part file is a
    WARC file; it writes to any store and a lost task is written again.  ``mean_bytes`` of a block, if known,
    saves a pass over the records.
    """
    mean = mean_bytes or records.agg(F.avg(F.octet_length("block"))).first()[0] or 1
    writer = warc_texts(records).write.option("lineSep", END.decode()).option("maxRecordsPerFile", max(1, int(file_bytes / (mean + 600))))
    writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header, block) of each record of a WARC file, gzipped (one or many members) or not, by declared lengths."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:
            d = zlib.decompressobj(31)
            plain.append(d.decompress(data) + d.flush())
            data = d.unused_data
        data = b"".join(plain)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(END, at)
        if end < 0:
            return
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        size = int(head.get("Content-Length", 0))
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row (READ_BACK) for each record of the WARC files under ``path``.

    payload_digest and payload_bytes are taken from the stored payload; a revisit, which stores none, gives
    those of its header.  stored_digest is the header's, to compare.
    """
    schema = _arrow(READ_BACK)

    def number(text):
        return int(text) if text is not None else None

    def row(head: dict, block: bytes) -> tuple:
        stated, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
        start = payload_start(block)
        got = (int(head["X-Payload-Length"]), stated) if kind == "revisit" else (len(block) - start, hashlib.sha256(memoryview(block)[start:]).hexdigest())
        return (head["WARC-Record-ID"], head.get("WARC-Target-URI"), head["WARC-Date"], kind, *got, number(head.get("X-Page-Id")), number(head.get("X-Refers-To-Page-Id")), stated)

    def parse(batches):
        rows = (row(*r) for b in batches for x in b.column(0) for r in parse_warc(x.as_py()))
        yield from _in_batches(rows, schema, lambda r: 300)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content").mapInArrow(parse, READ_BACK)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages archived as ARC, converted to WARC files, and read back: one row per page.

    An empty page table gives an empty result.  Repeated rows of the smallest page_id are all responses.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    records = mark_revisits(arc_to_warc(arc_archives(pages)))
    write_warc(records, path, mean_bytes=pages.agg(F.avg(F.octet_length("html"))).first()[0])
    back = read_warc(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", F.when(F.col("record_type") == "revisit", "revisit").otherwise("response").alias("record_type"), "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_page, count(*) AS k FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first_page IS NOT NULL AND f.first_page IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_page IS NOT NULL AND f.first_page IS DISTINCT FROM p.page_id THEN f.first_page END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100 AND f.k > 1
"""
