"""MPEG audio, ARC and WARC, and URL rules."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mpegaudio, urlfilter, warc


@pytest.mark.parametrize("n", [0, 1, 64, 510, 511, 512, 1021, 1022, 1023, 2047, 100_000])
def test_bytes_come_back(n):
    data = bytes((i * 7 + i // 251) % 256 for i in range(n))
    media = mpegaudio.store_bytes(data)
    assert mpegaudio.load_bytes(media) == data
    info = mpegaudio.parse_mpeg(media)
    assert info["crc_errors"] == info["bytes_skipped"] == info["resyncs"] == 0
    assert info["frames"] == info["vbr_frames"] and info["samples"] == 1152 * info["frames"]
    assert info["crc_frames"] == info["frames"] + 1  # and the table's frame
    assert info["duration_s"] == (info["frames"] * 1152 / 44100 if info["frames"] else None)


def test_header_fields():
    assert mpegaudio.header(bytes((0xFF, 0xFB, 0x90, 0x00))) == (417, 1152, 44100, 3, 32, False)
    assert mpegaudio.header(bytes((0xFF, 0xF3, 0x82, 0xC0))) == (209, 576, 22050, 3, 9, False)
    assert mpegaudio.header(bytes((0xFF, 0xFF, 0x92, 0x00)))[:3] == (12 * 288000 // 44100 * 4 + 4, 384, 44100)
    for bad in (b"\xff\xfb\x00\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xe9\x90\x00", b"\xfe\xfb\x90\x00", b"\xff\xfb"):
        assert mpegaudio.header(bad) is None


def test_checksum_of_known_text():
    assert mpegaudio.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS: 0x8005, start 0xFFFF


def test_resynchronises_and_counts_damage():
    media = mpegaudio.store_bytes(b"abc" * 3000)
    tag = b"TAG" + b"Song".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + bytes(65)
    damaged = bytearray(media[:3000] + b"\xff\xfa\x00\x11junk\xff" + media[3000:] + tag)
    whole, info = mpegaudio.parse_mpeg(media), mpegaudio.parse_mpeg(bytes(damaged))
    assert info["resyncs"] == 1 and info["bytes_skipped"] == 9  # what was put in; the frame around it has its length
    assert info["frames"] == whole["frames"]
    assert info["tags"]["TPE1"] == "Artist" and info["tags"]["TIT2"] == "payload"
    at = media.index(b"\xff\xfa", 400)
    flipped = bytearray(media)
    flipped[at + 8] ^= 1
    assert mpegaudio.parse_mpeg(bytes(flipped))["crc_errors"] == 1


def test_audio_columns(spark):
    df = spark.createDataFrame([(1, bytearray(mpegaudio.store_bytes(b"x" * 5000)), "keep"), (2, None, None), (3, bytearray(b""), ""), (4, bytearray(b"no frames \xff\xff\xff"), "")], "id int, media binary, info string")
    got = {r["id"]: r["info"] for r in mpegaudio.audio_info(df, seek_step=2).collect()}
    assert got[1]["frames"] == 5 and len(got[1]["seek_offsets"]) == 3
    assert got[2] is None and got[3]["frames"] == got[4]["frames"] == 0 and got[3]["duration_s"] is None
    assert mpegaudio.audio_info(df.limit(0)).count() == 0


def test_op2_on_edge_cases(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "é" * 32), (4, "a" * 64), (5, "a" * 65), (6, "word " * 50_000), (7, None)]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("media", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in mpegaudio.op2_mpegaudio(spark, str(tmp_path)).collect()}
    for doc, text in texts:
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[1]["media_sha256"] == got[2]["media_sha256"] == got[7]["media_sha256"] != got[3]["media_sha256"]


# ---------------------------------------------------------------- ARC and WARC


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n\nURL 1.2.3.4 20200101000000 text/html 5\nhello", b"", b"\n\n", bytes(range(256))]
    data = warc.arc_head("x.arc", version) + b"".join(warc.arc_record(f"http://a/{i} b", "20010203040506", b, "x.arc", version) for i, b in enumerate(blocks))
    got = list(warc.parse_arc(data))
    assert [r["block"] for r in got] == blocks
    assert got[0]["URL"] == "http://a/0%20b" and got[0]["Archive-date"] == "20010203040506"
    assert [r["block"] for r in warc.parse_arc(data[:-20])] == blocks[:-1]  # a record cut short is left out
    assert list(warc.parse_arc(b"garbage\n")) == list(warc.parse_arc(b"")) == []


def test_arc_header_with_blanks_in_the_url():
    body = f"1 0 x\n{warc.FIELDS[1]}\n\n".encode()
    data = f"filedesc://x 0.0.0.0 20200101 text/plain {len(body)}\n".encode() + body + b"\nhttp://a/b c d 1.2.3.4 1999 text/html 3\nabc\n"
    assert [(r["URL"], r["IP-address"], r["block"]) for r in warc.parse_arc(data)] == [("http://a/b c d", "1.2.3.4", b"abc")]
    assert warc.warc_date("1999") == "1999-01-01T00:00:00Z" and warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"


def test_warc_members():
    record = b"WARC/1.1\r\nContent-Length: 14\r\n\r\nWARC/1.1\r\n\r\nab\r\n\r\n"
    import gzip

    for data in (record * 2, gzip.compress(record * 2), gzip.compress(record) + gzip.compress(record)):
        assert [b for _, b in warc.parse_warc(data)] == [b"WARC/1.1\r\n\r\nab"] * 2


def test_op9_on_edge_cases(spark, tmp_path):
    long = "<p>" + "é" * 60 + "\r\n\r\nWARC/1.1\r\n\r\n</p>"
    pages = [(3, "http://a", long), (1, "http://b", long), (2, None, long), (1, "http://b", long), (4, "u", None), (5, "u", ""), (6, "u v", "small"), (7, "u", "small"), (8, "http://x\ny", "x" * 100), (9, "", "x" * 100), (10, "", "x" * 99), (11, "", "x" * 99), (None, "http://n", long), (12, "u", "y" * 3_000_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"block": F.lit(1), "n": F.lit(2)}).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in warc.op9_warc(spark, str(tmp_path)).where("page_id is not null").collect())
    first = {}
    for page, _, html in pages:
        raw = (html or "").encode()
        if page is not None and len(raw) >= 100:
            first[raw] = min(first.get(raw, page), page)
    want = []
    for page, _, html in pages:
        raw = (html or "").encode()
        back = first.get(raw, page) if page is not None else None
        if page is not None:
            want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if back != page else "response", back if back != page else None))
    key = lambda r: (*r[:4], r[4] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op9_warc(spark, f"{tmp_path}/none").count() == 0


# ---------------------------------------------------------------- URLs


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for rule, verdict in urlfilter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, "allow"))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://example.org", "HTTP://EXAMPLE.ORG/en/12?x#y", "https://a.b.Example.org/es/", "https://example.org/es", "http://notexample.org/es/1", "http://x.com/fr/1", "http://x.com/de/", "http://com/de/q", "http://É.org/a", "http://u@h.org:80/x", "http://a.org?q=/b", "http://a.org#/b", "x://y://z.org/", "http://example.org/en/1\n", "http://example.org/en/2", "http://.org/", "http://" + "a." * 500 + "org/" + "b" * 5000, "http://example.org/en/1"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls + urls[5:6])], "page_id long, url string, verdict string")
    got = sorted(tuple(r) for r in urlfilter.judge_urls(df, urlfilter.rule_table(spark, urlfilter.RULES)).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == [(i, *plain_verdict(u)) for i, u in enumerate(urls + urls[5:6])]
    none = urlfilter.judge_urls(df, spark.createDataFrame([], "rule string, verdict string"))
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    assert urlfilter.judge_urls(df.limit(0), urlfilter.rule_table(spark, urlfilter.RULES)).count() == 0


def test_the_letters_tag_in_the_last_frame_are_no_tag():
    for n in (200, 1500):
        for back in range(1, 200):
            payload = bytearray(b"x" * n)
            payload[n - back : n - back + 3] = b"TAG"[:back]
            assert mpegaudio.load_bytes(mpegaudio.store_bytes(bytes(payload))) == bytes(payload)
    for n in range(1, 1200, 7):
        payload = b"TAG" * n
        assert mpegaudio.load_bytes(mpegaudio.store_bytes(payload)) == payload
    stored = mpegaudio.store_bytes(b"x" * 1500)
    info = mpegaudio.parse_mpeg(stored.replace(b"TIT2", b"XXXX") + b"TAG" + b"name".ljust(30, b"\0") + bytes(95))
    assert info["tags"]["TIT2"] == "name" and info["bytes_skipped"] == 0
