from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import os

from pyspark.sql import functions as F

from freightlens.llm import queries, warc
from tests.conftest import SF_SMALL


def brute(rows, min_bytes=0):
    groups = {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        original = max((p for p in groups[data] if p is not None), default=None)
        revisit = len(data) >= min_bytes and page is not None and page < original
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=str)


def round_trip(spark, rows, path, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, path, **options)
    read = warc.resolved(warc.read_archives(spark, path)).collect()
    return sorted(((r.id, r.n_bytes, r.digest, r.record_type, r.refers_to) for r in read), key=str), read


ROWS = [
    (1, "http://a/1", "same"),
    (2, "http://a/2", "same"),
    (9, "http://a/9", "same"),
    (3, None, None),
    (4, "http://a/b c\r\nX: y", ""),
    (5, "http://a/5", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\nWARC/1.1\r\nétoile"),
    (6, "http://a/6", "x" * 300_000 + "\n\r\n\r\n"),
    (7, "http://a/7", "own"),
    (7, "http://a/7", "own"),
    (8, "http://a/8", "\x1f\x8b binary-ish \x00"),
    (5, "http://a/5", "same"),
    (None, "http://a/0", "same"),
]


def test_round_trip(spark, tmp_dir):
    got, read = round_trip(spark, ROWS, tmp_dir + "/a")
    assert got == brute(ROWS)
    urls = {r.id: r.url for r in read}
    assert urls[1] == "http://a/1" and urls[3] is None and "\r" not in urls[4]


def test_plain_archives_and_least_size(spark, tmp_dir):
    got, _ = round_trip(spark, ROWS, tmp_dir + "/b", min_bytes=4, compression="none")
    assert got == brute(ROWS, 4)


def test_one_payload_very_many_times(spark, tmp_dir):
    rows = [(i, f"http://h/{i}", "boiler" if i % 3 else f"p{i}") for i in range(600)]
    got, _ = round_trip(spark, rows, tmp_dir + "/c")
    assert got == brute(rows)


def test_files_are_bounded_by_bytes(spark, tmp_dir):
    rows = [(i, f"http://h/{i}", f"{i:04d}" * (25_000 if i % 10 == 0 else 50)) for i in range(200)]
    path = tmp_dir + "/bytes"
    got, _ = round_trip(spark, rows, path, file_bytes=150_000)
    assert got == brute(rows)
    largest_record = 100_000 + 1_000
    sizes = [len(gzip.decompress(open(f, "rb").read())) for f in glob.glob(path + "/*/*.gz")]
    assert len(sizes) > 10 and max(sizes) <= 150_000 + largest_record


def test_columns_with_clashing_names(spark, tmp_dir):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    for name in ("id", "digest", "n_bytes", "original", "payload", "record", "file", "least"):
        pages = pages.withColumn(name, F.lit(f"other {name}"))
    warc.write_archives(pages, tmp_dir + "/e")
    read = warc.resolved(warc.read_archives(spark, tmp_dir + "/e")).collect()
    got = sorted(((r.id, r.n_bytes, r.digest, r.record_type, r.refers_to) for r in read), key=str)
    assert got == brute(ROWS)


def test_headers_carry_the_date(spark, tmp_dir):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archives(pages, tmp_dir + "/f", date="2031-05-06T07:08:09Z", compression="none")
    found = 0
    for folder, _, names in os.walk(tmp_dir + "/f"):
        for name in names:
            if name.startswith("part-"):
                with open(os.path.join(folder, name), "rb") as stream:
                    for headers, _ in warc.parse_records(stream):
                        assert headers["warc-date"] == "2031-05-06T07:08:09Z"
                        found += 1
    assert found == len(ROWS)


def test_empty_table(spark, tmp_dir):
    assert round_trip(spark, [], tmp_dir + "/d")[0] == []


def test_query_on_the_table(spark):
    pages = queries.table(spark, SF_SMALL, "pages").select("page_id", "url", "html").collect()
    got = queries.op5_warc_revisits(spark, SF_SMALL).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(got, key=str) == brute([tuple(p) for p in pages])
