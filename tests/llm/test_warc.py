import gzip
import hashlib
import random

import duckdb
import pyarrow.parquet as pq
from pyarrow import fs as pafs

from spanglass.llm import queries, warc

SF = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cols = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = con.sql(f"SELECT {cols} FROM ({queries.ORACLE['op7_warc']}) ORDER BY 1").fetchall()
    got = [tuple(r) for r in queries.QUERIES["op7_warc"](spark, SF).select(*cols.split(", ")).orderBy("page_id").collect()]
    assert got == want


def rows():
    rng = random.Random(2)
    noise = "".join(chr(rng.randint(32, 0x2FF)) for _ in range(300_000))  # more than a chunk, and it does not compress well
    long = "é" * 60
    return [(1, "u 1\n%25", long, 1), (2, None, long, 1), (2, None, long, 1), (3, "x", None, 1), (4, "x", "", 1), (5, "x", "short", 1), (6, "x", "short", 1), (7, "x", noise, 1), (8, "y", noise, 1), (9, "z", noise + "!", 1), (None, "n", "n" * 200, 1)]


def test_round_trip_at_any_split(spark):
    data = rows()
    pages = spark.createDataFrame(data, "page_id long, url string, html string, payload int")
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(pages.coalesce(1), folder, archive_bytes=200_000)
    assert manifest.count() > 1
    for split in (20_011, 50_000, 10**9):
        got = warc.read_archives(spark, manifest, split_bytes=split).collect()
        assert len(got) == len(data)
        for r in got:
            page = next(x for x in data if x[0] == r.page_id)
            payload = (page[2] or "").encode()
            assert (r.url, r.payload_bytes, r.payload_digest) == (page[1], len(payload), hashlib.sha256(payload).hexdigest())
            assert r.payload == (None if r.record_type == "revisit" else payload)
        assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [(2, 1), (2, 1), (8, 7)]


def test_archives_are_plain_warc(spark):
    pages = spark.createDataFrame(rows()[:3], "page_id long, url string, html string, payload int")
    store = pafs.LocalFileSystem()
    for r in warc.write_archives(pages, warc.archive_folder(spark)).collect():
        text = gzip.decompress(store.open_input_file(pafs.FileSystem.from_uri(r.path)[1]).read())
        assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Record-ID") == r.records


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(pages, warc.archive_folder(spark))).count() == 0
