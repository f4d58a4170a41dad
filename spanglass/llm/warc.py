"""WARC archives: a writer with revisit records and a splittable reader.

Writing.  Each record is a gzip member of its own.  Pages with equal payloads are found by
SHA-256: the one with the smallest page id is written as a response, the others as
revisit records that name it and carry digest and length, but no payload.  Each
task writes files with names of its own; the manifest, written through Spark's
committer, lists the files of the attempts that count, so a lost executor leaves
at most files that nothing reads.

Reading.  Archives are cut into byte ranges, one row each.  A task scans its range for
gzip magic, decodes the header of each candidate member and takes the first that is
a WARC record; from there members follow one another.  It owns the records that start
inside its range and reads the last of them past its end.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanglass.llm.shared import new_path, table_of

MAGIC = b"\x1f\x8b\x08"
MIN_REVISIT = 100
SPLIT_BYTES = 16_000_000
ARCHIVE_BYTES = 512_000_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_CHUNK = 1 << 18
_BATCH_BYTES = 8_000_000

RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


# ---- records


def _escaped(url: str) -> str:
    """A header value can't hold control characters or spaces."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)


def _unescaped(url: str) -> str:
    return re.sub(r"%([01][0-9A-F]|20|7F|25)", lambda m: chr(int(m[1], 16)), url)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(m[1]) if m else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int = 6) -> bytes:
    """One gzip member."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def decode_record(data: bytes) -> dict:
    """The fields of RECORD; the digest and length of a response are taken from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    row = {"page_id": _page_of(fields.get("warc-record-id")), "url": None, "record_type": fields["warc-type"], "refers_to": _page_of(fields.get("warc-refers-to"))}
    if "warc-target-uri" in fields:
        row["url"] = _unescaped(fields["warc-target-uri"])
    if row["record_type"] == "revisit":
        row |= {"payload": None, "payload_bytes": int(fields["x-payload-length"]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:")}
    else:
        payload = block.partition(b"\r\n\r\n")[2]
        row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    return row


# ---- writing


def with_roles(pages: DataFrame, *, id_col: str, url_col: str, html_col: str, min_revisit: int) -> DataFrame:
    """(page_id, url, payload, digest, refers_to); refers_to is null for responses."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    d = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    d = d.withColumn("digest", F.sha2("payload", 256))
    # Aggregated before the shuffle, so a payload that many pages share is a row for each task; only shared ones are kept.
    first = d.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = table_of(first.filter("n > 1").select("digest", "first"), "warc-first")
    d = d.join(first, "digest", "left")  # both sides are exchanged for this join only, so Spark may split a hot digest
    return d.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record a page below ``folder`` (a URI that all executors reach) and return the manifest (path, records, bytes).

    A null html is an empty payload, a null url gives no target URI, a null page id never refers or is
    referred to.  Payloads under ``min_revisit`` bytes are always responses.  Repeated rows each give
    a record; those equal in id and payload are all responses if their id is the smallest.
    An empty table gives an empty manifest.  Further columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        out, name, records, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    name, records, size = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = encode_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), date)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "records", "bytes"])

    rows = with_roles(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_revisit=min_revisit)
    return table_of(rows.mapInArrow(write, "path string, records bigint, bytes bigint"), "warc-manifest")


# ---- reading


class _Bytes:
    """A file read forwards in chunks, from any place."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, min(n, self.size - start)))


def _is_record(data: _Bytes, start: int) -> bool:
    """The member at ``start`` decodes and begins with a WARC header."""
    try:
        got = zlib.decompressobj(31).decompress(data.at(start, 4096), 512)
    except zlib.error:
        return False
    return got.startswith(b"WARC/1.") and b"\r\n" in got


def first_record(data: _Bytes, start: int, end: int) -> int | None:
    """Where the first record that starts in [start, end) does."""
    at = start
    while at < end:
        chunk = data.at(at, _CHUNK + len(MAGIC) - 1)
        if len(chunk) < len(MAGIC):
            return None
        found = chunk.find(MAGIC)
        while found >= 0 and at + found < end:
            if _is_record(data, at + found):
                return at + found
            found = chunk.find(MAGIC, found + 1)
        at += _CHUNK
    return None


def member(data: _Bytes, start: int) -> tuple[bytes, int]:
    """The content of the member at ``start``, and where the next begins."""
    unpack, parts, at = zlib.decompressobj(31), [], start
    while not unpack.eof:
        chunk = data.at(at, _CHUNK)
        if not chunk:
            raise ValueError(f"a record that starts at {start} is cut off")
        parts.append(unpack.decompress(chunk))
        at += len(chunk)
    return b"".join(parts), at - len(unpack.unused_data)


def records_in(data: _Bytes, start: int, end: int) -> Iterator[dict]:
    at = first_record(data, start, end)
    while at is not None and at < min(end, data.size):
        content, at = member(data, at)
        yield decode_record(content)


def read_archives(spark: SparkSession, manifest: DataFrame, *, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (path, bytes): RECORD, without payload if not wanted.

    Revisit records have no payload; their digest and length are those that they state.  A record that
    is cut off or damaged raises an error.  No archives give no rows.
    """
    keep = [x for x in _RECORD.names if with_payload or x != "payload"]
    schema = pa.schema([_RECORD.field(x) for x in keep])
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint")))
    ranges = manifest.filter("bytes > 0").select("path", starts.alias("start")).select("path", "start", (F.col("start") + split_bytes).alias("end"))
    tasks = max(1, min(20_000, ranges.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = pafs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for r in records_in(_Bytes(file, file.size()), row["start"], row["end"]):
                        rows.append(r)
                        held += 400 + len(r["payload"] or b"") * with_payload
                        if held >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    fields = ", ".join(x for x in RECORD.split(", ") if x.split()[0] in keep)
    return ranges.repartition(tasks).mapInArrow(read, fields)


def archive_folder(spark: SparkSession) -> str:
    return new_path(spark, "warc")
