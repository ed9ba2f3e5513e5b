"""WARC archives: written with an index, read back by coalesced byte ranges.

Each writing task makes its own archives of gzip members, one per record, in a
folder that all executors share, and returns one index row per record: file,
offset, length, URL, payload digest. Index rows come back through Spark's own
commit of task results, so an archive of a lost or repeated task attempt is
simply never referred to. Reading starts from index rows: they are sorted by
file and offset, neighbours are joined into one range read while the gap and
the range stay small, and the records are cut out of what was read.

Records of equal payload (same SHA-1 and length) of ``MIN_REVISIT`` bytes or
more are stored once: the row with the largest page_id is the response, the
others are revisit records that refer to it.

Cases with a defined result: null html is an empty payload; null page_id is
smaller than any other, and written as such; rows that repeat page_id and
payload of a response are responses too; a null URL has no target header;
control characters of a URL are percent-encoded in the archive; empty tables
write nothing and give empty results; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.shipping import map_arrow
from millrace.llm import common

MIN_REVISIT = 1000
#: A task begins a new archive beyond this size.
ARCHIVE_BYTES = 512 << 20
#: Records of one file this close together are fetched by one read, up to RANGE_BYTES; a task reads about SPLIT_BYTES.
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
SPLIT_BYTES = 64 << 20
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record[len("<urn:page:") : -1]
    return None if name == "none" else int(name)


def record_bytes(page_id: int | None, url: str | None, digest: str, payload: bytes | None, refers_to: int | None) -> bytes:
    """One record; ``payload`` None makes it a revisit of ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
    block = http + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(chr(c) for c in range(33, 127) if c != 37))}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the payload (the block without its HTTP head)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _written(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    name, out, at = "", None, 0
    try:
        for batch in batches:
            rows = []
            for page_id, url, html, digest, keep, kind in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "keep", "record_type")), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                payload = html or b"" if kind == "response" else None
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(page_id, url, digest, payload, keep)) + packer.flush()
                out.write(member)
                rows.append((f"{root}/{name}", at, len(member), url, digest, page_id, kind))
                at += len(member)
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "offset", "length", "url", "digest", "page_id", "record_type"])
    finally:
        if out is not None:
            out.close()


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``path``; returns the index, itself written beside the archives."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    large = rows.filter(F.col("size") >= MIN_REVISIT)
    shared = large.groupBy("digest", "size").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    shared = common.cut(shared.select(F.col("digest").alias("d"), F.col("size").alias("s"), "keep", F.lit(True).alias("many")), "warc-shared")
    rows = common.joined(rows, shared, F.expr("digest = d AND size = s"), "left", shared.count() * 96)
    first = F.col("many").isNull() | F.col("page_id").eqNullSafe(F.col("keep"))
    rows = rows.select("page_id", "url", "html", "digest", "keep", F.when(first, "response").otherwise("revisit").alias("record_type"))
    return common.cut(map_arrow(rows, partial(_written, path), INDEX), "warc-index")


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, start, end, positions) of the reads for (file, offset, length) in that order."""
    file, start, end, held = "", 0, 0, []
    for i, (f, offset, length) in enumerate(rows):
        if held and (f != file or offset - end > GAP_BYTES or offset + length - start > RANGE_BYTES):
            yield file, start, end, held
            held = []
        if not held:
            file, start = f, offset
        end = max(end if held else 0, offset + length)
        held.append(i)
    if held:
        yield file, start, end, held


def _read(with_payload: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened: tuple[str, pa.NativeFile] | None = None
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if with_payload else [])]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_payload else [])]
    for batch in batches:
        index = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
        for file, start, end, held in ranges(index):
            if opened is None or opened[0] != file:
                if opened is not None:
                    opened[1].close()
                store, path = fs.FileSystem.from_uri(file)
                opened = (file, store.open_input_file(path))
            data = opened[1].read_at(end - start, start)
            rows = []
            for i in held:
                at = index[i][1] - start
                fields, payload = parsed(zlib.decompress(data[at : at + index[i][2]], 31))
                stated = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                kind, url = fields["warc-type"], fields.get("warc-target-uri")
                row = [page_of(fields["warc-record-id"]), unquote(url) if url is not None else None, kind]
                if kind == "response":
                    row += [None, len(payload), hashlib.sha1(payload).hexdigest()]
                    if row[-1] != stated:
                        raise ValueError(f"{file} at {index[i][1]}: the payload has digest {row[-1]}, its record says {stated}")
                else:
                    row += [page_of(fields["warc-refers-to"]), None, stated]
                rows.append([*row, payload] if with_payload else row)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    if opened is not None:
        opened[1].close()


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the given index rows; payload digests of responses are computed anew, those of revisits are the stated ones."""
    rows = index.select("file", "offset", "length")
    # index rows are narrow and what they stand for is not: tasks are counted by the bytes to read
    total = rows.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // SPLIT_BYTES), 2 * index.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return map_arrow(rows, partial(_read, with_payload), RECORD + (", payload binary" if with_payload else ""))


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to), revisits resolved to their response."""
    index = write_archives(pages, common.shared_path(pages.sparkSession, "warc"))
    back = common.cut(read_records(index, with_payload=False), "warc-records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = back.filter("record_type = 'revisit'")
    if revisits.isEmpty():
        return back.select(columns)
    targets = back.filter("record_type = 'response' AND payload_bytes >= %d" % MIN_REVISIT)
    targets = targets.select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("n")).distinct()
    found = revisits.join(targets, F.expr("refers_to <=> id AND payload_digest = digest"), "left").withColumn("payload_bytes", F.col("n"))
    return back.filter("record_type = 'response'").select(columns).unionByName(found.select(columns))


SQL = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT d, n, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY d, n HAVING count(*) > 1)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.d IS NULL OR p.page_id IS NOT DISTINCT FROM g.keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.d IS NULL OR p.page_id IS NOT DISTINCT FROM g.keep THEN NULL ELSE g.keep END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
"""
