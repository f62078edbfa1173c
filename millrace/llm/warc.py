"""Web archives (WARC 1.1) without repeated payloads, and the resolution of their revisit records.

1. Payloads are stored, compressed, where they are read; a task stores equal ones once.  What goes on
   are heads: page_id, url, digest, size and the place of the payload.
2. Heads are shuffled by payload digest.  Of the records with equal payloads one is the response, and the
   others are revisits that refer to it.
3. Each record gets fresh headers, and responses their payloads from where they are stored.  Archives are
   ``.warc.gz`` files with a gzip member for each record, as the format advises, so that a record can be
   read by its byte offset.

Files are written under a name of their attempt, and archives then renamed, so a task that is run again
leaves one whole file, and the heads of a task name the file of the attempt that counts.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow, fresh_path, hot_limit, join_hot, materialize, prepare, remove

#: Payloads of fewer bytes are written in full each time.
MIN_BYTES = 1000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests that a task remembers the place of.
PLACES = 200_000


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def stored(pages: DataFrame, path: str) -> DataFrame:
    """Stores the payloads of ``pages`` (page_id, url, html) in files under ``path`` and returns their heads:
    page_id, url, payload_bytes, payload_digest (SHA-1, hex), file, row, offset and size.  ``file`` and
    ``row`` name a row; the payload is the ``size`` bytes at ``offset``, zstd."""
    prepare(pages.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = _fs(path)
        disk.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        places: dict[bytes, tuple[int, int]] = {}
        row = at = 0
        with disk.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                found: list[tuple] = []
                for html in batch.column(2):
                    raw = html.as_buffer() if html.is_valid else pa.py_buffer(b"")
                    digest = hashlib.sha1(raw).digest()
                    if digest not in places:
                        if len(places) >= PLACES:
                            places.clear()
                        packed = pa.compress(raw, "zstd") if raw.size else pa.py_buffer(b"")
                        out.write(packed)
                        places[digest] = at, packed.size
                        at += packed.size
                    found.append((raw.size, digest.hex(), name, row, *places[digest]))
                    row += 1
                if found:
                    cols = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], names=["page_id", "url", "payload_bytes", "payload_digest", "file", "row", "offset", "size"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialize(arrow(rows, store, "page_id long, url string, payload_bytes long, payload_digest string, file string, row long, offset long, size long"), "heads")


def headers(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds to the heads of ``stored``: record_type, refers_to (page_id), and the refers_url and _refers (file, row) of
    the response.

    Of rows with equal payloads of at least ``min_bytes``, the one with the largest page_id is the
    response; rows that repeat this id are responses too, as a page doesn't revisit itself, and one of them is
    referred to.  Rows without page_id can't be referred to and are responses.  A null html is an
    empty payload.
    """
    able = heads.filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    originals = able.groupBy("payload_digest").agg(F.max(F.struct("page_id", "file", "row", "url")).alias("_o"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    found = join_hot(heads, originals, ["payload_digest"], hot_limit(heads.count()), "left")
    revisit = F.col("page_id") < F.col("_o.page_id")
    return found.select(
        *heads.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_o.page_id")).alias("refers_to"),
        F.when(revisit, F.col("_o.url")).alias("refers_url"),
        F.when(revisit, F.struct("_o.file", "_o.row")).alias("_refers"),
    )


def _urn(file: Column, row: Column) -> Column:
    """A record's id: rows are named by the random name of their file and their place in it."""
    h = F.md5(F.concat(file, F.lit(" "), row.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _uri(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("urn:none")), r"[\x00-\x20\x7F]", "%20")


def record_heads(rows: DataFrame, date: str) -> DataFrame:
    """Adds to ``headers`` the text of each WARC record up to its payload, as ``head``."""
    is_revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", _urn(F.col("file"), F.col("row"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _uri(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(is_revisit, _urn(F.col("_refers.file"), F.col("_refers.row")))),
        ("WARC-Refers-To-Target-URI", F.when(is_revisit, _uri(F.col("refers_url")))),
        ("WARC-Refers-To-Date", F.when(is_revisit, F.lit(date))),
        ("X-Page-Id", F.col("page_id").cast("string")),
        ("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", (F.octet_length(http) + F.when(is_revisit, 0).otherwise(F.col("payload_bytes"))).cast("string")),
    ]
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in fields]  # null, and left out, where there is no value
    return rows.withColumn("head", F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n"), http))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: datetime | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html; other columns are left alone) as deduplicated archives with fresh
    headers under ``path``, a file a task.  ``date`` is that of all records, now by default; the table has none.

    Returns the manifest: file, records.
    """
    spark = pages.sparkSession
    payloads = fresh_path(spark, "payloads")
    moment = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = _fs(path)
        held = _fs(payloads)[1]
        out, n, part = None, 0, TaskContext.get().partitionId()
        source, opened = None, None
        for batch in batches:
            if out is None:
                disk.create_dir(root, recursive=True)
                temp = f"{root}/.{part}-{uuid.uuid4().hex}"
                out = disk.open_output_stream(temp, compression=None)
            for file, at, size, payload_bytes, kind, head in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(member.compress(head.as_buffer()))
                if kind == "response" and size:
                    if opened != file:
                        if source is not None:
                            source.close()
                        source, opened = disk.open_input_file(f"{held}/{file}"), file
                    out.write(member.compress(pa.decompress(source.read_at(size, at), payload_bytes, "zstd")))
                out.write(member.compress(END.encode()) + member.flush())
                n += 1
        if source is not None:
            source.close()
        if out is not None:
            out.close()
            name = f"part-{part:06d}.warc.gz"
            disk.move(temp, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    heads = stored(pages, payloads)
    rows = record_heads(headers(heads, min_bytes), moment).select("file", "offset", "size", "payload_bytes", "record_type", "head", "row")
    rows = rows.repartition("file").sortWithinPartitions("file", "row").drop("row")
    manifest = materialize(arrow(rows, write, "file string, records long"), "archives")
    remove(spark, payloads)
    return manifest


def members(f) -> Iterator[bytes]:
    """The content of each gzip member of a file, one at a time."""
    rest = b""
    while True:
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            rest = rest or f.read(1 << 20)
            if not rest:
                if out:
                    raise ValueError("an archive breaks off")
                return
            out.append(member.decompress(rest))
            rest = member.unused_data
        yield b"".join(out)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Header fields and block of each record of an archive."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        if raw[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = raw.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        start = end + 4
        at = start + int(fields["Content-Length"])
        yield fields, view[start:at]
        at += len(END)


def read_archives(files: DataFrame, path: str) -> DataFrame:
    """Heads of all records of the ``files`` (file) under ``path``: page_id, record_type,
    payload_bytes and payload_digest as found in the record's own payload (of a revisit: null, and
    its header's), refers_to."""
    number = lambda x: None if x is None else int(x)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]

    def heads(f) -> Iterator[tuple]:
        for raw in members(f):
            for fields, block in parse(raw):
                if fields["WARC-Type"] == "revisit":
                    size, digest = None, fields["WARC-Payload-Digest"].removeprefix("sha1:")
                else:
                    payload = block[bytes(block[:400]).index(b"\r\n\r\n") + 4 :]
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                yield number(fields.get("X-Page-Id")), fields["WARC-Type"], size, digest, number(fields.get("X-Refers-To-Page-Id"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _fs(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    found = heads(f)
                    while rows := list(itertools.islice(found, 2000)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    some = files.select("file")
    return arrow(some.repartition(max(1, some.count()), "file"), read, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long")


def resolve(heads: DataFrame) -> DataFrame:
    """Gives revisits the payload size of the response that they refer to, found by its page_id and
    digest; it stays null if the archives don't hold it."""
    heads = materialize(heads, "heads")
    originals = heads.filter(F.col("record_type") == "response").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    found = join_hot(heads, originals, ["refers_to", "payload_digest"], hot_limit(heads.count()), "left")
    return found.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def archived(spark: SparkSession, pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes ``pages`` to archives, reads them back and resolves their revisits: a row a page.  See
    ``headers`` for null and repeated page_ids and null payloads; an empty table gives no rows."""
    path = fresh_path(spark, "warc")
    return resolve(read_archives(write_archives(pages, path, min_bytes), path))


#: The same in DuckDB's SQL.
SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 AND page_id IS NOT NULL GROUP BY 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id < o.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < o.first THEN o.first END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND p.payload_bytes >= 1000
"""
