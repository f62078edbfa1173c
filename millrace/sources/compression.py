"""Compressed files: bytes and single files on the driver, folders of zip files by Spark.

Spark's readers open gz, bz2, zst, lz4, snappy and deflate themselves; zip is the one that they don't.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import shutil
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of compressed files, and endings of their names.
MAGIC = {"gzip": b"\x1f\x8b", "bz2": b"BZh", "zip": b"PK\x03\x04", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd"}
ENDINGS = {".gz": "gzip", ".gzip": "gzip", ".bz2": "bz2", ".zip": "zip", ".xz": "xz", ".zst": "zstd"}


def detect(path: str = "", head: bytes = b"") -> str | None:
    """By the first bytes if given, else by the name's ending."""
    by_bytes = next((k for k, m in MAGIC.items() if head.startswith(m)), None)
    return by_bytes or next((k for e, k in ENDINGS.items() if path.lower().endswith(e)), None)


def _zip(data: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data", data)
    return out.getvalue()


def _unzip(data: bytes) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return b"".join(z.read(n) for n in z.namelist())


_PACK: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "gzip": (gzip.compress, gzip.decompress),
    "bz2": (bz2.compress, bz2.decompress),
    "xz": (lzma.compress, lzma.decompress),
    "deflate": (zlib.compress, zlib.decompress),
    "zip": (_zip, _unzip),
}


def compress(data: bytes, kind: str = "gzip") -> bytes:
    return _PACK[kind][0](data)


def decompress(data: bytes, kind: str | None = None) -> bytes:
    kind = kind or detect(head=data[:8])
    return _PACK[kind][1](data) if kind else data


_OPEN = {"gzip": gzip.open, "bz2": bz2.open, "xz": lzma.open}


def compress_file(path: str, to: str, kind: str | None = None) -> None:
    """A local file, streamed."""
    kind = kind or detect(to)
    if kind == "zip":
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            z.write(path, path.rsplit("/", 1)[-1])
        return
    with open(path, "rb") as a, _OPEN[kind](to, "wb") as b:
        shutil.copyfileobj(a, b)


def decompress_file(path: str, to: str, kind: str | None = None) -> None:
    with open(path, "rb") as f:
        kind = kind or detect(path, f.read(8))
    if kind == "zip":
        with zipfile.ZipFile(path) as z, open(to, "wb") as b:
            for n in z.namelist():
                with z.open(n) as a:
                    shutil.copyfileobj(a, b)
        return
    with _OPEN[kind](path, "rb") as a, open(to, "wb") as b:
        shutil.copyfileobj(a, b)


def read_zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all text files within the zip files of a path or glob: path, member, line, value.  A zip
    file is read by one task, line by line; many files are read side by side."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(pa.BufferReader(raw.as_buffer())) as z:
                    for member in z.namelist():
                        held: list[str] = []
                        done = 0
                        with io.TextIOWrapper(z.open(member), "utf-8", errors="replace", newline="\n") as f:
                            for line in f:
                                held.append(line.rstrip("\r\n"))
                                if len(held) == 10_000:
                                    yield _rows(name, member, done, held)
                                    done, held = done + len(held), []
                        if held:
                            yield _rows(name, member, done, held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "path string, member string, line long, value string")


def _rows(name: str, member: str, first: int, held: list[str]) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_pydict({"path": [name] * n, "member": [member] * n, "line": pa.array(range(first, first + n), pa.int64()), "value": pa.array(held, pa.string())})


def read_zipped_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON in zip files, as a table."""
    return read_zipped_lines(spark, path).filter(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_zipped_csv(spark: SparkSession, path: str, schema: str, header: bool = True, delimiter: str = ",") -> DataFrame:
    rows = read_zipped_lines(spark, path)
    rows = rows.filter("line > 0") if header else rows
    return rows.select(F.from_csv("value", schema, {"sep": delimiter}).alias("r")).select("r.*")
