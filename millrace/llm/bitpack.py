"""Token ids of a corpus in files of fixed-width packed bits, read back by random access.

File format (all numbers little-endian):

* 8 bytes ``MRBITS01``;
* blocks: each holds up to ``BLOCK`` ids, every id in ``bits`` bits, the lowest bit first, padded to
  whole bytes.  Ids run on from one document to the next;
* index: int64 byte offset of each block; int64 id, uint8 null flag of the id, and int64 number of
  ids of each document, in file order;
* trailer of 6 int64: bits, ids in all, ids a block, blocks, documents, byte offset of the index.

As every full block holds the same number of ids, the place of any id is known from the offsets.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.llm.common import arrow, fresh_path, materialize, prepare

MAGIC = b"MRBITS01"
BLOCK = 1 << 16
END_ID = 0


def min_bits(size: int) -> int:
    """Least bits that tell ``size`` ids apart."""
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.packbits(np.pad(planes, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u4").ravel()


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0
        self.offsets: list[int] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.at = out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, "<u4")
        upto = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, upto, self.block):
            self.offsets.append(self.at)
            self.at += self.out.write(pack(ids[a : min(a + self.block, upto)], self.bits))
        self.total += upto
        self.rest = [ids[upto:].copy()]
        self.held = len(ids) - upto

    def close(self) -> None:
        self._flush(True)
        nulls = np.array([d is None for d in self.doc_ids], np.uint8)
        for x in (np.array(self.offsets, "<i8"), np.array([d or 0 for d in self.doc_ids], "<i8"), nulls, np.array(self.lengths, "<i8")):
            self.out.write(x.tobytes())
        self.out.write(np.array([self.bits, self.total, self.block, len(self.offsets), len(self.doc_ids), self.at], "<i8").tobytes())


class Reader:
    """Reads any run of ids of a file by the blocks that hold it."""

    def __init__(self, f):
        self.f = f
        f.seek(0)
        if f.read(8) != MAGIC:
            raise ValueError("not a file of packed ids")
        size = f.size()
        f.seek(size - 48)
        self.bits, self.total, self.block, blocks, docs, at = np.frombuffer(f.read(48), "<i8").tolist()
        f.seek(at)
        self.offsets = np.frombuffer(f.read(8 * blocks), "<i8")
        self.doc_ids = np.frombuffer(f.read(8 * docs), "<i8")
        self.nulls = np.frombuffer(f.read(docs), np.uint8).astype(bool)
        self.lengths = np.frombuffer(f.read(8 * docs), "<i8")
        self.kept: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def _block(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            n = min(self.block, self.total - k * self.block)
            self.f.seek(int(self.offsets[k]))
            self.kept = (k, unpack(self.f.read((n * self.bits + 7) // 8), self.bits, n))
        return self.kept[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        if n <= 0:
            return np.empty(0, "<u4")
        out = []
        for k in range(start // self.block, (start + n - 1) // self.block + 1):
            a = k * self.block
            out.append(self._block(k)[max(0, start - a) : start + n - a])
        return out[0] if len(out) == 1 else np.concatenate(out)


def write_packed(docs: DataFrame, path: str, tokenizer: str | None = None, files: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text; other columns are left alone) into files under ``path``.

    Documents lie in ascending doc_id over the files in the order of their names, null ids last, rows
    of one id by a hash of the text.  A null text counts as empty; each document ends with id 0.  Returns the
    manifest: file, part, n_docs, n_tokens, first (ids of all files before).  A file is written under
    a name of its own attempt and then renamed, so a task that is run again leaves one whole file.
    """
    spark = docs.sparkSession
    prepare(spark)
    tokenizer = tokenizer or tokens.tokenizer_path()
    # rows of one id are in the order of a hash: sort keys are sampled, and texts may be long
    order = [F.col("doc_id").asc_nulls_last(), F.col("_hash").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_hash", F.xxhash64("text"))
    rows = (rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, out = tokens.encoder(tokenizer), None, None
        store, root = _fs(path)
        part = TaskContext.get().partitionId()
        for batch, encoded in enc.batches(batches, 1):
            if writer is None:
                store.create_dir(root, recursive=True)
                temp = f"{root}/.{part}-{uuid.uuid4().hex}"
                out = store.open_output_stream(temp)
                writer = Writer(out, min_bits(enc.size))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                writer.add(doc_id, np.append(ids, END_ID).astype("<u4"))
        if writer is not None:
            writer.close()
            out.close()
            name = f"part-{part:06d}.bits"
            store.move(temp, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "part": [part], "n_docs": [len(writer.doc_ids)], "n_tokens": [writer.total]})

    manifest = materialize(arrow(rows, encode, "file string, part long, n_docs long, n_tokens long"), "manifest")
    # one row a file; the running sum over files is what places each in the corpus
    found, first = [], 0
    for r in manifest.orderBy("part").collect():
        found.append((r.file, r.part, r.n_docs, r.n_tokens, first))
        first += r.n_tokens
    return spark.createDataFrame(found, "file string, part long, n_docs long, n_tokens long, first long")


def read_packed(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Reads the files of ``write_packed``: doc_id, start, n_tokens, ids (binary, uint32)."""
    prepare(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _fs(path)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    r = Reader(f)
                    at = np.concatenate([[0], np.cumsum(r.lengths)])
                    for a in range(0, len(r.lengths), 256):
                        some = range(a, min(a + 256, len(r.lengths)))
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(r.doc_ids[a : a + 256], pa.int64(), mask=r.nulls[a : a + 256]),
                                "start": pa.array(first + at[a : a + len(some)], pa.int64()),
                                "n_tokens": pa.array(r.lengths[a : a + 256], pa.int64()),
                                "ids": pa.array([r.ids(int(at[i]), int(r.lengths[i])).tobytes() for i in some], pa.binary()),
                            }
                        )

    files = manifest.select("file", "first")
    n = max(1, files.count())
    return arrow(files.repartition(n, "file"), read, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def packed_digest(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` as packed ids, reads the files back and returns doc_id, start, n_tokens and
    ids_crc32 of each document.  Empty tables give no files and no rows."""
    path = fresh_path(spark, "bits")
    manifest = write_packed(docs, path, tokenizer)
    return read_packed(spark, path, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
