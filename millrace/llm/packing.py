"""Best-fit packing planned on a histogram of lengths.

Documents are cut into pieces of at most the capacity.  Only the number of pieces of each length
goes to the driver (capacity numbers at most, whatever the corpus).  Best-fit decreasing is run over
these counts: many pieces of one length are placed at a time.  The plan says which ranks within a
length get which sequences and offsets; pieces find their place by their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.llm.common import arrow, materialize, prepare

CAPACITY = 2048
END_ID = 0
#: Slots of a plan that are broadcast; a plan of pieces of up to 2048 tokens has some ten thousands, whatever the corpus.
SLOTS = 200_000


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts by length: (length, first rank, ranks, first sequence, offset).

    Sequences with equal room are handled as one run.  The longest pieces come first; each goes to the
    sequence with the least room that holds it, several to one sequence while they fit, and to new
    sequences when none does.  Piece ``first rank + i`` of a length goes to sequence
    ``first sequence + i`` at the offset.
    """
    rooms: list[int] = []  # rooms that some run has, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, sequences)
    slots: list[tuple[int, int, int, int, int]] = []
    used = 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(k)
            else:
                room, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = room // length
            full = min(n, left // each)
            for j in range(each if full else 0):
                slots.append((length, rank, full, first, capacity - room + j * length))
                rank += full
            left -= full * each
            put(room - each * length, first, full)
            if full < n:
                some = min(left, each)  # one sequence gets what is left, if anything
                for j in range(some):
                    slots.append((length, rank, 1, first + full, capacity - room + j * length))
                    rank += 1
                left -= some
                put(room - some * length, first + full, 1 if some else 0)
                put(room, first + full + bool(some), n - full - bool(some))
    return slots


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, narrow: bool = False) -> DataFrame:
    """Pieces of each document of (doc_id, text): doc_id, piece, start, length, ids (binary; uint32, or, if
    ``narrow``, uint16 where the vocabulary allows it).

    A null text counts as empty, and every document ends with id 0, so it has a piece at least.  Of a
    document longer than the capacity, the first piece takes what is over whole pieces.
    """
    prepare(docs.sparkSession)
    tokenizer = tokenizer or tokens.tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        kind = enc.dtype if narrow else np.dtype("<u4")
        for batch, encoded in enc.batches(batches, 1):
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids = np.append(ids, END_ID).astype(kind)
                start, piece = 0, 0
                end = len(ids) % capacity or capacity
                while start < len(ids):
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(end - start)
                    out["ids"].append(ids[start:end].tobytes())
                    start, end, piece = end, end + capacity, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["ids"], pa.binary())], names=list(out)
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(rows, cut, "doc_id long, piece int, start long, length long, ids binary")


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "start")) -> DataFrame:
    """Gives each row of ``pieces`` (a ``length`` column of 1 to ``capacity``, any others) its
    sequence_id and offset.  ``order`` settles ranks among pieces of one length.

    Rows carry their other columns, ids as well, to where they are ranked, once; their place needs no more moves.
    Ranks are counted within (length, part), a part being what one task wrote, plus what the parts
    before hold of the length, so that a very common length is not ranked by one task.
    """
    spark = pieces.sparkSession
    rows = materialize(pieces.withColumn("_part", F.spark_partition_id()), "pieces")
    by_part = materialize(rows.groupBy("length", "_part").agg(F.count("*").alias("_n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # one row a length
    if any(not 1 <= x <= capacity for x in counts if x is not None) or None in counts:
        raise ValueError("a piece is empty or longer than a sequence")
    slots = plan_best_fit(counts, capacity)
    plan = spark.createDataFrame(slots, "length long, _lo long, _ranks long, _seq long, offset long").withColumnRenamed("length", "_len")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_part").orderBy(*(F.col(c).asc_nulls_last() for c in order))
    # the window has dealt the rows out by these columns already; what grows with the tasks isn't broadcast
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1).join(base.hint("merge"), ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    # the plan has rows by length and run of sequences, not by piece
    placed = ranked.join(F.broadcast(plan) if len(slots) <= SLOTS else plan, (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_lo") + F.col("_ranks")))
    return placed.withColumn("sequence_id", F.col("_seq") + F.col("_rank") - F.col("_lo")).drop("_part", "_base", "_rank", "_len", "_lo", "_ranks", "_seq")


def _placed(docs: DataFrame, tokenizer: str | None, capacity: int, digest: bool) -> DataFrame:
    """Packs (doc_id, text).  Ids move to their places as narrow as the vocabulary allows; from there, they
    are given as uint32, or their checksums are."""
    packed = best_fit_pack(token_pieces(docs, tokenizer, capacity, narrow=True), capacity, ("doc_id", "piece", "start", "ids"))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            last = pa.array(map(zlib.crc32, wide), pa.int64()) if digest else pa.array(wide, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], last], names=[*batch.schema.names[1:], "ids_crc32" if digest else "ids"])

    rows = packed.select("ids", "length", "doc_id", "piece", "start", "sequence_id", "offset")
    return arrow(rows, widen, "length long, doc_id long, piece int, start long, sequence_id long, offset long, " + ("ids_crc32 long" if digest else "ids binary"))


def packed_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs (doc_id, text) and returns the pieces with their ids in their places: doc_id, piece, start,
    length, ids (uint32, binary), sequence_id and offset.  Repeated rows are packed as often as they stand there."""
    return _placed(docs, tokenizer, capacity, False).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """As ``packed_pieces``, with checksums, taken where the ids have been placed, instead of ids: doc_id,
    piece, start, length, ids_crc32, sequence_id and offset."""
    return _placed(docs, tokenizer, capacity, True).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of ``packed_pieces``: sequence_id, length, ids (uint32, binary), and the offsets at which
    pieces begin.  A sequence has at most as many pieces as its capacity."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    ids = F.aggregate(F.slice("_p", 2, F.lit(1 << 30)), F.element_at("_p", 1)["ids"], lambda whole, p: F.concat(whole, p["ids"]))
    return rows.select("sequence_id", "length", ids.alias("ids"), F.col("_p.offset").alias("offsets"))
