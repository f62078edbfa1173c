"""Passages that repeat across documents, by a sparse suffix array.

Words are sampled at minimisers only: of every row of places, as many as a passage leaves room for, the
one whose next ``GRAM`` words have the smallest hash.  A passage of ``MIN_WORDS`` words has a minimiser
within itself, and it is the same in each copy.  The windows of ``MIN_WORDS`` words that share a
minimiser follow one another, and are one segment.

A segment that a smaller doc_id has too is a repeat as a whole.  Of the others, one for each document
that has it first, those whose gram stands in segments of several documents are opened: all their
windows are looked up the same way.  So a window is found exactly if a smaller doc_id has it, whatever
goes before or after and however often it occurs; the smallest doc_id is the original and stays.

Rows are looked up by a sort by range of (hash, doc_id, place), so ones with very many copies are spread
over tasks; what a border parts is put right by what each task says of its first and last hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow, forget, hashed_words, likely, materialize, mix64, parted, prepare

MIN_WORDS = 50
GRAM = 24
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _STEP, np.uint64), np.full(n + 1, _BACK, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def run_hashes(sums: np.ndarray, up: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of word runs [start, end) from running sums; equal runs have equal hashes wherever they stand."""
    return mix64((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    return hashed_words([text], lower=False)[1]


def _running(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of word hashes, and the powers that ``run_hashes`` wants."""
    up, down = _powers(len(words))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words) * down[: len(words)], dtype=np.uint64)]), up


def segments(texts: pa.Array | list[str | None], min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Of all texts: text, place of the first window, windows, hash of the gram at the minimiser, hash
    of all words of the windows."""
    lengths, every = hashed_words(texts, lower=False)
    n = len(every)
    empty = np.empty(0, np.int64)
    if n < min_words:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums, up = _running(every)
    at = np.arange(n - GRAM + 1)
    gram = run_hashes(sums, up, at, at + GRAM)
    text = np.repeat(np.arange(len(texts)), lengths)
    first = np.arange(n - min_words + 1)
    first = first[text[first] == text[first + min_words - 1]]  # windows within one text
    view = np.lib.stride_tricks.sliding_window_view(gram, min_words - GRAM + 1)
    chosen = np.concatenate([first[a : a + 20_000] + view[first[a : a + 20_000]].argmin(axis=1) for a in range(0, len(first), 20_000)] or [empty])
    begins = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(chosen) else empty
    count = np.diff(np.append(begins, len(chosen)))
    start = first[begins]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return text[start], start - starts[text[start]], count, gram[chosen[begins]], run_hashes(sums, up, start, start + count + min_words - 1)


def sampled_segments(docs: DataFrame, min_words: int) -> DataFrame:
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, count, gram, whole = segments(batch.column(1), min_words)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(ids), pa.array(place.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(gram.view(np.int64))], names=["hash", "doc", "place", "count", "gram"])

    return arrow(docs.filter("doc_id is not null"), sample, "hash long, doc long, place int, count int, gram long")


def with_least(rows: DataFrame, what: str) -> DataFrame:
    """Adds ``least``, the smallest doc among the rows of equal hash, to ``rows`` (hash, doc, place, and others)."""
    names = rows.columns
    fields = rows.schema.fields

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []  # the task's first and last hash: other tasks may have rows of them
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            begins = np.concatenate([[True], key[1:] != key[:-1]])
            least = doc[np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))]
            if edges and edges[-1][0] == key[0]:
                after = np.flatnonzero(begins[1:])
                least[: after[0] + 1 if len(after) else len(key)] = edges[-1][1]
            edges = [edges[0] if edges else (key[0], least[0]), (key[-1], least[-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), pa.array(np.zeros(len(key), bool))], names=[*names, "least", "edge"])
        if edges:
            cols = [pa.array([int(e[0]) for e in edges], pa.int64())] + [pa.nulls(len(edges), {"bigint": pa.int64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in fields[1:]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([int(e[1]) for e in edges], pa.int64()), pa.array([True] * len(edges))], names=[*names, "least", "edge"])

    order = ["hash", "doc", "place"]
    rows = materialize(rows, what)  # a sort by range reads its input twice
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", least long, edge boolean"
    found = materialize(arrow(rows.repartitionByRange(*order).sortWithinPartitions(*order), mark, schema), what)
    forget(rows)
    # at most two rows a task
    edges = found.filter("edge").groupBy("hash").agg(F.min("least").alias("_all"))
    return found.filter("not edge").join(F.broadcast(edges), "hash", "left").select(*names, F.coalesce("_all", "least").alias("least"))


def _holds(words: np.ndarray, items: list[dict], min_words: int) -> list[dict]:
    """The items that stand in this text; a document may have several."""
    items = [r for r in items if r["place"] + r["count"] + min_words - 1 <= len(words)]
    if not items:
        return []
    sums, up = _running(words)
    start, count = np.array([r["place"] for r in items], np.int64), np.array([r["count"] for r in items], np.int64)
    same = run_hashes(sums, up, start, start + count + min_words - 1).view(np.int64) == np.array([r["hash"] for r in items], np.int64)
    return [r for r, ok in zip(items, same.tolist(), strict=True) if ok]


def _beside(text: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """The texts that have items (doc and ``columns``), with them; others stay where they are."""
    some = likely(text, ["doc_id"], items.select(F.col("doc").alias("doc_id")), items.count())
    return some.join(items.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct(*columns)).alias("items")), "doc_id")


def opened(text: DataFrame, parts: DataFrame, min_words: int) -> DataFrame:
    """The windows (hash, doc, place) of segments (doc, place, count, hash)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, items in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = word_hashes(text)
                held = _holds(words, items, min_words)
                if not held:
                    continue
                at = np.concatenate([np.arange(r["place"], r["place"] + r["count"]) for r in held])
                sums, up = _running(words)
                yield pa.RecordBatch.from_arrays([pa.array(run_hashes(sums, up, at, at + min_words).view(np.int64)), pa.array(np.full(len(at), doc, np.int64)), pa.array(at.astype(np.int32))], names=["hash", "doc", "place"])

    return arrow(_beside(text, parts, ["place", "count", "hash"]), windows, "hash long, doc long, place int")


def _spans(text: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """One row for each document that has repeats, with its text and its spans."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, out = [], [], []
            for doc, text, items in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held = _holds(word_hashes(text), items, min_words)
                if held:
                    docs.append(doc)
                    texts.append(text)
                    out.append([{"first_word": s, "end_word": e, "other": o} for s, e, o in _merge(sorted((r["place"], r["place"] + r["count"] + min_words - 1, r["least"]) for r in held))])
            span = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("other", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.string()), pa.array(out, span)], names=["doc_id", "text", "spans"])

    return arrow(_beside(text, found, ["place", "count", "hash", "least"]), spans, "doc_id long, text string, spans array<struct<first_word:int,end_word:int,other:bigint>>")


def _merge(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Joins spans, sorted, that overlap or touch; the document with the longest part, of overlapping spans, is named."""
    out: list[tuple[int, int, int]] = []
    parts: dict[int, tuple[int, int]] = {}
    most = 0
    for s, e, o in found:
        if not out or s > out[-1][1]:
            out.append((s, e, o))
            parts, most = {}, 0
        begin, end = parts.get(o, (s, s))
        parts[o] = begin, end = (begin, max(end, e)) if s < end else (s, e)
        first, last, other = out[-1]
        if end - begin > most:
            other, most = o, end - begin
        out[-1] = (first, max(last, e), other)
    return out


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents of ``docs`` (doc_id, text; other columns are left alone) with passages of at least
    ``min_words`` (50 or more) words that a document of smaller doc_id also has: doc_id, text, spans
    (first_word, end_word, other).  Words are compared as they are, white space is not.

    Null, empty and short texts have none, and rows without doc_id take no part.  Rows that repeat a
    doc_id are one document: they aren't compared with each other.
    """
    if min_words < MIN_WORDS:
        raise ValueError(f"passages of fewer than {MIN_WORDS} words may have no minimiser")
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = docs.filter("doc_id is not null")
    whole = with_least(sampled_segments(docs, min_words), "segments")
    own = whole.filter("doc = least")
    shared = materialize(own.groupBy("gram").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).filter("_a < _b").select("gram"), "grams")
    parts = materialize(likely(own, ["gram"], shared, shared.count()).join(shared, "gram", "left_semi"), "parts")
    single = with_least(opened(text, parts, min_words), "windows")
    columns = ["doc", "place", "count", "hash", "least"]
    found = whole.filter("doc > least").select(*columns).union(single.filter("doc > least").withColumn("count", F.lit(1)).select(*columns))
    out = materialize(_spans(text, found, min_words).dropDuplicates(), "spans")
    for done in (whole, shared, parts, single):
        forget(done)
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a passage: doc_id, other_doc_id, first_word, n_words."""
    one = repeats(docs, min_words).select("doc_id", F.explode("spans").alias("s"))
    return one.select("doc_id", F.col("s.other").alias("other_doc_id"), F.col("s.first_word").cast("long").alias("first_word"), (F.col("s.end_word") - F.col("s.first_word")).cast("long").alias("n_words"))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans, and the white space after them."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    begins = np.append(np.flatnonzero(~space & np.concatenate([[True], space[:-1]])), len(data))
    keep = np.ones(len(data), bool)
    for s, e in spans:
        keep[begins[s] : begins[e]] = False
    return data[keep].tobytes().decode("utf-8", "surrogatepass")


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the passages that ``repeats`` finds, with its columns; n_chars, if there, is set
    anew.  Documents that have no word left are dropped; ones that had none to begin with stay."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            left = [without_spans(t, [(s["first_word"], s["end_word"]) for s in spans]) for t, spans in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hash_of(t) for t in texts], pa.string()), pa.array([t if t.split() else None for t in left], pa.string())], names=["_id", "_print", "_left"])

    def hash_of(text: str) -> str:
        import hashlib

        return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()

    found = repeats(docs, min_words)
    new = materialize(arrow(found.select("doc_id", "text", "spans"), cut, "_id long, _print string, _left string"), "cut")
    forget(found)
    # columns may have any names, so they go in one
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    some, rest = parted(rows, ["_id"], new, new.count())
    some = some.withColumn("_print", F.md5(F.col("_text").cast("binary"))).join(new.withColumn("_new", F.lit(True)), ["_id", "_print"], "left").filter("_new is null or _left is not null")
    own = {c: F.col("row").getField(c) for c in docs.columns}
    one = {"text": F.coalesce("_left", own["text"])} | ({"n_chars": F.when(F.col("_left").isNotNull(), F.length("_left").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])} if "n_chars" in docs.columns else {})
    return some.select(*((one.get(c, own[c])).alias(c) for c in docs.columns)).union(rest.select(*(own[c].alias(c) for c in docs.columns)))
