"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct shingles of ``shingle`` words (A-Z lower-cased); one with fewer
words has its whole sequence as one shingle; one without words, or without text, has none and is
linked with nothing.  Two permutations of the hashes make all coordinates of a signature: the first
scatters the shingles, the second is shifted circularly by k for coordinate k.

1. Documents with equal sets are one class; its smallest doc_id stands for it.
2. Signatures are cut into bands; classes with equal bands meet in a bucket.  The number of bands
   follows from the threshold, so that a pair at the threshold misses all of them with a chance of
   ``MISS`` at most.
3. In each bucket, the smallest id is compared with the others, on full sets.  What links is one
   component from then on.  Where members of other components remain, these are compared with all, by
   how they differ from the smallest, which gives the exact intersection.  So no pair within a bucket
   goes undecided, and thousands of copies need about one comparison each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow, hashed_words, hot_limit, join_hot, likely, materialize, mix64, prepare, sorted_groups, split_hot
from millrace.llm.graph import connected_components

SHINGLE = 5
THRESHOLD = 0.8
ROWS = 5
MISS = 1e-7
#: Members of a bucket that stand in one block of comparisons, about, and bytes of their differences.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Pairs of entries that ``_overlaps`` holds at a time.
PAIRS = 1 << 20
_CHUNK = 1 << 15


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingle_sets(texts: pa.Array | list[str | None], shingle: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text."""
    lengths, every = hashed_words(texts)
    h = every.copy()
    for j in range(1, shingle):
        h[: len(h) - j] = mix64(h[: len(h) - j]) + every[j:] * np.uint64(0x9E3779B97F4A7C15)
    h = mix64(h)
    out, at = [], 0
    for n in lengths.tolist():
        if n >= shingle:
            out.append(np.unique(h[at : at + n - shingle + 1]))
        elif n:
            x = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in every[at : at + n]:
                    x = mix64(np.array([x ^ w]))[0] * np.uint64(3)
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def circulant_signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures (sets x size, uint32) of sets that are not empty."""
    out = np.empty((len(sets), size), np.uint32)
    done = 0
    while done < len(sets):
        upto, n = done, 0
        while upto < len(sets) and (upto == done or n + len(sets[upto]) <= _CHUNK):
            n += len(sets[upto])
            upto += 1
        some = sets[done:upto]
        first = (np.concatenate(some) >> np.uint64(32)).astype(np.uint32)  # set hashes are well mixed: the first permutation
        starts = np.concatenate([[0], np.cumsum([len(s) for s in some])[:-1]])
        y, z = np.empty_like(first), np.empty_like(first)
        for k in range(size):
            np.add(first, np.uint32(k), out=y)  # wraps around: the circular shift
            np.right_shift(y, np.uint32(16), out=z)  # the second permutation, a public 32-bit finaliser
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0x85EBCA6B), out=y)
            np.right_shift(y, np.uint32(13), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0xC2B2AE35), out=y)
            np.right_shift(y, np.uint32(16), out=z)
            np.bitwise_xor(y, z, out=y)
            out[done:upto, k] = np.minimum.reduceat(y, starts)
        done = upto
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys (documents x bands)."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    import xxhash

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2), shingle)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys: list = [None] * len(sets)
            if len(full):
                for i, k in zip(full.tolist(), band_keys(circulant_signatures([sets[i] for i in full], bands * rows), bands, rows), strict=True):
                    keys[i] = k
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "print", "keys"])

    return arrow(docs, sign, "doc_id long, text_hash long, n_shingles long, print binary, keys array<long>")


def _spokes(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Compares pairs of texts (a, a_hash, b, b_hash, many) on the full sets: linked, sizes, and, if
    ``many``, in what they differ.

    linked: 100 * intersection >= percent * union; missing: shingles of a that b lacks; differ: hashes of
    the shingles that one of the two has (uint64, binary).

    The pairs of an ``a`` that has very many are dealt out to slots.  ``a``'s text goes to each of its
    slots once and the others stream past it.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: tuple | None = None
        bases: list[np.ndarray] = []  # texts of the current a; several if hashes of texts collide
        for batch in batches:
            sets = shingle_sets(batch.column(6), shingle)
            out: list[list] = [[] for _ in range(9)]
            for *pair, slot, b, b_hash, many, x in zip(*(batch.column(k).to_pylist() for k in range(6)), sets, strict=True):
                if b_hash is None:
                    if of != (*pair, slot):
                        of, bases = (*pair, slot), []
                    if not any(np.array_equal(x, y) for y in bases):
                        bases.append(x)
                    continue
                for base in bases:
                    both = np.sort(np.concatenate([base, x]))
                    twice = both[1:] == both[:-1]
                    same = int(np.count_nonzero(twice))
                    single = ~(np.append(twice, False) | np.insert(twice, 0, False))
                    linked = same > 0 and 100 * same >= percent * (len(base) + len(x) - same)
                    row = (*pair, b, b_hash, linked, len(base), len(x), len(base) - same, both[single].tobytes() if many else None)
                    for c, value in zip(out, row, strict=True):
                        c.append(value)
            kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["a", "a_hash", "b", "b_hash", "linked", "n_a", "n_b", "missing", "differ"])

    keys = ["a", "a_hash", "_slot"]
    n = pairs.count()
    pairs = materialize(split_hot(pairs, ["a", "a_hash"], ["b", "b_hash"], hot_limit(n)), "pairs")
    text = ["doc_id", "text_hash"]
    first = pairs.select(*keys).distinct().select(*keys, F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("b_hash"), F.lit(None).cast("boolean").alias("many"), F.col("a").alias("doc_id"), F.col("a_hash").alias("text_hash"))
    sides = first.union(pairs.select(*keys, "b", "b_hash", "many", "b", "b_hash"))
    wide = sides.join(likely(docs, text, sides, 2 * n), text).select(*keys, "b", "b_hash", "many", "text")
    wide = wide.repartition(*keys).sortWithinPartitions(*keys, F.col("b_hash").isNotNull(), "b", "b_hash")
    return arrow(wide, compare, "a long, a_hash long, b long, b_hash long, linked boolean, n_a long, n_b long, missing long, differ binary")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    tokens, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    n_left = sum(map(len, left))
    a, b = at[:n_left], at[n_left:]
    who_a, who_b = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    in_a, in_b = (np.bincount(x, minlength=len(tokens)) for x in (a, b))
    shared = (in_a > 0) & (in_b > 0)
    common = shared & (in_a * in_b > 256)
    # what many have: a product of 0/1 matrices
    column = np.cumsum(common) - 1
    for lo in range(0, int(common.sum()), 2048):
        planes = []
        for t, who, n in ((a, who_a, len(left)), (b, who_b, len(right))):
            pick = common[t] & (column[t] >= lo) & (column[t] < lo + 2048)
            m = np.zeros((n, 2048), np.float32)
            m[who[pick], column[t[pick]] - lo] = 1
            planes.append(m)
        out += np.rint(planes[0] @ planes[1].T).astype(np.int64)
    # what few have: one by one
    rare = shared & ~common
    pick_a, pick_b = rare[a], rare[b]
    order = np.argsort(b[pick_b], kind="stable")
    sorted_b, rows_b = b[pick_b][order], who_b[pick_b][order]
    rows_a, tokens_a = who_a[pick_a], a[pick_a]
    lo = np.searchsorted(sorted_b, tokens_a, "left")
    n = np.searchsorted(sorted_b, tokens_a, "right") - lo
    done = np.cumsum(n)
    at = 0
    while at < len(n):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
        m = n[at:upto]
        place = np.repeat(lo[at:upto] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        out += np.bincount(np.repeat(rows_a[at:upto], m) * len(right) + rows_b[place], minlength=out.size).reshape(out.shape)
        at = upto
    return out


def _rest(spokes: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that are in different components so far: (a, b).

    Members are known by how they differ from their bucket's smallest: for x = c - M + N, the
    intersection of two is |c| - |M1| - |M2| + |M1 & M2| + |N1 & N2|, exactly.  Members outside the
    largest component are compared with all, in blocks; no pair becomes a row but links, one for each
    member and component.
    """
    labels = connected_components(spokes.filter("linked").select("a", "b"))
    members = spokes.filter("differ is not null").join(labels.withColumnRenamed("id", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    node = ["a", "a_hash"]
    sizes = members.groupBy(*node, "component").agg(F.count("*").alias("n"), F.sum(F.octet_length("differ")).alias("_bytes"))
    groups = sizes.groupBy(*node).agg(F.sum("n").alias("_all"), F.max(F.struct("n", "component", "_bytes")).alias("_top"), F.count("*").alias("_k"), F.sum("_bytes").alias("_all_bytes")).filter("_k > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    groups = groups.select(*node, F.col("_top.component").alias("_major"), blocks(F.col("_all"), F.col("_all_bytes")).alias("_nj"), blocks(F.col("_all") - F.col("_top.n"), F.col("_all_bytes") - F.col("_top._bytes")).alias("_ni"))
    rows = materialize(join_hot(members, groups, node, hot_limit(spokes.count())), "open")
    cols = [*node, "_i", "_j", "_left", "b", "component", "n_a", "n_b", "missing", "differ"]
    own = lambda n, salt: F.pmod(F.xxhash64("b", "b_hash", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.filter("component <> _major").withColumn("_i", own(F.col("_ni"), 1)).withColumn("_j", every("_nj")).withColumn("_left", F.lit(True)).select(*cols)
    right = rows.withColumn("_j", own(F.col("_nj"), 2)).withColumn("_i", every("_ni")).withColumn("_left", F.lit(False)).select(*cols)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 4):
            side = group.column(4).to_numpy(zero_copy_only=False)
            ids, component, n_a, n_b, missing = (group.column(k).to_numpy() for k in range(5, 10))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(10)]
            i, j = np.flatnonzero(side), np.flatnonzero(~side)
            if not len(i) or not len(j):
                continue
            same = n_a[i][:, None] - missing[i][:, None] - missing[j][None] + _overlaps([sets[k] for k in i], [sets[k] for k in j])
            good = (100 * same >= percent * (n_b[i][:, None] + n_b[j][None] - same)) & (same > 0) & (component[i][:, None] != component[j][None])
            x, y = np.nonzero(good)
            _, one = np.unique(np.stack([i[x], component[j[y]]]), axis=1, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[x[one]]]), pa.array(ids[j[y[one]]])], names=["a", "b"])

    keys = [*node, "_i", "_j"]
    return arrow(left.union(right).repartition(*keys).sortWithinPartitions(*keys), compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, rows: int = ROWS) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text; other columns are left alone).

    Returns a row for each row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id that
    links reach, itself included) and kept (doc_id = component_id).  Rows that repeat a doc_id are
    one document with several texts; each gets its own n_shingles.  A row without doc_id has no name
    to be linked by: its component_id is null and it is kept.  An empty table gives no rows.
    ``threshold`` counts in whole percents.
    """
    prepare(docs.sparkSession)
    percent, bands = round(threshold * 100), bands_for(threshold, rows)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = materialize(_signed(docs, shingle, bands, rows), "signatures")
    limit = hot_limit(signed.count())
    named = signed.filter(F.col("doc_id").isNotNull() & F.col("print").isNotNull())
    classes = materialize(named.groupBy("print").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "keys")).alias("_first"), F.count("*").alias("_n")), "classes")
    copies = join_hot(named.select("print", "doc_id"), classes.filter("_n > 1").select("print", F.col("_first.doc_id").alias("id")), ["print"], limit).filter("doc_id <> id").select("doc_id", "id")
    banded = classes.select(F.struct(F.col("_first.doc_id").alias("id"), F.col("_first.text_hash").alias("hash"), F.col("_first.n_shingles").alias("n")).alias("node"), F.explode("_first.keys").alias("key"))
    # most keys stand alone: only those that repeat carry their nodes along
    repeated = materialize(banded.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key"), "repeated")
    banded = materialize(likely(banded, ["key"], repeated, repeated.count()), "banded")
    buckets = materialize(banded.groupBy("key").agg(F.min("node").alias("_low"), F.count("*").alias("_n")).filter("_n > 1"), "buckets")
    # members of a bucket with its smallest; the sizes alone rule some pairs out, but a pair still matters
    # where others stand in the bucket, which it may link with
    limit = hot_limit(banded.count())
    members = join_hot(banded, buckets, ["key"], limit, hot=buckets.filter(F.col("_n") > limit).select("key")).filter("node <> _low")
    fits = (F.lit(percent) * F.col("node.n") <= F.lit(100) * F.col("_low.n")) & (F.lit(percent) * F.col("_low.n") <= F.lit(100) * F.col("node.n"))
    pairs = members.groupBy(F.col("_low.id").alias("a"), F.col("_low.hash").alias("a_hash"), F.col("node.id").alias("b"), F.col("node.hash").alias("b_hash")).agg(F.max(fits).alias("_fits"), F.max(F.col("_n") > 2).alias("many"))
    pairs = materialize(pairs.filter(F.col("_fits") | F.col("many")).drop("_fits"), "members")
    spokes = materialize(_spokes(pairs, docs, shingle, percent), "spokes")
    links = spokes.filter("linked").select("a", "b").union(_rest(spokes, percent))
    labels = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(copies.select(F.col("id"), F.col("doc_id"))))
    out = signed.select("doc_id", "n_shingles").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))

