"""Near-duplicate vectors by NN-descent.

1. Equal vectors are one class, its smallest id standing for them.  Vectors of different lengths don't link;
   each length is searched by itself.
2. Short lists of nearest neighbours begin with what random hyperplanes put into one bucket.  Lists are made
   from sketches, the sides of ``SKETCH`` further hyperplanes, whose differences tell the angle closely enough.
3. NN-descent: the neighbours of a vector, and those that have it as theirs, are compared with each
   other, and lists keep the nearest.  Rounds go on until hardly any new neighbour turns up.
4. The entries of lists are verified on the vectors in double precision; links give components.
5. A list that is full of links is saturated: there may be more.  It is enlarged to its whole component, in
   blocks, which completes the links within components, and to other components with saturated lists that
   share a bucket with it and don't lie too far apart, as two vectors of them may both have missed the other.
6. Recall is audited by comparing the vectors with ids divisible by ``EVERY`` with all, in blocks: the mean share
   of a vector's links that was found, over all audited vectors and over those with few links.  If it
   falls short, more hyperplanes are added; at last all blocks of different components are compared, but
   for those that lie too far apart for a link, so what buckets and lists have missed is found all the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow, fresh_path, hot_limit, join_hot, materialize, prepare, sorted_groups, split_hot
from millrace.llm.graph import connected_components

THRESHOLD = 0.9
#: Bits of a sketch; entries of a list are those whose sketches differ by so many standard errors more than those
#: of two vectors at the threshold would, at most.
SKETCH, ERRORS = 256, 4.5
#: Entries of a list, tables of hyperplanes, vectors that a bucket is to have, and rounds at most.
LIST, TABLES, BUCKET, ROUNDS = 16, 12, 256, 4
#: Vectors that are compared with each other in one block, at most about.
BLOCK = 512
#: The audit's queries (ids divisible by it), the recall asked for, and how often hyperplanes are added.
EVERY, RECALL, TRIES = 20, 0.98, 2
#: Bytes of vectors that a task of the audit holds.
HELD = 16 << 20
#: New neighbours, as a share of all, below which rounds end.
FEW = 0.002


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _signs(column: pa.Array) -> np.ndarray:
    """Sketches as rows of 1 and -1."""
    bits = np.unpackbits(np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in column]), axis=1)
    return bits.astype(np.float32) * 2 - 1


def most_differing(threshold: float) -> int:
    """Bits in which the sketches of two vectors at the threshold differ, hardly ever more."""
    share = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return min(SKETCH, math.ceil(SKETCH * share + ERRORS * math.sqrt(SKETCH * share * (1 - share))) + 1)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, unit (float64, binary) and print of the vectors that can link; null unit for others:
    null, empty, zero, or with null or non-finite components; or without id."""
    import xxhash

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units: list[bytes | None] = []
            for ident, v in zip(batch.column(0), batch.column(1), strict=True):
                out = None
                if ident.is_valid and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    with np.errstate(all="ignore"):
                        most = np.abs(x).max()
                        if np.isfinite(most) and most > 0 and np.isfinite(x).all():
                            x = x / most
                            out = (x / np.sqrt((x * x).sum()) + 0.0).tobytes()
                units.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary()), pa.array([u and xxhash.xxh3_128_digest(u) for u in units], pa.binary())], names=["vec_id", "unit", "print"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return arrow(rows, unit, "vec_id long, unit binary, print binary")


def sketched(units: DataFrame, n: int, dim: int, seed: int, tables: int) -> DataFrame:
    """id, sketch, and keys: a bucket for each table of hyperplanes.  Sketches don't depend on the seed."""
    bits = max(1, math.ceil(math.log2(max(n, 2) / BUCKET)))
    sides = np.random.default_rng(0).normal(size=(dim, SKETCH))
    planes = np.random.default_rng(seed).normal(size=(dim, tables * bits))
    weights = (1 << np.arange(bits, dtype=np.int64))[None, None]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                side = (x @ planes > 0).reshape(batch.num_rows, tables, bits)
                k = ((side * weights).sum(axis=2) * tables + np.arange(tables)[None]) * 1000 + seed
                sketch = [r.tobytes() for r in np.packbits(x @ sides > 0, axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketch, pa.binary()), pa.array(list(k), pa.list_(pa.int64()))], names=["id", "sketch", "keys"])

    return arrow(units.select("id", "unit"), keys, "id long, sketch binary, keys array<long>")


def _nearest(rows: DataFrame, keys: list[str], most: int, size: int) -> DataFrame:
    """Compares the sketches (id, sketch) of each group with each other: for each, the ``size`` nearest of
    its group (u, v, h) that differ in ``most`` bits at most."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [[], [], []], 0
        for group in sorted_groups(batches, len(keys)):
            ids, x = group.column(len(keys)).to_numpy(), _signs(group.column(len(keys) + 1))
            for a in range(0, len(ids), BLOCK):
                h = (SKETCH - x[a : a + BLOCK] @ x.T) / 2
                h[ids[a : a + BLOCK, None] == ids[None]] = SKETCH + 1
                if len(ids) > size:
                    h[h > np.partition(h, size - 1, axis=1)[:, size - 1, None]] = SKETCH + 1
                i, j = np.nonzero(h <= most)
                for k, v in enumerate((ids[a + i], ids[j], h[i, j].astype(np.int32))):
                    out[k].append(v)
                held += len(i)
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["u", "v", "h"])
                out, held = [[], [], []], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["u", "v", "h"])

    return arrow(rows.select(*keys, "id", "sketch").repartition(*keys).sortWithinPartitions(*keys), compare, "u long, v long, h int")


def _split(rows: DataFrame, key: str, salt: int) -> DataFrame:
    """Adds _part: groups of more than BLOCK rows are dealt out to parts of about that size, by other
    hyperplanes first (the sketch's bits, other ones for each salt), so near vectors stay together, and then by chance."""
    large = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK)
    few = join_hot(rows, large, [key], hot_limit(rows.count()), "left")
    at = (salt * 7) % (SKETCH // 8 - 2) + 1
    bits = F.ceil(F.log2(F.col("_n") / BLOCK)).cast("int")
    plane = F.conv(F.hex(F.substring("sketch", at, 2)), 16, 10).cast("long") % F.pow(F.lit(2), F.least(bits, F.lit(16))).cast("long")
    size = F.ceil(F.col("_n") / BLOCK).cast("long")
    return few.withColumn("_part", F.when(F.col("_n").isNull(), F.lit(0).cast("long")).otherwise(plane * 1_000_000 + F.pmod(F.xxhash64("id", F.lit(salt)), F.greatest(F.lit(1).cast("long"), (size / 65536).cast("long"))))).drop("_n")


def _lists(entries: DataFrame, size: int) -> DataFrame:
    best = Window.partitionBy("u").orderBy("h", F.xxhash64("u", "v"))  # ties by chance: no vector is everyone's neighbour
    return entries.groupBy("u", "v").agg(F.min("h").alias("h")).withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= size).drop("_k")


def _descend(lists: DataFrame, sketches: DataFrame, salt: int, most: int) -> DataFrame:
    """A round: neighbours of each vector, either way, are compared with each other."""
    around = lists.select("u", F.col("v").alias("id")).union(lists.select(F.col("v").alias("u"), F.col("u").alias("id"))).distinct()
    members = materialize(around.join(sketches.select("id", "sketch"), "id"), "around")
    return _lists(lists.union(_nearest(_split(members, "u", salt), ["u", "_part"], most, LIST)), LIST)


def _verified(lists: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u < v) of lists whose cosine reaches the threshold.  A vector goes once to each slot of
    its pairs, and its neighbours stream past it."""
    pairs = lists.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = materialize(pairs, "pairs")
    pairs = split_hot(pairs, ["u"], ["v"], hot_limit(pairs.count()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, base = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            us, vs = [], []
            x = _matrix(batch.column(3))
            for i, (u, slot, v) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if v is None:
                    of, base = (u, slot), x[i]
                elif of == (u, slot) and x[i] @ base >= threshold:
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    vectors = units.select("id", "unit")
    first = pairs.select("u", "_slot").distinct().join(vectors.withColumnRenamed("id", "u"), "u").select("u", "_slot", F.lit(None).cast("long").alias("v"), "unit")
    rest = pairs.join(vectors.withColumnRenamed("id", "v"), "v").select("u", "_slot", "v", "unit")
    rows = first.union(rest).repartition("u", "_slot").sortWithinPartitions("u", "_slot", F.col("v").asc_nulls_first())
    return arrow(rows, compare, "u long, v long")


def _blocked(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Deals the rows of each group out to blocks and gives each pair of blocks its rows: adds _i, _j and _own.
    Blocks grow with the square root of a group, so that rows are repeated that often only."""
    wide = F.least(F.lit(1 << 15), F.greatest(F.lit(BLOCK), (16 * F.sqrt(size)).cast("long")))
    blocks = F.ceil(F.col(size) / wide).cast("int")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))


def _within_components(units: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """Links of each vector with others of its component: (id, links), where copies count each."""
    sizes = components.groupBy("component").agg(F.count("*").alias("_m"))
    sized = join_hot(components, sizes, ["component"], hot_limit(components.count()))
    rows = _blocked(units.join(sized, "id"), ["component"], "_m").select("component", "_i", "_j", "id", "unit", "copies", "_own")
    keys = ["component", "_i", "_j"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, links, held = [], [], 0
        for group in sorted_groups(batches, 3):
            i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            who, x, copies, own = group.column(3).to_numpy(), _matrix(group.column(4)), group.column(5).to_numpy(), group.column(6).to_numpy()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            n = np.zeros(len(who), np.int64)
            for a in range(0, len(left), BLOCK):
                some = left[a : a + BLOCK]
                near = x[some] @ x[right].T >= threshold
                near &= who[some, None] != who[None, right]
                n[some] += near @ copies[right]
                if i != j:
                    n[right] += copies[some] @ near
            ids.append(who)
            links.append(n)
            held += len(who)
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links))], names=["id", "links"])
                ids, links, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links))], names=["id", "links"])

    counted = arrow(rows.repartition(*keys).sortWithinPartitions(*keys), count, "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def _balls(members: DataFrame, dim: int) -> DataFrame:
    """component, centre (float64, binary) and wide: the largest angle between the centre and a member."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                known, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                total = np.zeros((len(known), dim))
                np.add.at(total, at, _matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(known), pa.array([t.tobytes() for t in total], pa.binary())], names=["component", "unit"])

    def centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = None, np.zeros(dim)

        def centre() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([(total / (np.sqrt((total * total).sum()) or 1.0)).tobytes()], pa.binary())], names=["component", "centre"])

        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if c != of:
                    if of is not None:
                        yield centre()
                    of, total = c, np.zeros(dim)
                total = total + np.frombuffer(x.as_buffer(), np.float64)
        if of is not None:
            yield centre()

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = (_matrix(batch.column(1)) * _matrix(batch.column(2))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=["component", "angle"])

    parts = arrow(members.select("component", "unit"), sums, "component long, unit binary")
    found = materialize(arrow(parts.repartition("component").sortWithinPartitions("component"), centres, "component long, centre binary"), "centres")
    both = join_hot(members.select("component", "unit"), found, ["component"], hot_limit(members.count())).select("component", "unit", "centre")
    wide = arrow(both, angles, "component long, angle double").groupBy("component").agg(F.max("angle").alias("wide"))
    return found.join(wide, "component")


def _between_saturated(units: DataFrame, sketches: DataFrame, lists: DataFrame, links: DataFrame, components: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Links (u, v) between components, one at least for each two that have any, of vectors whose lists
    are full of links.  Two components are compared if such vectors share a bucket, and if their balls
    don't lie too far apart."""
    both = links.union(links.select("v", "u"))
    full = lists.join(both.distinct(), ["u", "v"], "left_semi").groupBy(F.col("u").alias("id")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= LIST).select("id")
    full = materialize(full.join(components, "id"), "saturated")
    members = materialize(units.select("id", "unit").join(full, "id"), "saturated")
    balls = materialize(_balls(members, dim), "balls")
    shared = full.join(sketches.select("id", "keys"), "id").select("component", F.explode("keys").alias("key")).distinct()
    several = shared.groupBy("key").agg(F.count("*").alias("_m")).filter("_m > 1")
    rows = materialize(join_hot(shared, several, ["key"], hot_limit(shared.count())).join(balls, "component").withColumnRenamed("component", "id"), "shared")
    reach = math.acos(min(1.0, threshold)) + 1e-6

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            who, x, wide, own = group.column(3).to_numpy(), _matrix(group.column(4)), group.column(5).to_numpy(), group.column(6).to_numpy()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            for a in range(0, len(left), BLOCK):
                some = left[a : a + BLOCK]
                angle = np.arccos(np.clip(x[some] @ x[right].T, -1, 1))
                u, v = np.nonzero(angle <= wide[some, None] + wide[None, right] + reach)
                u, v = who[some[u]], who[right[v]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)[u != v]), pa.array(np.maximum(u, v)[u != v])], names=["a", "b"])

    keys = ["key", "_i", "_j"]
    blocks = _blocked(rows, ["key"], "_m").select(*keys, "id", "centre", "wide", "_own").repartition(*keys).sortWithinPartitions(*keys)
    pairs = materialize(arrow(blocks, near, "a long, b long").distinct(), "balls")
    sizes = full.groupBy("component").agg(F.count("*").alias("_n"))
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col("component").alias(side), F.col("_n").alias(f"_n{side}")), side)
    part = lambda side: F.ceil(F.col(f"_n{side}") / (4 * BLOCK)).cast("int")
    pairs = pairs.withColumn("_ka", part("a")).withColumn("_kb", part("b"))

    dealt = split_hot(members, ["component"], ["id"], hot_limit(full.count()))
    slots = dealt.select("component", "_slot").distinct()

    def side(one: str, other: str) -> DataFrame:
        mine = pairs.select(F.col(one).alias("component"), "a", "b", "_ka", "_kb").join(slots, "component")
        rows = mine.join(dealt, ["component", "_slot"])
        own = F.pmod(F.xxhash64("id"), F.col(f"_k{one}")).cast("int").alias(f"_{one}")
        every = F.explode(F.sequence(F.lit(0), F.col(f"_k{other}") - 1)).alias(f"_{other}")
        return rows.select("a", "b", own, every, F.lit(one == "a").alias("_left"), "id", "unit").select("a", "b", "_a", "_b", "_left", "id", "unit")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 4):
            left = group.column(4).to_numpy(zero_copy_only=False)
            who, x = group.column(5).to_numpy(), _matrix(group.column(6))
            i, j = np.flatnonzero(left), np.flatnonzero(~left)
            for a in range(0, len(i), BLOCK):
                u, v = np.nonzero(x[i[a : a + BLOCK]] @ x[j].T >= threshold)
                if len(u):  # one tells that the components are one
                    yield pa.RecordBatch.from_arrays([pa.array([who[i[a + u[0]]]]), pa.array([who[j[v[0]]]])], names=["u", "v"])
                    break

    keys = ["a", "b", "_a", "_b"]
    return arrow(side("a", "b").union(side("b", "a")).repartition(*keys).sortWithinPartitions(*keys), compare, "u long, v long")


def _across_components(units: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) between the components of vectors of different ones, one for each two components
    and blocks.  Compares all vectors but those of blocks whose centres lie too far apart for a link: the
    way for tables on which the audit isn't content with what was found."""
    reach = math.acos(min(1.0, threshold)) + 1e-6

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            x, component = _matrix(rows.column(2)), rows.column(0).to_numpy()
            centre = x.mean(axis=0)
            centre /= np.sqrt((centre * centre).sum()) or 1.0
            wide = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
            values = ([int(component[0])], [int(rows.column(1)[0].as_py())], [component.tobytes()], [x.tobytes()], [centre.tolist()], [wide])
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["component", "id", "components", "units", "centre", "wide"])

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                if held and sum(b.num_rows for b in held) + part.num_rows > BLOCK:
                    yield block()
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield block()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ca, cb = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in (0, 2))
                xa, xb = (np.frombuffer(batch.column(c)[k].as_buffer(), np.float64) for c in (1, 3))
                i, j = np.nonzero(xa.reshape(len(ca), -1) @ xb.reshape(len(cb), -1).T >= threshold)
                other = ca[i] != cb[j]
                if other.any():
                    pairs = np.unique(np.stack([ca[i[other]], cb[j[other]]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    rows = units.join(components, "id", "left").select(F.coalesce("component", "id").alias("component"), "id", "unit")
    rows = materialize(rows, "members")  # a sort by range reads its input twice
    blocks = arrow(rows.repartitionByRange("component", "id").sortWithinPartitions("component", "id"), pack, "component long, id long, components binary, units binary, centre array<double>, wide double")
    blocks = materialize(blocks, "blocks")
    a, b = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in blocks.columns)) for side in "ab")
    cosine = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    near = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) <= F.col("a_wide") + F.col("b_wide") + reach
    pairs = a.repartition(24, "a_id").join(b, (F.col("a_id") <= F.col("b_id")) & near)
    return arrow(pairs.select("a_components", "a_units", "b_components", "b_units"), compare, "u long, v long")


def audit(units: DataFrame, found: DataFrame, threshold: float, every: int = EVERY) -> float:
    """The mean share of its links that ``found`` (id, links) has of a vector, over those with ids divisible by
    ``every`` that have links, or over those of them with up to ``LIST`` links if that is less; 1 if none has.

    They are compared with all vectors in blocks: a task holds ``HELD`` bytes of vectors at a time, and
    the queries, a table in the shared folder, stream past them.
    """
    path = fresh_path(units.sparkSession, "queries")
    units.filter(F.col("id") % every == 0).select("id", "unit").write.parquet(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        store, root = fs.FileSystem.from_uri(path)
        queries = dataset.dataset(root, filesystem=store, format="parquet")

        def past(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.concat_batches(held)
            ids, x, copies = rows.column(0).to_numpy(), _matrix(rows.column(1)), rows.column(2).to_numpy()
            for some in queries.to_batches(batch_size=BLOCK):
                if some.num_rows:
                    q = some.column("id").to_numpy()
                    near = (_matrix(some.column("unit")) @ x.T >= threshold) & (q[:, None] != ids[None])
                    n = near @ copies
                    yield pa.RecordBatch.from_arrays([pa.array(q[n > 0]), pa.array(n[n > 0])], names=["id", "true"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD:
                yield from past(held)
                held, size = [], 0
        if size:
            yield from past(held)

    true = arrow(units.select("id", "unit", "copies"), count, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    share = F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("true"))
    both = true.join(found, "id", "left").agg(F.avg(share).alias("every"), F.avg(F.when(F.col("true") <= LIST, share)).alias("few")).first()
    return min(1.0 if x is None else x for x in both)


def search(units: DataFrame, n: int, dim: int, threshold: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """components (id, component) and found (id, links) of ``n`` distinct vectors (id, unit, copies) of one length."""
    most, lists, links, tables = most_differing(threshold), None, None, TABLES
    for attempt in range(TRIES + 1):
        sketches = materialize(sketched(units, n, dim, seed + attempt, tables), "sketches")
        keyed = sketches.select("id", "sketch", F.explode("keys").alias("key"))
        new = _lists(_nearest(_split(keyed, "key", seed + attempt), ["key", "_part"], most, LIST), LIST)
        lists = materialize(new if lists is None else _lists(lists.union(new), LIST), "lists")
        known = lists.count()
        for k in range(ROUNDS if known else 0):
            lists = materialize(_descend(lists, sketches, 100 * attempt + k, most), "lists")
            was, known = known, lists.count()
            if known <= was * (1 + FEW):
                break
        links = _verified(lists, units, threshold).union(links) if links is not None else _verified(lists, units, threshold)
        links = materialize(links.distinct(), "links")
        components = materialize(connected_components(links), "components")
        joined = materialize(_between_saturated(units, sketches, lists, links, components, dim, threshold), "joined")
        if not joined.isEmpty():
            links = materialize(links.union(joined).distinct(), "links")
            components = materialize(connected_components(links), "components")
        found = materialize(_within_components(units, components, threshold), "links")
        if audit(units, found, threshold) >= RECALL:
            return components, found
        tables *= 2
    joined = materialize(_across_components(units, components, threshold), "joined")
    if not joined.isEmpty():
        components = materialize(connected_components(links.union(joined)), "components")
        found = materialize(_within_components(units, components, threshold), "links")
    return components, found


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = 1) -> DataFrame:
    """A row for each row of ``vectors`` (vec_id, embedding; other columns are left alone): vec_id,
    n_links (other rows whose cosine, in double precision, is at least ``threshold``), component_id
    (smallest vec_id that links reach, itself included) and kept (vec_id = component_id).

    Vectors that are null, empty, zero, or have null or non-finite components link with nothing, and ones
    of different lengths don't link; rows without vec_id neither, whose component_id is null and which are
    kept.  Rows that repeat a vec_id count each, but share their component.  Links found are
    links; an audit says whether enough are found (see the module).  An empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    rows = materialize(unit_vectors(vectors), "units")
    valid = rows.filter("unit is not null")
    units = valid.groupBy("print").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.any_value("unit").alias("unit"))
    units = materialize(units, "classes")
    # two classes may share a repeated vec_id; the nodes of the search are classes
    clash = units.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1")
    clashes = not clash.isEmpty()
    if clashes:
        units = materialize(units.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("print"))).withColumn("name", F.col("id")).withColumn("id", F.when(F.col("_k") == 1, F.col("id")).otherwise(F.xxhash64("print"))).drop("_k"), "classes")
    else:
        units = units.withColumn("name", F.col("id"))
    lengths = units.groupBy((F.octet_length("unit") / 8).cast("int").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").collect()  # a row a length
    spark = vectors.sparkSession
    components, found = spark.createDataFrame([], "id long, component long"), spark.createDataFrame([], "id long, links long")
    for r in lengths:
        c, f = search(units.filter(F.octet_length("unit") == 8 * r.dim), r.n, r.dim, threshold, seed)
        components, found = components.union(c), found.union(f)
    per_class = units.join(components, "id", "left").join(found, "id", "left").select("print", "id", "name", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_class = materialize(per_class, "classes")
    # components of vec_ids: copies and links, and rows that repeat an id
    least = per_class.groupBy("component").agg(F.min("name").alias("_least"))
    per_class = join_hot(per_class, least, ["component"], hot_limit(per_class.count()))
    out = join_hot(rows, per_class.select("print", "n_links", "_least"), ["print"], hot_limit(rows.count()), "left")
    if not clashes:
        named = out.withColumn("component_id", F.coalesce("_least", "vec_id"))
    else:
        ties = out.filter("vec_id is not null").select("vec_id", F.coalesce("_least", "vec_id").alias("_c"))
        labels = materialize(connected_components(ties).select(F.col("id").alias("vec_id"), F.col("component").alias("_all")), "ids")
        named = join_hot(out, labels, ["vec_id"], hot_limit(rows.count()), "left").withColumn("component_id", F.coalesce("_all", "_least", "vec_id"))
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
