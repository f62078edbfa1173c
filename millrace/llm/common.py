"""What the operators of this subpackage share: tables, intermediate tables and words."""

from __future__ import annotations

import ctypes
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch at most.  Texts can be long, and are held several times over while
#: they are worked on, so batches are kept short; a single text longer than that is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: A key is hot that has more than this share of a table's rows, and more than so many.
HOT_SHARE, HOT_ROWS = 1 / 200, 400
#: Bits of ``likely``'s bitmap: so many a key, and so many at most (16 MB).
KEY_BITS, MOST_BITS = 32, 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _send_package(spark: SparkSession, root: str) -> None:
    """Puts this package into the shared folder, as a zip named by its content, for workers to fetch."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for folder, _, names in sorted(os.walk(f"{root}/millrace")):
            for n in sorted(names):
                if n.endswith(".py"):
                    with open(f"{folder}/{n}", "rb") as f:
                        z.writestr(zipfile.ZipInfo(os.path.relpath(f"{folder}/{n}", root)), f.read())
    name = f"millrace-{hashlib.sha1(raw.getvalue()).hexdigest()[:16]}.zip"
    if any(x.endswith(f"/{name}") for x in spark.sparkContext.listFiles):
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    kept = path(f"{shared_dir(spark)}/millrace/code/{name}")
    fs = kept.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(kept):
        with tempfile.NamedTemporaryFile(suffix=".zip") as f:  # read by the driver only
            f.write(raw.getvalue())
            f.flush()
            part = path(f"{kept.toString()}.{uuid.uuid4().hex}")
            fs.copyFromLocalFile(path(f"file://{f.name}"), part)
        if not fs.rename(part, kept) and not fs.exists(kept):
            raise OSError(f"can't write {kept.toString()}")
    spark.sparkContext.addPyFile(kept.toString())


def prepare(spark: SparkSession) -> None:
    """Keeps Arrow batches short unless the session asks for a size of its own, and sends this package
    to workers that wouldn't find it by themselves."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = {os.path.abspath(x) for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x} | {os.getcwd()}
    if root not in found and "site-packages" not in root:
        _send_package(spark, root)
    for key, usual, ours in (("maxRecordsPerBatch", ("10000",), BATCH_ROWS), ("maxBytesPerBatch", ("67108864", "67108864b", "64MB", "64m"), BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", usual[0]) in usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(ours))


def give_back() -> None:
    """Returns memory that is free to the system: workers live on, idle, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` by a worker that keeps no free memory when its task is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return rows.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master, where all run on one machine, may go without; it gets a folder in /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return base.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/millrace/{what}-{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of a query when it is over.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the tables that this driver has made and not removed, oldest first.
MADE: list[str] = []


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back, which cuts its lineage.

    The files outlive their executors.  ``forget`` removes them.  What was shuffled on the way is removed at
    once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of intermediate files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Removes the files of tables made by ``materialize``, once nothing will read them again."""
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        if "/millrace/" in f:
            remove(df.sparkSession, f)
            MADE[:] = [p for p in MADE if not f.endswith(p.rsplit("/", 1)[-1])]


def forget_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Removes the tables made since ``MADE`` had ``mark`` entries, but for those that ``keep`` is read from."""
    kept = {os.path.basename(os.path.dirname(x)) for x in keep.inputFiles()}
    for path in [p for p in MADE[mark:] if p.rsplit("/", 1)[-1] not in kept]:
        remove(spark, path)
        MADE.remove(path)


def hot_limit(rows: int) -> int:
    """Rows that a key may have before it counts as hot, in a table of so many rows: no table has more
    than 1 / HOT_SHARE hot keys."""
    return max(int(rows * HOT_SHARE), HOT_ROWS)


def hot_keys(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The keys of more than ``limit`` rows, with their number as _n.  Counted before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)


def join_hot(rows: DataFrame, one: DataFrame, keys: list[str], limit: int, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Inner or left join of ``rows`` with ``one``, which has a row a key: rows of hot keys stay where they are and meet
    a broadcast of ``one``'s rows of these keys, of which ``limit`` (see ``hot_limit``) allows 200 at most.  ``hot`` has
    these keys where they are known; else they are counted."""
    hot = hot_keys(rows, keys, limit).drop("_n") if hot is None else hot
    few = one.join(F.broadcast(hot), keys, "left_semi")
    cold = rows.join(F.broadcast(hot), keys, "left_anti").join(one, keys, how)
    warm = rows if how == "inner" else rows.join(F.broadcast(hot), keys, "left_semi")
    return warm.join(F.broadcast(few), keys, how).select(*cold.columns).union(cold)


def split_hot(rows: DataFrame, keys: list[str], by: list[str], limit: int) -> DataFrame:
    """Adds _slot: rows of a hot key are dealt out, by a hash of the columns ``by``, to slots of about ``limit`` rows."""
    hot = hot_keys(rows, keys, limit)
    slot = F.pmod(F.xxhash64(*by), F.ceil(F.col("_n") / limit))
    return rows.join(F.broadcast(hot), keys, "left").withColumn("_slot", F.coalesce(slot, F.lit(0)).cast("int")).drop("_n")


def parted(rows: DataFrame, keys: list[str], wanted: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` whose ``keys`` may be among those of ``wanted`` (columns of these names; ``n`` rows, about), which are
    all that are and few others, and the rest.  For a join that follows, so that the rest needs no shuffle.

    Keys are known by a bit of a bitmap, which is broadcast in pieces of 4 kB; past ``MOST_BITS`` more rows pass.
    """
    size = min(MOST_BITS, -(-max(n, 1) * KEY_BITS >> 15) << 15)
    place = lambda: F.pmod(F.xxhash64(*keys), F.lit(size)) + 1
    bits = wanted.select(place().alias("_at")).select(F.bitmap_bucket_number("_at").alias("_piece"), F.bitmap_bit_position("_at").alias("_bit")).distinct()
    bits = F.broadcast(bits.repartition("_piece").groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    at = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_at", place()).withColumn("_piece", F.bitmap_bucket_number("_at")).join(bits, "_piece", "left")
    may = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return tuple(found.filter(x).select(*rows.columns) for x in (may, ~may))


def likely(rows: DataFrame, keys: list[str], wanted: DataFrame, n: int) -> DataFrame:
    """The first part of ``parted``."""
    return parted(rows, keys, wanted, n)[0]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The groups, by the first ``keys`` columns, of rows that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cuts = [0, *(1 + np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def n_words(text) -> "F.Column":
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _fmix64(x: np.ndarray) -> np.ndarray:
    """A mixing permutation of the 64-bit integers (the public MurmurHash3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


mix64 = _fmix64


#: What a Python worker keeps between tasks, by kind; workers live long and run all kinds of tasks.
_KEPT: dict[str, object] = {}


def keep_only(kind: str, cache: object) -> None:
    """Notes a worker's cache and empties those of other kinds."""
    if _KEPT.get(kind) is not cache or len(_KEPT) > 1:
        for k in [k for k in _KEPT if k != kind]:
            _KEPT.pop(k).clear()
        _KEPT[kind] = cache


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered for as many words as ``most``."""

    def __init__(self, most: int = 200_000):
        import xxhash

        self.most, self.hash = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.hash(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        keep_only("words", self)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORD_HASHES = WordHashes()


def ascii_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased if asked for; none for null.

    ``bytes.split`` cuts at exactly the six ASCII white-space characters, and ``bytes.lower``
    changes A-Z only.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def split_words(texts: pa.Array | list[str | None], lower: bool = True) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words of each text, A-Z lower-cased if asked for: how many each has (none for null), and all of
    them one after another.  Arrow's ASCII white space is just the six characters of the contracts."""
    texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    bounds = cut.offsets.to_numpy().astype(np.int64)
    flat = cut.flatten()
    real = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty piece
    done = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return np.diff(done[bounds - bounds[0]]), flat.filter(real).cast(pa.binary()).dictionary_encode()


def hashed_words(texts: pa.Array | list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the 64-bit hashes of all of them one after another."""
    n, words = split_words(texts, lower)
    return n, WORD_HASHES.of(words.dictionary.to_pylist())[words.indices.to_numpy()]
