"""A quality classifier by hierarchical empirical Bayes.

A linear model fitted on a bounded sample of labelled documents gives each document's evidence that
it is good, and that it is toxic, as log odds.  Sites (hosts) and their parts (paths) have rates of
their own: the mean evidence of their other documents, shrunk toward the rate of the level above by as
many pseudo-documents as the level's own spread suggests.  A document's posterior replaces the rate that
the model assumed by its path's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import crf
from millrace.llm.common import give_back, arrow, hot_limit, join_hot, materialize, prepare, split_words
from millrace.llm.tokens import spread

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 8000
#: Words that the model may know for each of its two questions.
WORDS = 400
#: A word tells something if this many documents of the sample have it.
MIN_DOCS = 4
#: And if the share of such documents among them is this many standard errors from the sample's.
ERRORS = 4.0
#: Bytes of the beginnings of words.
STEMS = (4, 5, 6)
#: Bounds of the pseudo-documents of a prior.
STRENGTH = (20.0, 1e6)
#: Probabilities are kept this far from 0 and 1.
EDGE = 1e-4
#: Features that don't depend on words, and what the presence of a word is divided by.
DENSE, PRESENT = 9, 0.3
_MARKS = b".,;:!?\"'()[]{}*#$%&|<>-_"


@dataclass
class Model:
    words: dict[bytes, int]
    center: np.ndarray
    scale: np.ndarray
    good: np.ndarray
    toxic: np.ndarray
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict)  # a worker's: what a word of a text holds

    def held(self, word: bytes) -> tuple[int, ...]:
        out = self.known.get(word)
        if out is None:
            if len(self.known) > 200_000:
                self.known.clear()
            out = self.known[word] = tuple(self.words[x] for x in names(word) if x in self.words)
        return out


def names(word: bytes) -> list[bytes]:
    """A word (A-Z lower-cased) without marks at its ends, and, behind a ^, its beginnings if it is
    longer: what a word grows from may tell more than the word."""
    w = word.strip(_MARKS)
    return [w, *(b"^" + w[:n] for n in STEMS if len(w) > n)] if w else []


def present(texts: pa.Array | list[str | None], held: Callable[[bytes], tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, number) pairs of all numbers that the words of the texts hold.  Each
    different word of the batch is looked up once."""
    n, words = split_words(texts)
    of = [held(w) for w in words.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, of), np.int64, len(of))
    flat = np.fromiter((x for t in of for x in t), np.int64, int(sizes.sum()))
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = words.indices.to_numpy().astype(np.int64)
    some = sizes[at] > 0
    text, at = np.divmod(np.unique((np.repeat(np.arange(len(n)), n) * len(of) + at)[some]), len(of))
    values, m = spread(flat, sizes, at)
    top = int(flat.max()) + 1
    return np.divmod(np.unique(np.repeat(text, m) * top + values), top)


def dense(texts: list[str | None]) -> np.ndarray:
    """Features of whole texts that don't depend on words: rows x ``DENSE``."""
    t = crf.measure(texts)
    if not len(texts):
        return np.empty((0, DENSE))
    first = np.concatenate([[0], np.cumsum(t.lines)[:-1]]).astype(np.int64)
    words = np.maximum(t.n_words, 1)[:, None]
    per_word = np.add.reduceat(t.features[:, 1:7] * np.maximum(t.line_words, 0)[:, None], first, axis=0) / words
    shape = np.stack([np.minimum(np.log1p(t.n_words), 4), t.word_chars / words[:, 0] > 15, t.n_repeat_words / words[:, 0]], axis=1)
    return np.concatenate([per_word, shape], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps, summed up over blocks of rows; the first column is the constant."""
    w = np.zeros(x.shape[1])
    rate = np.clip(y.mean() if len(y) else 0.5, EDGE, 1 - EDGE)
    w[0] = np.log(rate / (1 - rate))
    if len(np.unique(y)) < 2:
        return w
    ridge = np.full(x.shape[1], l2)
    ridge[0] = 1e-6
    for _ in range(steps):
        g, h = -ridge * w, np.diag(ridge)
        for a in range(0, len(x), 1000):
            b = x[a : a + 1000].astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(b @ w, -30, 30)))
            g += b.T @ (y[a : a + 1000] - p)
            h += (b * (p * (1 - p))[:, None]).T @ b
        move = np.linalg.solve(h, g)
        w = w + move * min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fits the model on at most ``most`` documents (doc_id, text) with labels (doc_id, quality, toxic), whole
    texts; see ``labelled_sample`` for nulls, clashing labels and repeated ids."""
    prepare(docs.sparkSession)
    some = materialize(crf.labelled_sample(docs, labels, most).select("doc_id", "text", F.col("quality").cast("int"), F.col("toxic").cast("int")), "sample")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number: dict[bytes, int] = {}
            row, at = present(batch.column(0), lambda w: tuple(number.setdefault(x, len(number)) for x in names(w)))  # noqa: B023
            word = pa.array(number, pa.binary()).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([word, *(batch.column(k).take(pa.array(row)) for k in (1, 2))], names=["word", "quality", "toxic"])

    pairs = arrow(some.select("text", "quality", "toxic"), split, "word binary, quality int, toxic int")
    n_bad, n_toxic, n = some.agg(F.coalesce(F.sum((F.col("quality") <= 0).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)), F.count("*")).first()
    counted = pairs.groupBy("word").agg(F.count("*").alias("n"), F.sum((F.col("quality") <= 0).cast("long")).alias("bad"), F.sum((F.col("toxic") > 0).cast("long")).alias("toxic"))
    known = materialize(counted.filter(F.col("n") >= MIN_DOCS), "words")

    def telling(hits: str, of: int) -> list[bytes]:
        """Words whose share of such documents is furthest from the sample's, in standard errors."""
        rate = of / max(n, 1)
        z = F.abs(F.col(hits) - F.col("n") * rate) / F.sqrt(F.col("n") * max(rate * (1 - rate), 1e-9))
        return [bytes(r.word) for r in known.filter(z >= ERRORS).orderBy(z.desc(), "word").limit(WORDS).collect()]

    words = {w: i for i, w in enumerate(dict.fromkeys(telling("toxic", n_toxic) + telling("bad", n_bad)))}
    model = Model(words, np.zeros(DENSE), np.ones(DENSE), np.zeros(1), np.zeros(1))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((batch.num_rows, max(len(words), 1)), np.uint8)
            bits[present(batch.column(1), model.held)] = 1
            raw = [x.tobytes() for x in np.packbits(bits, axis=1)]
            x = [x.tobytes() for x in dense(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), pa.array(raw, pa.binary()), batch.column(2), batch.column(3)], names=["doc_id", "x", "words", "quality", "toxic"])

    # bounded by the sample, some hundred bytes a row
    rows = sorted(arrow(some.select("doc_id", "text", "quality", "toxic"), gather, "doc_id long, x binary, words binary, quality int, toxic int").collect(), key=lambda r: r.doc_id)
    if not rows:  # nothing is known: all is good
        model.good, model.toxic = (np.concatenate([[c], np.zeros(DENSE + len(words))]) for c in (3.0, -3.0))
        return model
    x = np.stack([np.frombuffer(r.x, np.float64) for r in rows])
    model.center, model.scale = x.mean(axis=0), x.std(axis=0)
    model.scale[model.scale < 1e-9] = 1
    z = np.empty((len(rows), 1 + DENSE + len(words)), np.float32)
    z[:, 0] = 1
    z[:, 1 : 1 + DENSE] = (x - model.center) / model.scale
    for i, r in enumerate(rows):
        z[i, 1 + DENSE :] = np.unpackbits(np.frombuffer(r.words, np.uint8), count=len(words)) / PRESENT
    quality, toxic = np.array([r.quality > 0 for r in rows], float), np.array([r.toxic > 0 for r in rows], float)
    model.good, model.toxic = _logistic(z, quality), _logistic(z, toxic)
    model.known = {}
    del rows, x, z
    give_back()
    return model


def log_odds(texts: pa.Array, model: Model) -> list[np.ndarray]:
    """Log odds that each whole text is good, and that it is toxic."""
    z = (dense(texts.to_pylist()) - model.center) / model.scale
    text, word = present(texts, model.held)
    return [w[0] + z @ w[1 : 1 + DENSE] + np.bincount(text, w[1 + DENSE :][word] / PRESENT, len(texts)) for w in (model.good, model.toxic)]


def evidence(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """Log odds of each row of ``docs`` (doc_id, text): doc_id, host, path, good, toxic.  A null text
    counts as empty."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, log_odds(batch.column(3), model))], names=["doc_id", "host", "path", "good", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return arrow(rows, score, "doc_id long, host string, path string, good double, toxic double")


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def _strength(within: Column, between: Column) -> Column:
    """Pseudo-documents of a prior: variance within groups over variance between them; the most if
    they don't differ by more than chance, or too few are there to tell."""
    k = F.try_divide(within, F.when(between > 0, between))
    return F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.coalesce(k, F.lit(STRENGTH[1]))))


def posteriors(scored: DataFrame) -> DataFrame:
    """Adds to ``evidence`` the rates of each row's host and path and the posteriors of its document.

    Each level's strength comes from the variances within and between its groups (the one-way analysis of
    variance of credibility theory): hosts around the whole, and paths around their hosts.  A row's own
    evidence takes no part in the rates that correct it.  Null hosts are one host, and null paths one
    path of their host.  All sums are made by grouped aggregation, and rows of a site that has very many
    stay where they are.
    """
    kinds = ("good", "toxic")
    keys = ["host_key", "path_key"]
    scored = scored.select("doc_id", "host", "path", *kinds, F.coalesce(F.concat(F.lit("="), "host"), F.lit("-")).alias("host_key"), F.coalesce(F.concat(F.lit("="), "path"), F.lit("-")).alias("path_key"))
    each = [x for k in kinds for p in [_sigmoid(F.col(k))] for x in (F.sum(p).alias(f"{k}_sum"), F.sum(p * p).alias(f"{k}_squares"))]
    paths = materialize(scored.groupBy(*keys).agg(F.count("*").alias("n"), *each), "paths")
    n = F.col("n")
    of_host = [x for k in kinds for x in (F.sum(f"{k}_sum").alias(f"{k}_host_sum"), F.sum(f"{k}_squares").alias(f"{k}_host_squares"), F.sum(F.pow(F.col(f"{k}_sum"), 2) / n).alias(f"{k}_path_means"))]
    hosts = materialize(paths.groupBy("host_key").agg(F.sum("n").alias("host_n"), F.count("*").alias("paths"), F.sum(n * n).alias("path_n2"), *of_host), "hosts")
    h = F.col("host_n")
    of_all = [
        x
        for k in kinds
        for x in (
            F.sum(f"{k}_host_sum").alias(f"{k}_all"),
            F.sum(f"{k}_host_squares").alias(f"{k}_squares"),
            F.sum(f"{k}_path_means").alias(f"{k}_paths"),
            F.sum(F.pow(F.col(f"{k}_host_sum"), 2) / h).alias(f"{k}_hosts"),
        )
    ]
    every = hosts.agg(F.sum(h).alias("N"), F.count("*").alias("H"), F.sum("paths").alias("P"), F.sum(h * h).alias("host_n2"), F.sum(F.col("path_n2") / h).alias("path_n2"), *of_all)
    c = F.col
    strengths = []
    for k in kinds:
        in_paths = F.try_divide(c(f"{k}_squares") - c(f"{k}_paths"), c("N") - c("P"))
        in_hosts = F.try_divide(c(f"{k}_squares") - c(f"{k}_hosts"), c("N") - c("H"))
        between_paths = F.try_divide(c(f"{k}_paths") - c(f"{k}_hosts") - (c("P") - c("H")) * in_paths, c("N") - c("path_n2"))
        between_hosts = F.try_divide(c(f"{k}_hosts") - F.pow(c(f"{k}_all"), 2) / c("N") - (c("H") - 1) * in_hosts, c("N") - c("host_n2") / c("N"))
        strengths += [(c(f"{k}_all") / c("N")).alias(f"{k}_global"), _strength(in_hosts, between_hosts).alias(f"{k}_k_host"), _strength(in_paths, between_paths).alias(f"{k}_k_path")]
    every = every.select(*strengths)
    sites = paths.join(hosts.select("host_key", "host_n", *(f"{k}_host_sum" for k in kinds)), "host_key").crossJoin(F.broadcast(every))  # one row
    sites = sites.drop(*(f"{k}_squares" for k in kinds))
    out = join_hot(scored, sites, keys, hot_limit(scored.count()))
    for k in kinds:
        own = _sigmoid(c(k))
        out = out.withColumn(f"{k}_host", (c(f"{k}_host_sum") - own + c(f"{k}_k_host") * c(f"{k}_global")) / (h - 1 + c(f"{k}_k_host")))
        out = out.withColumn(f"{k}_path", (c(f"{k}_sum") - own + c(f"{k}_k_path") * c(f"{k}_host")) / (n - 1 + c(f"{k}_k_path")))
    post = {k: _sigmoid(c(k) - _logit(c(f"{k}_global")) + _logit(c(f"{k}_path"))) for k in kinds}
    return out.select(
        "doc_id", "host", "path",
        *(_sigmoid(c(k)).alias(f"{k}_document") for k in kinds),
        *(f"{k}_host" for k in kinds),
        *(f"{k}_path" for k in kinds),
        *(post[k].alias(f"{k}_posterior") for k in kinds),
    )


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most: int = SAMPLE) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, and columns of host and path; others are left alone):
    the columns of ``posteriors`` and kept: likelier good than not, and likelier not toxic.

    Without labels, all are kept.  Null and empty texts, repeated rows and rows without doc_id are judged
    like others; very long texts are read whole, each a batch of its own.  An empty table gives no rows.
    """
    model = fit(docs, labels, most)
    scored = materialize(evidence(docs, model, F.col(host), F.col(path)), "evidence")
    return posteriors(scored).withColumn("kept", (F.col("good_posterior") >= 0.5) & (F.col("toxic_posterior") < 0.5))
