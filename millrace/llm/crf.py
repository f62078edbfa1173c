"""Line labelling by a linear-chain conditional random field, for a quality rule.

Every line of a text is content (1) or boilerplate (0).  A line has a vector of features; the chain
has weights for features and for pairs of neighbouring labels.  The weights are fitted by maximum
likelihood on a bounded sample of labelled documents.  No table labels lines: the lines of a good
document are content and those of a bad one boilerplate, and, so that the chain learns where one ends and
the other begins, each document comes once more with a block of lines of the other kind spliced in.
Viterbi's algorithm finds the likeliest labels of all lines of every text.  A document is kept if the lines
marked as content hold at least ``SHARE`` of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow, hashed_words, mix64, prepare

#: Labelled documents that the weights are fitted on, at most; those with the smallest hashes of ids.
SAMPLE = 800
#: Lines of a spliced block at most, and lines of a window of the fit: longer texts are fitted on as several
#: windows, which hold all their lines.
SPLICE, WINDOW = 8, 64
SHARE = 0.5
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
FEATURES = ("one", "symbols a word", "upper a letter", "marks a word", "same as before", "repeated", "duplicate line", "short", "long words", "tiny words", "digits", "no words")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_IS = {
    "space": _table(_SPACE),
    "symbol": _table(SYMBOLS),
    "upper": _table(bytes(range(65, 91))),
    "letter": _table(bytes([*range(65, 91), *range(97, 123), *range(192, 256)])),
    "mark": _table(b"!?#*$%&|<>@~^_=+{}[]\\/"),
    "digit": _table(bytes(range(48, 58))),
    "char": _table(bytes([*range(128), *range(192, 256)])),
}


@dataclass
class Texts:
    """Counts and line features of a batch of texts."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    lines: np.ndarray  # lines of each text
    line_words: np.ndarray  # words of each line, texts one after another
    features: np.ndarray  # lines x features


def _cum(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


def measure(texts: list[str | None]) -> Texts:
    """Whole texts; null is an empty text, which has one line without words.

    Takes about 30 bytes of memory for a byte of text, for one class of characters after another.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)  # every line, and every text, ends with \n
    ends = np.flatnonzero(data == 10)
    text_ends = np.cumsum([len(r) + 1 for r in raws], dtype=np.int64)
    last_line = np.searchsorted(ends, text_ends - 1)
    lines = np.diff(np.concatenate([[-1], last_line]))
    space = _IS["space"][data]

    def per_line(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.cumsum(marks, dtype=np.int32)[ends], prepend=0).astype(np.int64)  # a line's end is in no class

    per = {k: per_line(v[data]) for k, v in _IS.items() if k not in ("space", "char")}
    per["wordchar"] = per_line(_IS["char"][data] & (1 - space))
    per["word"] = per_line((space == 0) & np.concatenate([[True], space[:-1] == 1]))
    del space
    first_line = np.concatenate([[0], last_line[:-1] + 1])
    total = {k: np.add.reduceat(v, first_line) for k, v in per.items()} if len(texts) else {k: np.empty(0, np.int64) for k in per}

    # windows of three words that come again within their text
    n_words = total["word"]
    hashes = hashed_words(texts, lower=False)[1]
    doc = np.repeat(np.arange(len(texts)), n_words)
    covered = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        gram = mix64(mix64(mix64(hashes[:-2]) + hashes[1:-1]) + hashes[2:]) + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        _, inverse, counts = np.unique(mix64(gram[inside]), return_inverse=True, return_counts=True)
        again = inside[counts[inverse] > 1]
        for k in range(3):
            covered[again + k] = True
    repeated = _cum(covered)
    same = _cum(np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])]) if len(hashes) else np.empty(0, bool))
    word_at = _cum(per["word"])
    a, b = word_at[:-1], word_at[1:]
    text_word = _cum(n_words)

    dup = np.zeros(len(ends), bool)
    at = 0
    for t, n in zip(texts, lines.tolist(), strict=True):
        if n > 1:
            seen: set[str] = set()
            has = per["word"][at : at + n]
            for k, line in enumerate(t.split("\n")):
                if has[k]:
                    if line in seen:
                        dup[at + k] = True
                    else:
                        seen.add(line)
        at += n
    words = np.maximum(per["word"], 1)
    letters = np.maximum(per["letter"], 1)
    length = per["wordchar"] / words
    features = np.stack(
        [
            np.ones(len(ends)),
            np.minimum(per["symbol"] / words, 4),
            per["upper"] / letters,
            np.minimum(per["mark"] / words, 4),
            (same[b] - same[a]) / words,
            (repeated[b] - repeated[a]) / words,
            dup,
            per["word"] < 5,
            length > 15,
            length < 2.5,
            np.minimum(per["digit"] / words, 4),
            per["word"] == 0,
        ],
        axis=1,
    )
    n_dup = np.add.reduceat(dup.astype(np.int64), first_line) if len(texts) else np.empty(0, np.int64)
    return Texts(n_words, total["wordchar"], total["symbol"], n_dup, repeated[text_word[1:]] - repeated[text_word[:-1]], lines, per["word"], features)


@dataclass
class Chain:
    """Weights of a fitted chain: features x 2 labels, and label x next label."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Likeliest labels of all lines; texts of equal place are worked on together.  Ties go to content."""
        score = features @ self.emit
        first = np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(np.int64)
        order = np.argsort(-lines, kind="stable")
        back = np.zeros((len(score), 2), np.int8)
        best = score.copy()
        most = int(lines.max()) if len(lines) else 0
        n_at = np.searchsorted(-lines[order], -np.arange(most), side="left")  # texts with more lines than k
        for k in range(1, most):
            at = first[order[: n_at[k]]] + k
            ways = best[at - 1][:, :, None] + self.move[None]
            back[at] = np.where(ways[:, 1] >= ways[:, 0], 1, 0)
            best[at] = ways.max(axis=1) + score[at]
        out = np.zeros(len(score), np.int8)
        last = first + lines - 1
        if len(lines):
            out[last] = best[last, 1] >= best[last, 0]
        for k in range(most - 1, 0, -1):
            at = first[order[: n_at[k]]] + k
            out[at - 1] = back[at, out[at]]
        return out


def spliced(features: list[np.ndarray], labels: list[int], seed: int = 1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sequences of lines with a label each: the documents', and each once more with a block of up to
    ``SPLICE`` lines of a document of the other kind, at any place."""
    rng = np.random.default_rng(seed)
    kinds = [[i for i, y in enumerate(labels) if y == c] for c in (0, 1)]
    xs, ys = [], []
    for f, y in zip(features, labels, strict=True):
        xs.append(f)
        ys.append(np.full(len(f), y))
        others = kinds[1 - y]
        if others:
            donor = features[others[rng.integers(len(others))]]
            n = int(rng.integers(1, min(SPLICE, len(donor)) + 1))
            a, at = int(rng.integers(len(donor) - n + 1)), int(rng.integers(len(f) + 1))
            xs.append(np.concatenate([f[:at], donor[a : a + n], f[at:]]))
            ys.append(np.concatenate([np.full(at, y), np.full(n, 1 - y), np.full(len(f) - at, y)]))
    return xs, ys


def fit_chain(features: list[np.ndarray], labels: list[np.ndarray], steps: int = 150, rate: float = 0.1, l2: float = 1e-3) -> Chain:
    """Maximum likelihood by gradient steps (Adam) on sequences of lines with a label each; the expected
    counts come from forward-backward sums.  Both labels weigh the same in all."""
    k = features[0].shape[1] if features else len(FEATURES)
    theta = np.zeros(2 * k + 4)
    if not features or len({int(c) for y in labels for c in np.unique(y)}) < 2:
        return Chain(np.vstack([[[0.0, 1.0]], np.zeros((k - 1, 2))]), np.zeros((2, 2)))  # nothing to tell apart: all is content
    mostly = np.array([y.mean() >= 0.5 for y in labels])
    size = np.array([len(f) for f in features])
    shares = np.where(mostly, 0.5 / max(size[mostly].sum(), 1), 0.5 / max(size[~mostly].sum(), 1))
    cut = [(f[a : a + WINDOW], y[a : a + WINDOW], w) for f, y, w in zip(features, labels, shares, strict=True) for a in range(0, len(f), WINDOW)]
    cut.sort(key=lambda c: -len(c[0]))  # the windows with more lines than t are the first ones
    lengths = np.array([len(f) for f, _, _ in cut])
    most = int(lengths.max())
    x, true = np.zeros((len(cut), most, k)), np.zeros((len(cut), most, 2))
    for i, (f, y, _) in enumerate(cut):
        x[i, : len(f)] = f
        true[i, np.arange(len(f)), y] = 1
    on = np.arange(most)[None] < lengths[:, None]
    live = on.sum(axis=0).tolist()
    last = (np.arange(len(cut)), lengths - 1)
    weight = np.array([w for _, _, w in cut])
    w = weight[:, None, None]
    true_move = np.einsum("nta,ntb->ab", true[:, :-1] * w, true[:, 1:])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        emit, move = theta[: 2 * k].reshape(k, 2), theta[2 * k :].reshape(2, 2)
        s = x @ emit
        fwd, bwd = np.zeros_like(s), np.zeros_like(s)
        fwd[:, 0] = s[:, 0]
        for t in range(1, most):
            n = live[t]
            fwd[:n, t] = np.logaddexp.reduce(fwd[:n, t - 1, :, None] + move[None], axis=1) + s[:n, t]
        z = np.logaddexp.reduce(fwd[last], axis=1)
        for t in range(most - 2, -1, -1):
            n = live[t + 1]
            bwd[:n, t] = np.logaddexp.reduce(move[None] + (s[:n, t + 1] + bwd[:n, t + 1])[:, None, :], axis=2)
        prob = np.exp(np.where(on[:, :, None], fwd + bwd - z[:, None, None], -np.inf))
        g_emit = np.einsum("ntk,ntc->kc", x, (true - prob) * w)
        both = fwd[:, :-1, :, None] + move[None, None] + (s + bwd)[:, 1:, None, :] - z[:, None, None, None]
        pair = np.exp(np.where(on[:, 1:, None, None], both, -np.inf)) * w[..., None]
        g = np.concatenate([g_emit.ravel(), (true_move - pair.sum(axis=(0, 1))).ravel()]) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(theta[: 2 * k].reshape(k, 2), theta[2 * k :].reshape(2, 2))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled documents, the ones with the smallest hashes of ids: doc_id, text,
    quality, toxic.

    Of several labels of a document the worst counts (smallest quality, largest toxic); of several texts of
    a doc_id, the one with the smallest hash.  Labels without doc_id or quality, and null texts, are left
    out.  The number of rows is bounded, and so is what is broadcast.
    """
    some = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    some = some.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    one = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min(F.struct(F.xxhash64("text"), F.col("text").alias("text"))).alias("_one"))
    return one.select("doc_id", F.col("_one.text").alias("text"), "quality", "toxic")


def fit_on_labels(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Chain:
    """Fits a chain on a bounded sample of documents (doc_id, text) with labels (doc_id, quality): on
    all lines of their whole texts.  The driver gets the lines' features only."""
    prepare(docs.sparkSession)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = measure(batch.column(1).to_pylist())
            parts = np.split(got.features.astype(np.float32), np.cumsum(got.lines)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in parts], pa.binary())], names=["doc_id", "quality", "x"])

    sample = labelled_sample(docs, labels, most).select("doc_id", "text", F.col("quality").cast("int"))
    rows = sorted(arrow(sample, lines, "doc_id long, quality int, x binary").collect(), key=lambda r: r.doc_id)  # bounded by the sample
    found = [np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)).astype(np.float64) for r in rows]
    return fit_chain(*spliced(found, [int(r.quality > 0) for r in rows]))


def line_labels(docs: DataFrame, chain: Chain, share: float = SHARE) -> DataFrame:
    """Labels the lines of ``docs`` (doc_id, text) and returns a row for each of its rows: doc_id,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, labels
    (a 1 or 0 for each line, in a string) and kept.

    A null text counts as empty: one line, no words.  Too few words, or mostly repeated ones, fail the
    base.  Very long texts are read whole, each a batch of its own; rows that repeat, or have no doc_id, are
    judged each; ties between the two labels of a line go to content.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = measure(batch.column(1).to_pylist())
            marks = chain.viterbi(got.features, got.lines)
            first = np.concatenate([[0], np.cumsum(got.lines)[:-1]]).astype(np.int64)
            content = np.add.reduceat(got.line_words * marks, first)
            digits = (marks + 48).astype(np.uint8).tobytes().decode()
            strings = [digits[a : a + n] for a, n in zip(first.tolist(), got.lines.tolist(), strict=True)]
            failed = (got.n_words < MIN_WORDS) | (100 * got.n_repeat_words > 50 * got.n_words)
            kept = ~failed & (content >= share * got.n_words)
            cols = [batch.column(0), got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, failed, content, pa.array(strings, pa.string()), kept]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_words", "labels", "kept"]
    kinds = ["long"] * 6 + ["boolean", "long", "string", "boolean"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(rows, label, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
