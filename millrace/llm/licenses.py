"""Licence notices in texts, found by a positional index of rare words.

Templates (``license_texts``) are indexed by word: (template, place).  Of each mandatory phrase of a
template the word with the highest inverse document frequency, counted over all texts, is looked up: no
notice lacks it, however many notices a text holds.  Each place of it says where the phrase would stand;
where all its words do, the phrase is verified.  A template is found where its mandatory phrases stand in
order and about as far apart as in the template (``slack`` words more or less), and enough of its words
stand in that order around them, so words that were put in, left out or changed elsewhere do no harm.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow, prepare, split_words
from millrace.llm.license_texts import TEXTS

#: Phrases of the base and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Share of a template's words that a notice holds, at least.
AGREE = 0.8
_FOLD = np.array([(c + 32) if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD.tobytes()).split()


def folded(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and a space for each character that is in no word."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    raw = _FOLD[np.frombuffer(data, np.uint8)] if data is not None else np.empty(0, np.uint8)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(raw)], offset=texts.offset)


def slack(gap: int) -> int:
    """Words that may have been put in or left out between two places ``gap`` words apart."""
    return 8 + gap // 4


@dataclass
class Index:
    """Templates as words, and the places of each word in them."""

    labels: list[str]
    templates: list[list[bytes]]
    mandatory: list[list[tuple[int, int]]]  # (first word, words) in the template, in order
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    idf: dict[bytes, float] = field(default_factory=dict)


def build_index(texts=TEXTS) -> Index:
    """``texts``: (label, mandatory phrases, text), phrases in the order in which they stand in the text."""
    out = Index([t[0] for t in texts], [words_of(t[2]) for t in texts], [])
    for k, (words, (label, phrases, _)) in enumerate(zip(out.templates, texts, strict=True)):
        for p, w in enumerate(words):
            out.postings[w].append((k, p))
        places, at = [], 0
        for phrase in phrases:
            x = words_of(phrase)
            found = next((i for i in range(at, len(words) - len(x) + 1) if words[i : i + len(x)] == x), None)
            if found is None:
                raise ValueError(f"{label}: {phrase!r} doesn't stand in the text, or not in this order")
            places.append((found, len(x)))
            at = found + 1
        if not places:
            raise ValueError(f"{label}: no mandatory phrase")
        out.mandatory.append(places)
    return out


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """Texts of ``docs`` (text) that have each word, and all texts; one row a word comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes | None] = Counter()
        for batch in batches:
            n[None] += batch.num_rows
            lengths, words = split_words(folded(batch.column(0)), lower=False)
            known = words.dictionary.to_pylist()
            wanted = np.array([w in vocabulary for w in known], bool)
            if wanted.any():
                at = words.indices.to_numpy().astype(np.int64)
                text = np.repeat(np.arange(len(lengths)), lengths)
                some = wanted[at]
                held, times = np.unique(np.unique(text[some] * len(known) + at[some]) % len(known), return_counts=True)
                for i, k in zip(held.tolist(), times.tolist(), strict=True):
                    n[known[i]] += k
        yield pa.RecordBatch.from_pydict({"word": pa.array(n.keys(), pa.binary()), "n": pa.array(n.values(), pa.int64())})

    found = arrow(docs.select(F.col("text").cast("string").alias("text")), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    rows = {None if r.word is None else bytes(r.word): r.n for r in found}
    return {w: n for w, n in rows.items() if w is not None}, rows.get(None, 0)


def weigh(index: Index, docs: DataFrame) -> Index:
    """Sets the words' inverse document frequencies, log((1 + texts) / (1 + texts with the word))."""
    n, total = document_frequencies(docs, set(index.postings))
    index.idf = {w: math.log((1 + total) / (1 + n.get(w, 0))) for w in index.postings}
    return index


def anchors(index: Index) -> dict[bytes, list[tuple[int, int, int]]]:
    """The words that are looked up: (template, phrase, place in the phrase) of each phrase's rarest word."""
    out = defaultdict(list)
    for k, (template, phrases) in enumerate(zip(index.templates, index.mandatory, strict=True)):
        for j, (p, m) in enumerate(phrases):
            q = min(range(m), key=lambda q: (-index.idf.get(template[p + q], 0.0), template[p + q], q))  # noqa: B023
            out[template[p + q]].append((k, j, q))
    return dict(out)


def common_words(template: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    at: dict[int, list[int]] = defaultdict(list)
    for i in range(len(words) - 1, -1, -1):
        at[int(words[i])].append(i)
    ends: list[int] = []  # ends[n]: least place at which a subsequence of n + 1 words ends
    for w in template.tolist():
        for i in at.get(w, ()):
            k = bisect_left(ends, i)
            if k == len(ends):
                ends.append(i)
            else:
                ends[k] = i
    return len(ends)


class Finder:
    """The index in the numbers that a batch gives to its words."""

    def __init__(self, index: Index, known: dict[bytes, int]):
        number = lambda words: np.array([known.get(w, -1 - i) for i, w in enumerate(words)], np.int64)
        self.index = index
        self.templates = [number(t) for t in index.templates]
        self.anchors = {known[w]: found for w, found in anchors(index).items() if w in known}

    def find(self, words: np.ndarray, hits: list[int]) -> list[tuple[str, int, float]]:
        """(label, first word, share of the template's words) of the templates found.  ``hits``: places of
        the words that are looked up, ascending."""
        stands: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # template -> phrase -> places
        for i in hits:
            for k, j, q in self.anchors[int(words[i])]:
                p, m = self.index.mandatory[k][j]
                a = i - q
                if a >= 0 and np.array_equal(words[a : a + m], self.templates[k][p : p + m]):
                    stands[k][j].append(a)
        out = []
        for k, by_phrase in stands.items():
            phrases, template = self.index.mandatory[k], self.templates[k]
            if len(by_phrase) < len(phrases):
                continue
            for first in by_phrase[0]:
                reach = [first]  # places of the phrase at which a chain from the first one may stand
                for j in range(1, len(phrases)):
                    gap = phrases[j][0] - phrases[j - 1][0]
                    places, ahead = by_phrase[j], set()
                    for x in reach:
                        ahead.update(places[bisect_left(places, max(x + 1, x + gap - slack(gap))) : bisect_right(places, x + gap + slack(gap))])
                    reach = sorted(ahead)
                if not reach:
                    continue
                before, after = phrases[0][0], len(template) - phrases[-1][0]
                begin = max(0, first - before - (slack(before) if before else 0))
                region = words[begin : reach[0] + after + slack(after)]
                share = common_words(template, region) / len(template)
                if share >= AGREE:
                    out.append((self.index.labels[k], max(0, first - before), share))
        return sorted(set(out), key=lambda x: (x[1], x[0], -x[2]))


def phrase_places(at: np.ndarray, text: np.ndarray, known: dict[bytes, int], phrase: str) -> np.ndarray:
    """Places, in all words of a batch, where the phrase's words stand one after another in one text."""
    words = [known.get(w) for w in words_of(phrase)]
    n = len(at) - len(words) + 1
    if None in words or n <= 0:
        return np.empty(0, np.int64)
    hit = text[: n] == text[len(words) - 1 :]
    for k, w in enumerate(words):
        hit &= at[k : k + n] == w
    return np.flatnonzero(hit)


def scan(docs: DataFrame, texts=TEXTS, phrases=PHRASES) -> DataFrame:
    """Scans whole texts of ``docs`` (doc_id, text; other columns are left alone) and returns a row for each
    row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches (label, first word,
    share).

    A null text counts as empty: no words, no labels, score 0.  The score is the largest share of a
    template that is found, 0 if none is.  Templates of one label that stand at one place are each listed, and
    the label counts once.  Very long texts are read whole, each a batch of its own; rows that repeat, or
    have no doc_id, are scanned each.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    index = weigh(build_index(texts), docs)
    match = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("share", pa.float64())]))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, words = split_words(folded(batch.column(1)), lower=False)
            known = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
            at = words.indices.to_numpy().astype(np.int64)
            text = np.repeat(np.arange(len(lengths)), lengths)
            starts = np.cumsum(lengths) - lengths
            base: dict[int, list[tuple[int, str]]] = defaultdict(list)
            for phrase, label in phrases:
                for i in phrase_places(at, text, known, phrase).tolist():
                    base[int(text[i])].append((i - int(starts[text[i]]), label))
            finder = Finder(index, known)
            looked_up = np.zeros(len(known) + 1, bool)
            looked_up[list(finder.anchors)] = True
            hits: dict[int, list[int]] = defaultdict(list)
            for i in np.flatnonzero(looked_up[at]).tolist():
                hits[int(text[i])].append(i - int(starts[text[i]]))
            rows = []
            for k, n in enumerate(lengths.tolist()):
                places = [p for p, _ in base.get(k, ())]
                found = finder.find(at[starts[k] : starts[k] + n], hits[k]) if k in hits else []
                labels = {x for _, x in base.get(k, ())}
                rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in found})), max((x[2] for x in found), default=0.0), [{"label": a, "first_word": b, "share": c} for a, b, c in found]))
            if rows:
                kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), match)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(rows, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:bigint,share:double>>")
