"""Token ids of whole texts by a public tokenizer, fast enough for a corpus.

A byte-level BPE never merges across its pre-tokens, and a single space between two other
characters always begins one.  So a text may be cut at such spaces, each different piece encoded
once, and the ids put together again; natural text repeats its words, so most pieces are looked up.
Pieces not met before are cut once more, where letters and marks meet, which pre-tokens never span,
and the parts not met before are encoded together by the tokenizers library.  Tokenizers of another make
encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.common import keep_only

# a task has one core; the library's own threads would only spin
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

TOKENIZER = "byte_bpe_50k.json"
#: Parts of pieces that a worker remembers.
PIECES = 500_000
#: Characters in a call of the library, which is fastest on short texts.
CALL = 2_000
#: A Latin letter or digit and an ASCII mark or line end; apostrophes may belong to what follows.
_LETTER, _MARK = r"([A-Za-z0-9À-ÖØ-öø-ɏ])", r"([!-&(-/:-@\[-`{-~\n])"
_MARK_AFTER, _MARK_BEFORE = _LETTER + _MARK, _MARK + _LETTER
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Pieces that aren't cut once more.
_UNCUT = rf"'|\x00|{_WHITE}{_WHITE}"
#: A space beside other white space (Unicode's, and the four separators that Python adds), or at an end.
_ODD_TEXT = rf"\A | \z|\x00|{_WHITE} | {_WHITE}"
#: Bytes of text that are encoded together.
TOGETHER = 3_000_000


def spread(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``at`` of ``values``, which holds runs of the ``sizes`` one after another; and their sizes."""
    n = sizes[at]
    done = np.cumsum(n)
    begin = np.cumsum(sizes) - sizes
    total = int(done[-1]) if len(done) else 0
    return values[np.repeat(begin[at] - (done - n), n) + np.arange(total)], n


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids.  ``path`` is a file of the tokenizers library."""

    def __init__(self, path: str, most: int = PIECES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.by_piece = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None
            and not any(" " in a["content"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        )
        self.most = most
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before ``parts`` began anew
        if self.by_piece and added:
            # a special token's own marks must stay together
            tokens = "|".join(re.escape(a["content"]) for a in added)
            self.whole, self.uncut = re.compile(tokens).search, f"{_UNCUT}|{tokens}"
        else:
            self.whole, self.uncut = lambda part: None, _UNCUT
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)  # of no use, as a part is encoded once
        if self.by_piece:
            self.line_end = self.tok.encode("\n", add_special_tokens=False).ids
            self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
            self.starts = np.zeros(max(self.size, 1), bool)  # ids of tokens that begin with a space
            for token, i in self.tok.get_vocab(with_added_tokens=False).items():
                self.starts[i] = token.startswith("Ġ")
        else:
            self.dtype = np.dtype("<u4")

    def _encode_parts(self, parts: list[str], begins, gap: int) -> None:
        """Encodes parts in groups, a group in one text.  ``begins`` tells the ids that begin a part;
        with gap 1 these are line ends put before each part, and not its own."""
        groups, n = [[]], 0
        for part in parts:
            if n > CALL:
                groups.append([])
                n = 0
            groups[-1].append(part)
            n += len(part)
        step = self.dtype.itemsize
        for i in range(0, len(groups), 64):
            some = groups[i : i + 64]
            texts = ["".join(f"\n{x}" for x in g) if gap else "".join(g) for g in some]
            for group, got in zip(some, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(got.ids, self.dtype)
                at = np.flatnonzero(begins(ids))
                if len(at) == len(group) and len(at) and at[0] == 0:
                    raw = ids.tobytes()
                    self.parts.update(zip(group, map(raw.__getitem__, map(slice, ((at + gap) * step).tolist(), [*(at[1:] * step).tolist(), len(raw)])), strict=True))

    def clear(self) -> None:
        self.parts, self.older = {}, {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int64).astype(self.dtype).tobytes()

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        """Ids, as bytes, of distinct parts of pieces."""
        found = list(map(self.parts.get, parts))
        new = [p for p, x in zip(parts, found, strict=True) if x is None]
        if new:
            if len(self.parts) + len(new) > self.most // 2:
                self.parts, self.older = {}, self.parts
            again = {p: x for p in new if (x := self.older.get(p)) is not None}
            self.parts.update(again)
            new = [p for p in new if p not in again]
            self._encode_parts([x for x in new if x[:1] == " "], lambda ids: self.starts[ids], 0)
            if len(self.line_end) == 1:
                self._encode_parts([x for x in new if x[:1].isalnum() and len(x.split()) == 1 and not self.whole(x)], lambda ids: ids == self.line_end[0], 1)
            for p in new:
                if p not in self.parts:
                    self.parts[p] = self._plain(p)
            found = [self.parts[p] if x is None else x for p, x in zip(parts, found, strict=True)]
        return found

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has."""
        cut = pc.replace_substring_regex(pc.replace_substring_regex(pieces, _MARK_AFTER, "\\1\0\\2"), _MARK_BEFORE, "\\1\0\\2")
        cut = pc.if_else(pc.match_substring_regex(pieces, self.uncut), pieces, cut)
        parts = pc.split_pattern(cut, "\0")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        flat = parts.flatten().dictionary_encode()
        blobs = self._of_parts(flat.dictionary.to_pylist())
        ids, n = self._gather(blobs, flat.indices.to_numpy().astype(np.int64))
        done = np.concatenate([[0], np.cumsum(n)])
        return ids, done[bounds[1:]] - done[bounds[:-1]]

    def _gather(self, blobs: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.dtype.itemsize
        return spread(np.frombuffer(b"".join(blobs), self.dtype), sizes, at)

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; of null and of the empty text, none.

        Texts are cut, and different pieces found, by Arrow; only those pieces are handled one by one.
        """
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_piece:
            return [np.frombuffer(self._plain(t), self.dtype) for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, _ODD_TEXT)
        if pc.any(odd).as_py():
            out = [None] * len(texts)
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                out[i] = np.frombuffer(self._plain(texts[i].as_py()), self.dtype)
            plain = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
            for i, ids in zip(plain.tolist(), self._even(texts.take(pa.array(plain))), strict=True):
                out[i] = ids
            return out
        return self._even(texts)

    def _even(self, texts: pa.Array) -> list[np.ndarray]:
        """Texts whose spaces all stand alone."""
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy()[:-1].astype(np.int64)
        pieces = cut.flatten()
        starts = starts - starts[0]
        is_first = np.zeros(len(pieces), bool)
        is_first[starts] = True
        distinct = pieces.filter(pa.array(~is_first)).dictionary_encode()
        ids, sizes = self._of_pieces(pc.binary_join_element_wise(" ", distinct.dictionary, ""))
        firsts = pieces.take(pa.array(starts)).to_pylist()  # a text's first piece has no space before it
        blobs = {w: self._plain(w) if w else b"" for w in set(firsts)}
        place = {w: len(sizes) + k for k, w in enumerate(blobs)}
        at = np.empty(len(pieces), np.int64)
        at[~is_first] = distinct.indices.to_numpy()
        at[is_first] = [place[w] for w in firsts]
        ids = np.concatenate([ids, np.frombuffer(b"".join(blobs.values()), self.dtype)])
        sizes = np.concatenate([sizes, np.fromiter(map(len, blobs.values()), np.int64, len(blobs)) // self.dtype.itemsize])
        out, n = spread(ids, sizes, at)
        return np.split(out, np.cumsum(n)[starts[1:] - 1])

    def batches(self, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        """Batches, several put together as long as they are small, with the ids of their texts."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(column).nbytes
            if size >= TOGETHER:
                yield self._together(held, column)
                held, size = [], 0
        if held:
            yield self._together(held, column)

    def _together(self, held: list[pa.RecordBatch], column: int) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        one = held[0] if len(held) == 1 else pa.concat_batches(held)
        return one, self.encode(one.column(column))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; it stays loaded while the Python worker lives."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    keep_only("tokens", _ENCODERS[path])
    return _ENCODERS[path]
