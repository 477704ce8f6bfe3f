"""Token ids of whole texts with the tokenizers library, made faster by remembering the ids of words.

A text falls into chunks at places where its tokenizer's own splitting always has a boundary: before white space, and
between a letter and ASCII punctuation or a digit. Each different chunk goes through the tokenizer once; a process keeps
a bounded number of them. Chunks are grouped by a hash, and compared byte by byte with the one that stands for them. For
tokenizers whose splitting is not one of the two known kinds, and for texts with unusual white space, an added token or a
chunk that differs from its group's, the tokenizer takes the whole text.

Ids are those of the library's plain call, encode(text, add_special_tokens=False): a text that spells out an added token,
as ``<|endoftext|>``, has that token's id there.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gazeframe.llm.grams import FOLD, LONG, eights, raw, span_hashes

#: White space besides the blank and the line feed, for any of the libraries; and the first bytes of such characters.
_ODD = re.compile("[^\\S \\n]|[\\x00-\\x09\\x0b-\\x1f\\x7f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f-\\u2064\\u3000\\ufeff]")
_MAYBE_ODD = np.zeros(256, bool)
_MAYBE_ODD[[*range(0x0A), *range(0x0B, 0x20), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A]] = True
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_STOP = np.array([b < 128 and b > 0x20 and not chr(b).isalpha() for b in range(256)])
_SAME = np.arange(256, dtype=np.uint8)


def _kind(config: dict) -> str:
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "bytes"
    steps = pre.get("pretokenizers") or [{}]
    kept = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    if kept == ["NFC", "Replace", "Lowercase"] and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
        return "words"
    return "whole"


def chunks(data: np.ndarray, offsets: np.ndarray, blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the chunks of all texts; ``blanks``: white space belongs to the chunk after it, else to none."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    cut = np.zeros(n, bool)
    latin = np.zeros(n, bool)  # the second byte of a letter from U+00C0 to U+023F, but for U+0130, which ends in a mark in lower case
    latin[1:] = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC8) & (data[1:] >= 0x80) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    latin[1:] &= (data[:-1] != 0xC4) | (data[1:] != 0xB0)
    cut[1:] = (~space[:-1] & space[1:]) | ((_LETTER[data[:-1]] | latin[:-1]) & _STOP[data[1:]])
    cut[offsets[:-1][offsets[:-1] < n]] = True
    if not blanks:
        cut[1:] |= space[:-1] & ~space[1:]
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    if not blanks:
        word = ~space[start]
        start, end = start[word], end[word]
    return start, end


def clashing(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans of ``data`` differ from those of ``other`` that begin at ``at``."""
    mine, theirs = eights(data), eights(other)
    wrong = end - start != size
    rest = np.flatnonzero(~wrong)
    for k in range(0, LONG, 8):
        if not len(rest):
            break
        shift = (8 * np.maximum(8 - size[rest] + k, 0)).astype(np.uint64)
        wrong[rest] = (mine[start[rest] + k] ^ theirs[at[rest] + k]) << shift != 0
        rest = rest[~wrong[rest] & (size[rest] > k + 8)]
    mine, theirs = memoryview(np.ascontiguousarray(data)), memoryview(np.ascontiguousarray(other))
    for i in rest.tolist():
        wrong[i] = mine[start[i] : end[i]] != theirs[at[i] : at[i] + size[i]]
    return wrong


def _folded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``data`` with A-Z in lower case in chunks that are wholly ASCII.

    In others the tokenizer's own order matters: it composes a letter and a mark before it lower-cases, and not every
    small letter composes as its capital does.
    """
    high = np.concatenate([np.zeros(1, np.int64), np.cumsum(data > 127)])
    mixed = high[end] > high[start]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start[mixed]] += 1
    inside[end[mixed]] -= 1
    return np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, data, FOLD[data])


class Encoder:
    """encode(texts) gives (ids of all texts one after the other, number of ids of each)."""

    def __init__(self, path: str, most_chunks: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.kind = _kind(config)
        self.added = [t["content"] for t in config.get("added_tokens") or []]
        self.most_chunks = most_chunks
        self.between = self._separator()
        self._forget()

    def _forget(self) -> None:
        self.code: dict[int, int] = {}
        self.bytes, self.place = np.zeros(1 << 16, np.uint8), np.zeros(1, np.int64)  # the chunks themselves, and where each begins
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)

    def _separator(self) -> tuple[str, int, re.Pattern] | None:
        """(text between chunks, its only id, chunks that can't stand beside it): many chunks then go as one text."""
        for mark, between in {"bytes": (("\n", "\n"),), "words": tuple((c, f" {c} ") for c in "§©¤¶±")}.get(self.kind, ()):
            ids = self.tokenizer.encode(between, add_special_tokens=False).ids
            if len(ids) == 1:
                return between, ids[0], re.compile(rf"{re.escape(mark)}|  | $" if self.kind == "bytes" else re.escape(mark))
        return None

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        part = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, part), np.int32, len(part))
        return np.fromiter(chain.from_iterable(part), np.uint32, int(size.sum())), size

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        between, mark, _ = self.between
        size, kept = [], []
        for k in range(0, len(texts), 512):
            part = texts[k : k + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == mark)
            if len(cut) != len(part) - 1:
                ids, n = self._alone(part)
            else:
                n = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
                ids = np.delete(ids, cut)
            kept.append(ids)
            size.append(n)
        return np.concatenate(kept), np.concatenate(size)

    def _learn(self, keys: list[int], chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        apart = [self.between is None or bool(self.between[2].search(t)) for t in texts]
        for how, which in ((self._alone, True), (self._together, False)):
            mine = [i for i, x in enumerate(apart) if x is which]
            for k in range(0, len(mine), 20_000):
                part = mine[k : k + 20_000]
                ids, size = how([texts[i] for i in part])
                n, m = len(self.code), len(part)
                while n + m > len(self.start):
                    self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.resize(self.flat, 2 * len(self.flat))
                self.start[n : n + m] = self.used + np.cumsum(size) - size
                self.size[n : n + m] = size
                self.flat[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
                spelled = np.frombuffer(b"".join(chunks[i] for i in part), np.uint8)
                ends = self.place[-1] + np.cumsum([len(chunks[i]) for i in part])
                while ends[-1] > len(self.bytes):
                    self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
                self.bytes[self.place[-1] : ends[-1]] = spelled
                self.place = np.concatenate([self.place, ends])
                self.code.update(zip((keys[i] for i in part), range(n, n + m), strict=True))

    def _odd(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> set[int]:
        """Rows that go through the tokenizer whole."""
        if self.kind == "whole":
            return set(range(len(texts)))
        found = {i for t in self.added for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, t), False).to_numpy(zero_copy_only=False)).tolist()}
        if self.kind == "words":
            return found
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(_MAYBE_ODD[data]), "right") - 1)
        return found | {i for i in rows.tolist() if _ODD.search(texts[i].as_py())}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = raw(texts)
        odd = self._odd(texts, data, offsets)
        start, end = chunks(data, offsets, self.kind == "bytes")
        if len(self.code) > self.most_chunks:
            self._forget()
        data = _folded(data, start, end) if self.kind == "words" else data
        keys, first, which = np.unique(span_hashes(data, start, end, _SAME), return_index=True, return_inverse=True)
        wrong = clashing(data, start, end, data, start[first[which]], (end - start)[first[which]])
        names = keys.tolist()
        codes = np.array([self.code.get(k, -1) for k in names], np.int64)
        known, unknown = np.flatnonzero(codes >= 0), np.flatnonzero(codes < 0)
        at = first[known]
        place = self.place[codes[known]]
        other = known[clashing(data, start[at], end[at], self.bytes, place, self.place[codes[known] + 1] - place)]
        if len(other):
            wrong |= np.isin(which, other)
        odd |= set((np.searchsorted(offsets, start[wrong], "right") - 1).tolist())
        if len(unknown):
            view = memoryview(np.ascontiguousarray(data))
            at = first[unknown]
            missing = [names[i] for i in unknown.tolist()]
            self._learn(missing, [bytes(view[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            codes[unknown] = [self.code[k] for k in missing]
        codes = codes[which]
        size = self.size[codes].astype(np.int64)
        done = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[codes] - done[:-1], size) + np.arange(done[-1])]
        lengths = np.diff(done[np.searchsorted(start, offsets)])
        if odd:
            ends = np.cumsum(lengths)
            parts = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            for i in odd:
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py() or "", add_special_tokens=False).ids, np.uint32)
            lengths = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, lengths


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file; a Python worker keeps it from task to task."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = Encoder(path)
    return _kept[path]


def slices(sizes: Sequence[int], most: int) -> list[tuple[int, int]]:
    """(start, end) of runs of rows of at most ``most`` bytes in all, or one row."""
    out, lo, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            out.append((lo, i))
            lo, total = i, 0
        total += n
    return [*out, (lo, len(sizes))] if len(sizes) > lo else out
