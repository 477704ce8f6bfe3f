"""Periodic runs of words: stretches that repeat with some period, found by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q, at least max(``least``, 2q) words long, that no word
beside it extends. A text's words are appended to a suffix automaton; the states of the text's prefixes then take the
automaton's suffix links, as a tree, through link-cut accesses, one for each word in turn. An access to the state of
the prefix that ends at word i recolours its path to the root; the path falls into segments that earlier accesses
coloured, and a segment of colour e that reaches length m says that the last m words before i, and no more, were last
seen ending at word e. Where d = i - e is at most m, a square of period d ends at i, d is its smallest period, and it
starts m + d words back; it is extended to the right by comparing words. Accesses change O(log n) segments each
(amortised), so a text of n words costs O(n log^2 n) whatever it repeats.

Words that can't be part of a run never reach the automaton: every word of a run of twelve words or more stands in a
stretch of ``least // 2`` words that occurs twice within the run, so only the gapless stretches that such repeated
stretches cover are searched, each by itself. Those are found with hashes of whole batches; the automaton compares the
words themselves.

Defined results: a null or empty text, or one of blanks only, has no words, no runs and an empty collapsed text. A
null doc_id is kept, repeated rows give repeated results, extra columns are ignored, an empty table gives no rows. Very
long texts are searched whole; memory is about 150 bytes for each of their words that repeat nearby. The runs of a text
stand in the order of start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gazeframe.llm.common import bounded_batches
from gazeframe.llm.grams import SPACES, grams, mixed, raw, words

#: The fewest words of a run.
LEAST = 12


def suffix_automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(longest length of each state, suffix link of each state, state of each prefix); state 0 is the empty one.

    Most states have one transition only, which stands in two lists; states with more have a dictionary besides.
    """
    length, link, word, target = [0], [-1], [-1], [0]
    more: dict[int, dict[int, int]] = {}
    last, ends = 0, []
    for c in ids:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        word.append(-1)
        target.append(0)
        p, q = last, -1
        while p >= 0:
            first = word[p]
            if first == c:
                q = target[p]
                break
            if first < 0:
                word[p], target[p] = c, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {c: new}
                elif c in others:
                    q = others[c]
                    break
                else:
                    others[c] = new
            p = link[p]
        if p >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                word.append(word[q])
                target.append(target[q])
                if q in more:
                    more[copy] = dict(more[q])
                link[q] = link[new] = copy
                while p >= 0:
                    if word[p] == c:
                        if target[p] != q:
                            break
                        target[p] = copy
                    else:
                        others = more.get(p)
                        if others is None or others.get(c) != q:
                            break
                        others[c] = copy
                    p = link[p]
        last = new
        ends.append(new)
    return length, link, ends


def squares(ids: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, d, m) for each last square of each period that ends at place i: of period d, and m + d words repeat with it up to i.

    The suffix links are the tree; preferred paths are splay trees by depth, and the root of each has its path's colour.
    """
    length, parent, ends = suffix_automaton(ids)
    n = len(length)
    parent[0] = 0  # the empty state, numbered 0, is no node: its children have no parent
    left, right, colour = [0] * n, [0] * n, [-1] * n

    def splay(x: int) -> None:
        top = x
        while True:
            p = parent[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = parent[p]
            top = p
            if g and (left[g] == p or right[g] == p):
                top = g
                above = parent[g]
                if (left[g] == p) == (left[p] == x):
                    if left[p] == x:
                        b = left[g] = right[p]
                        if b:
                            parent[b] = g
                        right[p] = g
                        b = left[p] = right[x]
                        if b:
                            parent[b] = p
                        right[x] = p
                    else:
                        b = right[g] = left[p]
                        if b:
                            parent[b] = g
                        left[p] = g
                        b = right[p] = left[x]
                        if b:
                            parent[b] = p
                        left[x] = p
                    parent[g] = p
                    parent[p] = x
                else:
                    if left[p] == x:
                        b = left[p] = right[x]
                        if b:
                            parent[b] = p
                        right[x] = p
                        b = right[g] = left[x]
                        if b:
                            parent[b] = g
                        left[x] = g
                    else:
                        b = right[p] = left[x]
                        if b:
                            parent[b] = p
                        left[x] = p
                        b = left[g] = right[x]
                        if b:
                            parent[b] = g
                        right[x] = g
                    parent[p] = parent[g] = x
                parent[x] = above
                if above:
                    if left[above] == g:
                        left[above] = x
                    elif right[above] == g:
                        right[above] = x
            else:
                if left[p] == x:
                    b = left[p] = right[x]
                    if b:
                        parent[b] = p
                    right[x] = p
                else:
                    b = right[p] = left[x]
                    if b:
                        parent[b] = p
                    left[x] = p
                parent[p] = x
                parent[x] = g
        colour[x] = colour[top]

    for i, state in enumerate(ends):
        x, below = state, 0
        while x:
            p = parent[x]
            if p and (left[p] == x or right[p] == x):
                splay(x)
            e = colour[x]
            if e >= 0 and i - e <= length[x]:
                yield i, i - e, length[x]
            cut = right[x]
            if cut:
                colour[cut] = e
            right[x] = below
            below = x
            x = parent[x]
        colour[below] = i
        p = parent[state]
        if p and (left[p] == state or right[p] == state):
            splay(state)


def _reaches(ids: list[int], at: int, period: int) -> int:
    """The first place from ``at`` on whose word differs from the one ``period`` before, or the end."""
    n, step = len(ids), 8
    while at < n:
        if ids[at : at + step] == ids[at - period : min(at + step, n) - period]:
            at, step = at + step, 2 * step
        elif step == 1:
            return at
        else:
            step = max(1, step // 8)
    return n


def runs_of(ids: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence."""
    found, reached = [], {}
    for i, d, m in squares(ids):
        if reached.get(d, -1) >= i:  # two runs of one period share less than a period, so this square is of that run
            continue
        end = reached[d] = _reaches(ids, i + 1, d) - 1
        start = i - m - d + 1
        if end - start + 1 >= least:
            found.append((start, end - start + 1, d))
    return found


def repeated_stretches(value: np.ndarray, number: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of the stretches that hold all runs, by the hashes of all texts' words and each text's number of words.

    Each round keeps the stretches that n-grams cover which occur twice within one stretch of the round before.
    """
    n = max(1, least // 2)
    h, at, _ = grams(value, number, n, short=False)
    group = np.repeat(np.arange(len(number)), number)
    total = len(value)
    lo = hi = np.zeros(0, np.int64)
    before = total + 1
    while len(at):
        key = mixed(h ^ mixed(group[at].astype(np.uint64)))
        order = np.sort(key)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return lo[:0], hi[:0]
        place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        again = twice[place] == key
        h, at = h[again], at[again]
        cover = np.bincount(at, minlength=total + 1) - np.bincount(at + n, minlength=total + 1)
        inside = np.cumsum(cover[:-1]) > 0
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1] | (group[1:] != group[:-1])
        lo = np.flatnonzero(fresh)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (group[1:] != group[:-1])
        hi = np.flatnonzero(last) + 1
        group = np.cumsum(fresh)  # each stretch is a group of its own from now on
        if inside.sum() >= before:
            break
        before = inside.sum()
    fits = hi - lo >= least
    return lo[fits], hi[fits]


def _batch(texts: pa.Array, least: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """(runs of each text, its words without those that repeat, joined by blanks)."""
    data, offsets = raw(texts)
    value, _, number = words(data, offsets, SPACES)
    lo, hi = repeated_stretches(value, number, least)
    first = np.cumsum(number) - number
    row = np.searchsorted(first, lo, "right") - 1
    # texts without words begin where the next one does; the last of equal firsts is the one that has the words
    whole = data.tobytes()
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(number))]
    stretches: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True):
        stretches.setdefault(r, []).append((a - int(first[r]), b - int(first[r])))
    collapsed = []
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own = whole[a:b].split()
        if r in stretches:
            for lo_, hi_ in stretches[r]:
                number_of: dict[bytes, int] = {}
                ids = [number_of.setdefault(w, len(number_of)) for w in own[lo_:hi_]]
                found[r] += [(lo_ + s, k, q) for s, k, q in runs_of(ids, least)]
            found[r].sort(key=lambda x: (x[0], x[2]))
            if found[r]:
                at, kept = 0, []
                for s, e in _united([(s + q, s + k) for s, k, q in found[r]]):
                    kept += own[at:s]
                    at = e
                own = [*kept, *own[at:]]
        collapsed.append(b" ".join(own))
    return found, collapsed


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans that neither meet nor overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: A run as a column.
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs: array of start, length and period, collapsed: the words that are no repetition, joined by blanks)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            found, collapsed = _batch(texts, least)
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 3)
            runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["doc_id", "runs", "collapsed"],
            )

    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(work, schema)
