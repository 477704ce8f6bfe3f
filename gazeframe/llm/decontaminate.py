"""Benchmark decontamination: rare words of the test items find passages of documents, which are then aligned.

A passage counts from a Smith-Waterman alignment score (words, as a share of a verbatim copy's) of 0.5 on. An alignment
that scores so much matches at least half of the item's words, within twice the item's length of text. Of the item's
rarest 60 % of words, by a first pass over all documents, it hence matches at least a tenth of the item's length.
The second pass looks up only these words (the seeds). Where enough of them stand close together, and the stretch could
score enough if each word that the item has were a match, it is aligned: all candidates of a segment at once. These
bounds follow from the score, so no passage is lost, however its words were changed; the counts only decide how much is
looked up.

Words are runs of letters and digits with A-Z in lower case; punctuation and white space don't matter.

The seeds are rare single words rather than longer n-grams, as an alignment of 0.5 need not keep any two words together.

Defined results: a null or empty text is clean; texts may be of any length. Items that are null or shorter than ``n`` words are
never reported. Equal scores: the smaller item_id is named. Repeated rows give repeated results. Extra columns are
ignored. Without documents there are no rows; without items every document is clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.common import bounded_batches, map_whole_rows, written
from gazeframe.llm.grams import PUNCTUATION, raw, words
from gazeframe.llm.jaccard import _pieces as pieces

#: Items of fewer words are not looked for.
N = 3
THRESHOLD = 0.5
#: Items of a block, and bytes of their texts unless it is one item: what is broadcast for it stays small however many items there are.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20
#: Blocks that one pass over the documents looks for.
BLOCKS_AT_ONCE = 4
MATCH, MISS, GAP = 2, 1, 1
CELLS = 1 << 20
#: Share of an item's words that are seeds at least (above 1 - THRESHOLD), and the look-ups of a text that are held at once.
SEEDS = 0.6
HELD = 1 << 22
_TABLE = 1 << 22


class Items:
    """Word hashes of a block of items, and an index of words to the items of ``n`` words or more that have them."""

    def __init__(self, names: list[int], value: np.ndarray, number: np.ndarray, n: int):
        self.names, self.value, self.number = np.array(names, np.int64), value, number
        self.first = np.cumsum(number) - number
        self.unique, of = np.unique(value, return_inverse=True)
        item = np.repeat(np.arange(len(names)), number)
        pair, self.times = np.unique(item[number[item] >= n] * max(1, len(self.unique)) + of[number[item] >= n], return_counts=True)
        self.pair = pair
        self.item, self.of = pair // max(1, len(self.unique)), pair % max(1, len(self.unique))
        self.need = np.ones(len(names), np.int64)
        self._index(np.ones(len(pair), bool))

    def _index(self, keep: np.ndarray) -> None:
        kept = np.flatnonzero(keep)
        kept = kept[np.argsort(self.of[kept], kind="stable")]
        self.entries = kept
        self.lo = np.searchsorted(self.of[kept], np.arange(len(self.unique)))
        self.hi = np.searchsorted(self.of[kept], np.arange(len(self.unique)), "right")
        self.table = np.zeros(_TABLE, bool)
        self.table[_slots(self.unique[self.hi > self.lo])] = True

    def seeds(self, counts: np.ndarray, threshold: float) -> None:
        """Keeps each item's rarest words as seeds, and sets how many of them a passage must hold. counts: by ``unique``."""
        least = np.maximum(1, np.ceil(threshold * self.number - 1e-9).astype(np.int64))  # words that a passage matches
        want = np.maximum(np.ceil(SEEDS * self.number).astype(np.int64), self.number - least + 1)
        order = np.lexsort((self.of, counts[self.of], self.item))
        before = np.cumsum(self.times[order]) - self.times[order]
        before -= before[np.searchsorted(self.item[order], self.item[order])]
        keep = np.zeros(len(self.item), bool)
        keep[order] = before < want[self.item[order]]
        held = np.bincount(self.item[keep], self.times[keep], len(self.names)).astype(np.int64)
        self.need = np.maximum(1, least - (self.number - held))
        self.least = MATCH * threshold * self.number  # the score of a passage
        self.reach = np.ceil((3 - 2 * threshold) * self.number).astype(np.int64)  # words of text that a passage spans at most
        self._index(keep)

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``word`` that have seeds, their numbers in ``unique``)."""
        if not len(self.unique):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.table[_slots(word)])
        k = np.minimum(np.searchsorted(self.unique, word[maybe]), len(self.unique) - 1)
        hit = (self.unique[k] == word[maybe]) & (self.hi[k] > self.lo[k])
        return maybe[hit], k[hit]


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """Smith-Waterman over words for each (item, passage): (best score, end in the passage, matches are MATCH each).

    One row of all matrices at a time; gaps along the passage come from a running maximum.
    """
    out = []
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    results: dict[int, tuple[int, int, int]] = {}
    at = 0
    while at < len(order):
        end, width = at, 0
        while end < len(order):
            w = max(width, len(pairs[order[end]][1]))
            if end > at and w * (end + 1 - at) > CELLS:
                break
            end, width = end + 1, w
        mine = [pairs[k] for k in order[at:end]]
        longest = max(len(a) for a, _ in mine)
        text = np.zeros((len(mine), width), np.uint64)
        mask = np.zeros((len(mine), width), bool)
        item = np.zeros((len(mine), longest), np.uint64)
        there = np.zeros((len(mine), longest), bool)
        for i, (a, b) in enumerate(mine):
            text[i, : len(b)], mask[i, : len(b)] = b, True
            item[i, : len(a)], there[i, : len(a)] = a, True
        ramp = np.arange(width, dtype=np.int32) * GAP
        h = np.zeros((len(mine), width + 1), np.int32)
        best, where = np.zeros(len(mine), np.int32), np.zeros(len(mine), np.int64)
        for r in range(longest):
            same = (text == item[:, r : r + 1]) & mask & there[:, r : r + 1]
            now = np.maximum(h[:, :-1] + np.where(same, MATCH, -MISS), h[:, 1:] - GAP)
            now = np.maximum(np.maximum.accumulate(np.maximum(now, 0) + ramp, axis=1) - ramp, 0)
            h[:, 1:] = np.where(there[:, r : r + 1], now, 0)
            top = h[:, 1:].max(axis=1)
            better = top > best
            if better.any():
                where[better] = h[better, 1:].argmax(axis=1) + 1
                best = np.maximum(best, top)
        for i, k in enumerate(order[at:end]):
            results[k] = (int(best[i]), int(where[i]), longest)
        at = end
    for k in range(len(pairs)):
        out.append(results[k])
    return out


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The items, at most about BLOCK_ITEMS and BLOCK_BYTES at a time."""
    items = written(items.select("item_id", "text").where("text is not null and item_id is not null"), "items")
    count, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n = max(1, -(-count // BLOCK_ITEMS), -(-(size or 0) // BLOCK_BYTES))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def _load(block: DataFrame, n: int) -> Items:
    rows = block.orderBy("item_id", "text").toArrow()
    value, _, number = words(*raw(rows.column("text").combine_chunks().cast(pa.string())), PUNCTUATION) if rows.num_rows else (np.zeros(0, np.uint64), None, np.zeros(0, np.int64))
    return Items(rows.column("item_id").to_pylist(), value, number, n)


def _slots(word: np.ndarray) -> np.ndarray:
    return (word & np.uint64(_TABLE - 1)).astype(np.int64)


def corpus_counts(docs: DataFrame, blocks: list[DataFrame], n: int) -> DataFrame:
    """(word, n): how often words of the items, and a few others, occur in all documents; one pass for all blocks."""
    table = np.zeros(_TABLE, bool)
    for block in blocks:
        table[_slots(_load(block, n).unique)] = True
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        word, of = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return word, np.bincount(of, np.concatenate([c for _, c in held]), len(word)).astype(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in pieces(batch):
                word = words(*raw(part.column(1)), PUNCTUATION)[0]
                held.append(np.unique(word[shared.value[_slots(word)]], return_counts=True))
            if len(held) > 64:
                held = [merged(held)]
            if held and len(held[0][0]) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["word", "n"])
                held = held[1:]
        if held:
            word, count = merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], ["word", "n"])

    found = docs.select("doc_id", "text").mapInArrow(work, "word long, n long")
    return written(found.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _block_counts(counts: DataFrame, block: DataFrame, items: Items) -> np.ndarray:
    """The counts of the block's words, by ``items.unique``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words(*raw(batch.column(0)), PUNCTUATION)[0]).view(np.int64))], ["word"])

    own = block.select("text").mapInArrow(work, "word long").distinct()
    found = counts.join(own, "word").toArrow()  # at most one row for each word of the block
    out = np.zeros(len(items.unique), np.int64)
    out[np.searchsorted(items.unique, found.column("word").to_numpy().view(np.uint64))] = found.column("n").to_numpy()
    return out


def passages(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Every row's doc_id and hits: (item_id, score, start, end) by words, with all items that score ``threshold`` or more."""
    docs = bounded_batches(docs).select("doc_id", "text", F.array().cast(HITS).alias("hits"))
    for k, shared in enumerate(_shared(docs, items, n, threshold), 1):
        docs = docs.mapInArrow(_search(shared, None), f"doc_id long, text string, hits {HITS}")
        docs = written(docs, "passages") if k % BLOCKS_AT_ONCE == 0 else docs
    return docs.select("doc_id", "hits")


def _shared(docs: DataFrame, items: DataFrame, n: int, threshold: float) -> list:
    """The blocks of items with their seeds, as broadcast."""
    blocks = _blocks(items)
    counts = corpus_counts(docs, blocks, n)
    out = []
    for block in blocks:
        held = _load(block, n)
        held.seeds(_block_counts(counts, block, held), threshold)
        out.append(docs.sparkSession.sparkContext.broadcast(held))
    return out


HITS = "array<struct<item_id: long, score: double, start: long, end: long>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def _close(items: Items, row: np.ndarray, place: np.ndarray, item: np.ndarray) -> list[np.ndarray]:
    """(row, item, first, end) of the stretches that can hold a passage, from all seeds (by row and place) of these rows."""
    order = np.lexsort((place, item, row))
    row, place, item = row[order], place[order], item[order]
    last = np.arange(len(row)) + items.need[item] - 1
    at = np.flatnonzero(last < len(row))
    last = last[at]
    enough = (row[last] == row[at]) & (item[last] == item[at]) & (place[last] - place[at] < items.reach[item[at]])
    at, last = at[enough], last[enough]
    row, item, reach = row[at], item[at], items.reach[item[at]]
    lo, hi = place[last] - reach + 1, place[at] + reach
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
    begin = np.flatnonzero(new)
    return [row[begin], item[begin], lo[begin], hi[np.append(begin[1:], len(at)) - 1] if len(at) else hi]


def _stretches(items: Items, value: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
    """``_close`` for all texts, with at most about HELD look-ups at once."""
    place, k = items.find(value)
    row = np.searchsorted(np.cumsum(number), place, "right")
    times = items.hi[k] - items.lo[k]
    total = np.cumsum(times)
    found = [_close(items, *[np.zeros(0, np.int64)] * 3)]
    lo = 0
    while lo < len(place):
        before = total[lo - 1] if lo else 0
        hi = int(np.searchsorted(total, before + HELD, "right"))
        hi = hi if hi == len(place) else int(np.searchsorted(row, row[min(hi, len(place) - 1)]))  # whole rows
        hi = hi if hi > lo else int(np.searchsorted(row, row[lo], "right"))
        groups = max(1, -(-int(total[hi - 1] - before) // HELD))  # of items, for a row that is too large
        for g in range(groups):
            rows, places, mine = [], [], []
            at = lo
            while at < hi:
                end = min(hi, max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD, "right"))))
                t = times[at:end]
                entry = items.entries[np.repeat(items.lo[k[at:end]] - np.cumsum(t) + t, t) + np.arange(t.sum())]
                item, where = items.item[entry], np.repeat(np.arange(at, end), t)
                if groups > 1:
                    item, where = item[item % groups == g], where[item % groups == g]
                rows.append(row[where])
                places.append(place[where])
                mine.append(item)
                at = end
            found.append(_close(items, np.concatenate(rows), np.concatenate(places), np.concatenate(mine)))
        lo = hi
    return [np.concatenate(column) for column in zip(*found, strict=True)]


def _worth(items: Items, value: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which stretches ``value[lo:hi]`` can score enough: the most that any part gets if each word the item has is a match."""
    out = np.zeros(len(item), bool)
    size = hi - lo
    total = np.cumsum(size)
    at = 0
    while at < len(item):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD, "right")))
        n = size[at:end]
        start = np.cumsum(n) - n
        word = value[np.repeat(lo[at:end] - start, n) + np.arange(n.sum())]
        of = np.minimum(np.searchsorted(items.unique, word), len(items.unique) - 1)
        key = np.repeat(item[at:end], n) * len(items.unique) + of
        there = (items.unique[of] == word) & (items.pair[np.minimum(np.searchsorted(items.pair, key), len(items.pair) - 1)] == key)
        after = np.cumsum(np.where(there, MATCH, -min(MISS, GAP)))
        before = after - np.where(there, MATCH, -min(MISS, GAP))
        fall = np.repeat(np.arange(len(n)), n) * (4 * MATCH * (len(word) + 1))  # keeps a minimum from entering the next stretch
        most = after - (np.minimum.accumulate(before - fall) + fall)
        out[at:end] = np.maximum.reduceat(most, start) >= items.least[item[at:end]] - 1e-9
        at = end
    return out


def _hits(items: Items, texts: pa.Array) -> list[list[dict]]:
    """For each text, the items that it can hold a passage of, and the best alignment with each."""
    value, _, number = words(*raw(texts), PUNCTUATION)
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    row, item, lo, hi = _stretches(items, value, number)
    if not len(row):
        return found
    first = np.cumsum(number) - number
    lo, hi = np.maximum(lo, first[row]), np.minimum(hi, first[row] + number[row])
    worth = _worth(items, value, item, lo, hi)
    row, item, lo, hi = row[worth], item[worth], (lo - first[row])[worth], (hi - first[row])[worth]
    pairs, spans = [], []
    for r, i, a, b in zip(row.tolist(), item.tolist(), lo.tolist(), hi.tolist(), strict=True):
        f = int(items.first[i])
        pairs.append((items.value[f : f + int(items.number[i])], value[int(first[r]) + a : int(first[r]) + b]))
        spans.append((r, i, a))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for (r, i, a), (score, stop, _), (words_, _) in zip(spans, align(pairs), pairs, strict=True):
        got = (score / (MATCH * len(words_)), -(a + stop), a)
        if (r, i) not in best or got > best[r, i]:
            best[r, i] = got
    for (r, i), (score, stop, _) in best.items():
        found[r].append({"item_id": int(items.names[i]), "score": score, "start": max(0, -stop - int(items.number[i])), "end": -stop})
    return found


def _search(shared, keep_under: float | None, at: int = 1):
    """A task over documents, whose texts are in column ``at``. With ``keep_under``, the rows whose best score is below it; else all, with hits added."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            lo = 0
            for part in pieces(pa.RecordBatch.from_arrays([texts, texts], ["doc_id", "text"])):
                found = _hits(shared.value, part.column(1))
                mine = batch.slice(lo, len(part))
                lo += len(part)
                if keep_under is None:
                    all_hits = [[*a, *b] for a, b in zip(mine.column(2).to_pylist(), found, strict=True)]
                    yield pa.RecordBatch.from_arrays([mine.column(0).cast(pa.int64()), mine.column(1), pa.array(all_hits, _HITS)], ["doc_id", "text", "hits"])
                else:
                    yield mine.filter(pa.array([all(h["score"] < keep_under for h in hits) for hits in found], pa.bool_()))

    return work


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """Per document: doc_id, contaminated, item_id and score of the best item from the threshold on, item_ids of all of them."""
    leaks = F.filter("hits", lambda h: h.score >= threshold)
    ranked = F.array_sort(F.transform("leaks", lambda h: F.struct((-h.score).alias("minus"), h.item_id.alias("item_id"))))
    best = F.try_element_at(ranked, F.lit(1))
    return (
        passages(docs, items, n, threshold)
        .select("doc_id", leaks.alias("leaks"))
        .select(
            "doc_id",
            (F.size("leaks") > 0).alias("contaminated"),
            best.item_id.alias("item_id"),
            F.round(-best.minus, 6).alias("score"),
            F.array_sort(F.transform("leaks", lambda h: h.item_id)).alias("item_ids"),
        )
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no passage of an item."""
    for k, shared in enumerate(_shared(bounded_batches(docs), items, n, threshold), 1):
        docs = map_whole_rows(docs, _search(shared, threshold, docs.columns.index("text")))
        docs = written(docs, "clean") if k % BLOCKS_AT_ONCE == 0 else docs
    return docs
