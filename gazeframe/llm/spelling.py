"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by pivotal grams.

``vocabulary`` counts the words of whole texts; ``near_pairs`` finds all pairs at an edit distance of one; ``group``
leads every word to the most frequent of its near words, if that is ``ratio`` times as frequent, and on to the root.

Grams are bigrams in the order of how many places of the vocabulary have them, rarest first. A word's prefix are its
three rarest places, with all other places of those grams. Among them two that don't overlap are its pivots, chosen by dynamic
programming for the least sum of frequencies. One edit spares one of the two pivots at least, and that one is in the
other word's prefix if the last gram of that prefix does not come earlier than the last of this one. So pivots are
joined with the other words' prefixes. The edit is then wholly before or wholly behind the shared gram: either all
up to the gram's end is equal in both words, hence its place from the start, or all from the gram on, hence its place
from the end; and of the side that holds the edit one half is equal. The join is on those equal parts, which limits
positions, and on the length; what it finds is verified by edit distance. So no key holds more than the words of one
length that share a gram, its place, all of one side of it and half of the other.

Joins are by merging, as no side of one is small: Spark takes a table of words by its compressed files, and the keys of
words, a dozen rows a word with the word in each, for little more than the words, and would broadcast either.

Defined results: null texts have no words; rows with a null doc_id count like others; repeated rows count as often as
they stand there; extra columns are ignored; an empty table, or one without words that are long and frequent enough,
gives no rows. Very long texts are read whole. Of near words equal in number the smallest in code point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from gazeframe.llm.common import bounded_batches, written

#: Letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
#: Different words that a task counts before it hands the counts on.
MOST_COUNTED = 200_000
#: Grams are counted by hash in so many buckets; grams of one bucket count as one gram, which loses no pair.
BUCKETS = 1 << 16


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, alter: Callable[[object, str, int], str] | None = None, shortest: int | None = None) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, of ``least_length`` code points or more, and how often all texts hold them.

    ``alter(seed, word, doc)`` may change a document's word before it is counted (``seed``: crc32 of the doc_id and a colon);
    words of at least ``shortest`` code points, by default ``least_length``, are passed to it.
    """
    shortest = least_length if shortest is None else shortest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first match from the start of a run takes all of it, so matches are maximal runs
        runs = re.compile(f"[{LETTERS}]{{{max(1, shortest)},}}")
        total: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                found = Counter(runs.findall(text.as_py().encode().lower().decode()))  # bytes know of A-Z only
                if alter is None:
                    total.update(found)
                else:
                    seed = zlib.crc32(f"{doc}:".encode())
                    for word, n in found.items():
                        total[alter(seed, word, doc)] += n
                if len(total) > MOST_COUNTED:
                    yield _counts(total, least_length)
                    total.clear()
        if total:
            yield _counts(total, least_length)

    counted = bounded_batches(docs).select("doc_id", "text").mapInArrow(work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counts(total: Counter, least_length: int) -> pa.RecordBatch:
    kept = {w: n for w, n in total.items() if len(w) >= least_length}
    return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS


def _gram_counts(words: DataFrame) -> dict[int, int]:
    """How many places have the grams of each bucket: at most BUCKETS rows, whatever the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Counter[str] = Counter()
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for w in batch.column(0).to_pylist():
                grams.update(map("".join, zip(w, w[1:], strict=False)))
            if len(grams) > BUCKETS:
                for g, n in grams.items():
                    total[_bucket(g)] += n
                grams.clear()
        for g, n in grams.items():
            total[_bucket(g)] += n
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    got = words.select("word").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(got.column("bucket").to_pylist(), got.column("n").to_pylist(), strict=True))


def prefix_and_pivots(ranks: list[int], weights: list[int]) -> tuple[list[int], tuple[int, int]]:
    """(places of the prefix in ascending order, the two pivots) of a word whose grams have these ranks and weights, place by place."""
    third = sorted(ranks)[2]
    prefix = [i for i, r in enumerate(ranks) if r <= third]
    # for each place: the lightest pair that ends with it; ``lightest`` is the best single place two or more before
    best, pair, lightest, behind = None, (prefix[0], prefix[-1]), None, 0
    for p in prefix:
        while prefix[behind] <= p - 2:
            if lightest is None or weights[prefix[behind]] < weights[lightest]:
                lightest = prefix[behind]
            behind += 1
        if lightest is not None and (best is None or weights[lightest] + weights[p] < best):
            best, pair = weights[lightest] + weights[p], (lightest, p)
    return prefix, pair


def _equal_parts(word: str, place: int, size: int) -> Iterator[str]:
    """What ``word`` and a near word of ``size`` code points have equal, if they share the gram at ``place`` and the edit spares it.

    Behind the gram or before it: that side is R long in the word of ``size``; of either word's side the first or the
    last R // 2 code points are equal, since one edit can't touch both.
    """
    n = len(word)
    if (half := (size - place - 2) // 2) > 0:
        rest = word[place + 2 :]
        yield f"<{size} {word[: place + 2]} {rest[:half]}"
        yield f"<{size} {word[: place + 2]}  {rest[-half:]}"
    elif size > place + 1:
        yield f"<{size} {word[: place + 2]} "
    at = place + size - n  # the gram's place in the other word, if both are as far from the end
    if (half := at // 2) > 0:
        rest = word[:place]
        yield f">{size} {word[place:]} {rest[:half]}"
        yield f">{size} {word[place:]}  {rest[len(rest) - half :]}"
    elif at >= 0:
        yield f">{size} {word[place:]} "


def _keys(words: DataFrame, order: dict[int, tuple[int, int]], pivots: bool) -> DataFrame:
    """For every pivot, or every place of the prefix, of a word: hashes of what it and a near word have equal."""
    shared = words.sparkSession.sparkContext.broadcast(order)  # at most BUCKETS grams

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        order = shared.value
        for batch in batches:
            for k in range(0, len(batch), 10_000):
                part = batch.slice(k, 10_000)
                keys, last, row = [], [], []
                for at, w in enumerate(part.column(0).to_pylist()):
                    grams = list(map("".join, zip(w, w[1:], strict=False)))
                    for g in grams:
                        if g not in known:
                            if len(known) > BUCKETS:
                                known.clear()
                            known[g] = order[_bucket(g)]
                    ranks, weights = zip(*[known.get(g) or order[_bucket(g)] for g in grams], strict=True)
                    prefix, pair = prefix_and_pivots(ranks, weights)
                    n, before = len(w), len(keys)
                    for p in pair if pivots else prefix:
                        for size in (n - 1, n, n + 1) if pivots else (n,):
                            keys += map(xxh3_64_intdigest, _equal_parts(w, p, size))
                    last += [max([ranks[p] for p in prefix])] * (len(keys) - before)
                    row += [at] * (len(keys) - before)
                mine = part.take(pa.array(row, pa.int64()))
                hashes = np.array(keys, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(last, pa.int32()), *mine.columns], ["key", "last", "word", "n"])

    return words.select("word", "n").mapInArrow(work, "key long, last int, word string, n long")


def _merged(df: DataFrame) -> DataFrame:
    """``df``, which a join is to shuffle, never to broadcast, whatever its estimated size."""
    return df.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, for all pairs of ``words`` (word, n) at an edit distance of one; words are different and have 4 code points or more."""
    counts = _gram_counts(words)
    order = {b: (r, n) for r, (b, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0])))}
    a = _keys(words, order, True).toDF("key", "last_a", "word", "n")
    b = _keys(words, order, False).toDF("key", "last_b", "near", "near_n")
    found = a.join(_merged(b), "key").where("last_a <= last_b and levenshtein(word, near, 1) = 1")
    one = F.struct("word", "near", "near_n")
    other = F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.select(F.explode(F.array(one, other)).alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): from each word on to its form, the form's form and so on, by doubling steps.

    Each form is at least twice as frequent as its word, so chains are at most 62 long and six rounds are enough.
    """
    step = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not step.join(_merged(on), "root", "left_semi").take(1):
            return step
        step = written(step.join(_merged(on), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def group(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n): form is the most frequent near word, if it is ``ratio`` (2 or more) times as frequent."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    words = written(words.select("word", "n"), "vocabulary")
    near = near_pairs(words).repartition("word").dropDuplicates(["word", "near"])
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = written(
        best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")),
        "near",
    )
    leads = F.col("near_n") >= ratio * F.col("n")
    judged = words.join(_merged(best), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("near")).alias("form"), F.when(leads, F.col("near_n")).alias("form_n")
    )
    judged = written(judged, "forms")
    return judged.join(_merged(roots(judged.where("form is not null"))), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
