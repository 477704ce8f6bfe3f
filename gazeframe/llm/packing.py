"""Packing: documents' token ids are cut into pieces that fill sequences of a fixed window with little padding.

Each document fills whole windows by itself; what is left of it (shorter than a window) is a remainder. The histogram
of remainders is small (one count for each length). Shallow combinations of lengths that fill a window exactly are
enumerated, non-negative least squares finds how often to use each, and rounded down these counts make a plan. The
plan says of the r-th remainder of each length which sequence and place it gets; ranks come from counts by file
partition, so that no length gathers in one task. Remainders beyond the plan are packed greedily within each
partition, one after the other, and cut at the window's end.

Sequence ids: 4 * n for windows of one document, 4 * n + 1 for combinations, 4 * n + 2 for the greedy rest.

Defined results: a null text is an empty document, which has its end id only. A null doc_id and repeated rows are packed
like any other row. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.common import bounded_batches, written
from gazeframe.llm.token_ids import encoder, slices

WINDOW = 1024
#: Combinations of two lengths are all taken; of three, those whose lengths are in the first so many by count.
TRIPLE_LENGTHS = 48
ROUNDS = 300


def combinations(histogram: np.ndarray, triple_lengths: int = TRIPLE_LENGTHS) -> list[tuple[int, ...]]:
    """Multisets of two or three lengths that fill the window. histogram[n]: remainders of length n; its size is the window's."""
    window = len(histogram)
    there = histogram > 0
    found = {(a, window - a) for a in range(1, window // 2 + 1) if there[a] and there[window - a]}
    common = sorted(np.argsort(-histogram, kind="stable")[:triple_lengths].tolist())
    common = [a for a in common if there[a]]
    for i, a in enumerate(common):
        for b in common[i:]:
            c = window - a - b
            if c > 0 and there[c]:
                found.add(tuple(sorted((a, b, c))))
    return sorted(found)


def solve(histogram: np.ndarray, combos: list[tuple[int, ...]], rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: x >= 0 that minimises |A x - histogram|, A[n, k] being how often length n is in combination k.

    Projected gradient steps with momentum; A is sparse and used by its entries.
    """
    k = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    n = np.array([a for c in combos for a in c], np.int64)
    if not len(combos):
        return np.zeros(0)
    rows = np.bincount(n, minlength=len(histogram))
    step = 1.0 / max(1.0, float(rows[n].max()) * 3)  # at least the inverse of A's largest squared singular value
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        short = np.bincount(n, weights=y[k], minlength=len(histogram)) - histogram
        new = np.maximum(0.0, y - step * np.bincount(k, weights=short[n], minlength=len(combos)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(histogram: np.ndarray, combos: list[tuple[int, ...]], x: np.ndarray) -> np.ndarray:
    """Whole repeat counts that use no length more often than it occurs: rounded down, then raised while there is stock."""
    left = histogram.astype(np.int64).copy()
    counts = np.zeros(len(combos), np.int64)
    for raise_to in (np.floor(x), np.ceil(x), np.full(len(combos), np.inf)):
        for k in np.argsort(-x, kind="stable").tolist():
            lengths, need = np.unique(combos[k], return_counts=True)
            more = int(min(raise_to[k] - counts[k], (left[lengths] // need).min()))
            if more > 0:
                counts[k] += more
                left[lengths] -= more * need
    return counts


def plan(histogram: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, (first rank, ranks, first sequence, place in it), in the order of ranks; ranks beyond are the rest."""
    combos = combinations(histogram)
    counts = rounded(histogram, combos, solve(histogram, combos))
    out: dict[int, list] = {}
    used = np.zeros(len(histogram), np.int64)
    first = 0
    for combo, times in zip(combos, counts.tolist(), strict=True):
        if times:
            place = 0
            for n in combo:
                out.setdefault(n, []).append((int(used[n]), times, first, place))
                used[n] += times
                place += n
            first += times
    return out


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, part, rest, nth, doc_tokens, ids) written to the shared folder.

    ids: little-endian, four bytes each. rest: length of the remainder. nth: how many rows of
    the same partition and rest come before.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer)
        seen = np.zeros(window, np.int64)
        row = part << 33
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for lo, hi in slices(pc.binary_length(texts).to_pylist(), 1 << 20):
                flat, n = coder.encode(texts.slice(lo, hi - lo))
                flat = np.insert(flat, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                rest = n % window
                order = np.argsort(rest, kind="stable")
                start = np.searchsorted(rest[order], rest[order])
                nth = np.empty(len(n), np.int64)
                nth[order] = np.arange(len(n)) - start + seen[rest[order]]
                seen += np.bincount(rest, minlength=window)
                ends = np.cumsum(n) * 4
                raw = flat.tobytes()
                ids = [raw[a:b] for a, b in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True)]
                rows = row + np.arange(len(n))
                row += len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(np.full(len(n), part)), pa.array(rest), pa.array(nth), pa.array(n), pa.array(ids, pa.binary())],
                    ["row", "doc_id", "part", "rest", "nth", "doc_tokens", "ids"],
                )

    kind = "row long, doc_id long, part long, rest long, nth long, doc_tokens long, ids binary"
    return written(docs.select("doc_id", "text").mapInArrow(work, kind), "packing-tokens")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every piece; ids are little-endian 32-bit."""
    held = tokenized(bounded_batches(docs), tokenizer, end_id, window)
    light = held.select("row", "part", "rest", "nth").where("rest > 0")
    counts = light.groupBy("rest", "part").agg(F.count(F.lit(1)).alias("n"))
    before = written(
        counts.withColumn("before", F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n")), "packing-counts"
    )
    histogram = np.zeros(window, np.int64)
    for r in before.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most one row for each length in the window
        histogram[r["rest"]] = r["n"]
    places = plan(histogram)
    lookup = {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in places.items()}
    planned = {n: int(first[-1] + times[-1]) for n, (first, times, _, _) in lookup.items()}
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast((lookup, planned))  # bounded by the window, not by the data

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, planned = table.value
        for batch in batches:
            rest, rank = (batch.column(k).to_numpy() for k in (1, 2))
            sequence, offset = np.full(len(rest), -1), np.zeros(len(rest), np.int64)
            for n in np.unique(rest).tolist():
                mine = np.flatnonzero((rest == n) & (rank < planned.get(n, 0)))
                if len(mine):
                    first, _, base, place = lookup[n]
                    k = np.searchsorted(first, rank[mine], "right") - 1
                    sequence[mine] = 4 * (base[k] + rank[mine] - first[k]) + 1
                    offset[mine] = place[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(offset)], ["row", "sequence_id", "offset"])

    ranked = light.join(before.select("rest", "part", "before"), ["rest", "part"]).select("row", "rest", (F.col("nth") + F.col("before")).alias("rank"))
    assigned = ranked.mapInArrow(assign, "row long, sequence_id long, offset long")
    both = held.select("row", "doc_id", "doc_tokens", "ids").join(assigned, "row", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own, rest_at = 0, 0  # windows of single documents, and ids of the greedy rest, so far in this task
        base = part << 36
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            out: list[list] = [[] for _ in names]

            def put(row, start, length, sequence, offset, out=out):
                doc_id, n, ids = row
                for c, v in zip(out, (doc_id, start, length, n, sequence, offset, ids[4 * start : 4 * (start + length)]), strict=True):
                    c.append(v)

            for doc_id, n, ids, sequence, offset in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                row = (doc_id, n, ids)
                whole = n // window
                for k in range(whole):
                    put(row, k * window, window, 4 * (base + own), 0)
                    own += 1
                start, left = whole * window, n % window
                if left and sequence is not None and sequence >= 0:
                    put(row, start, left, sequence, offset)
                    continue
                while left:
                    room = min(left, window - rest_at % window)
                    put(row, start, room, 4 * (base + rest_at // window) + 2, rest_at % window)
                    start, left, rest_at = start + room, left - room, rest_at + room
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())], names)

    # the greedy rest follows the order of rows, which a shuffle that is fetched again doesn't keep
    return both.sortWithinPartitions("row").drop("row").mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
