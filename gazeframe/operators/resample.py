"""Resampling on counts: replicates reweight cells, so their cost doesn't depend on the number of items.

Draws come from md5 of (seed, replicate, draw), so they are the same on any partitioning and all systems share them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.functions.hashing import md5_int, md5_ints, md5_rank
from gazeframe.operators import draws
from gazeframe.operators.agreement import METRICS, confusion, label_total, metrics, truth_total
from gazeframe.schema import LABELS
from gazeframe.sources.shared import stored

#: Items of a system that a task may hold to shuffle them in memory, at about 10 bytes each; of one packed row; sorted at once.
MOST_HELD = 1 << 26
PACKED = 1 << 17
SORTED = 1 << 22
#: A system's replicates are dealt to so many tasks at least; each gets all its items, at two to three bytes each.
SHARES = 16
#: Different labels and combinations of columns that are packed as numbers.
MOST_KINDS, MOST_CODES = 250, 1 << 20


def cluster_draws(clusters: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(rep, cluster, w): how often each replicate drew each cluster; G draws with replacement of G clusters.

    ``clusters``: (cluster), one row for each. The number of clusters is small (they are the study's channels); their
    sorted list travels with each row of the replicate grid.
    """
    spark = clusters.sparkSession
    names = clusters.select("cluster").distinct().agg(F.array_sort(F.collect_list("cluster")).alias("names"))
    reps = spark.range(replicates).withColumnRenamed("id", "rep")
    draws = reps.crossJoin(F.broadcast(names)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.size("names"))))
    pick = F.pmod(md5_int(seed, "rep", "draw"), F.size("names")).cast("int")
    return draws.select("rep", F.element_at("names", pick + 1).alias("cluster")).groupBy("rep", "cluster").agg(F.count(F.lit(1)).cast("double").alias("w"))


def cluster_replicates(cluster_cells: DataFrame, draws: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(rep, system, reference, n, metrics...) from ``cluster_cells`` (cluster, system, reference, truth, label, n) and the draws."""
    by = ["rep", "system", "reference"]
    weighed = cluster_cells.join(draws, "cluster").withColumn("n", F.col("n") * F.col("w")).drop("w")
    return metrics(confusion(weighed.groupBy(*by, "truth", "label").agg(F.sum("n").alias("n")), by), by, names)


def interval(value: str, level: float = 0.95) -> list[Column]:
    """Aggregates: lower and upper percentile, and how many replicates are undefined."""
    tail = (1 - level) / 2
    at = lambda q: F.expr(f"percentile({value}, {q!r})")
    return [at(tail).alias(f"{value}_lo"), at(1 - tail).alias(f"{value}_hi"), F.count_if(F.col(value).isNull()).alias(f"{value}_undefined")]


def paired_difference(replicates: DataFrame, base: str, value: str) -> DataFrame:
    """(system, reference, lo, hi, excludes_zero): each system's value minus the base system's, replicate by replicate."""
    b = replicates.where(F.col("system") == base).select("rep", "reference", F.col(value).alias("base"))
    d = replicates.where(F.col("system") != base).join(b, ["rep", "reference"]).withColumn("diff", F.col(value) - F.col("base"))
    out = d.groupBy("system", "reference").agg(*interval("diff"))
    return out.withColumn("excludes_zero", (F.col("diff_lo") > 0) | (F.col("diff_hi") < 0))


def dealt(reps: DataFrame, keys: list[str]) -> DataFrame:
    """Replicates over all cores: their rows are few bytes, which would be put together into one task if no number were given."""
    return reps.repartition(reps.sparkSession.sparkContext.defaultParallelism, *keys)


def item_replicates(cell_counts: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """(by..., rep, truth, label, n): resamples of items with replacement, drawn on the nine cells (truth, label) of each group.

    ``cell_counts``: (by..., truth, label, n). Metrics depend on the cells only, whose counts in a resample of n items are
    multinomial, so the cost is that of replicates, not of items. Cells that a replicate doesn't draw are there with n = 0.
    """
    kinds = [(t, y) for t in LABELS for y in LABELS]
    counts = [F.coalesce(F.sum(F.when((F.col("truth") == t) & (F.col("label") == y), F.col("n"))), F.lit(0)).cast("double") for t, y in kinds]
    groups = cell_counts.groupBy(*by).agg(F.array(*counts).alias("cells"))
    reps = dealt(groups.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))), [*by, "rep"])
    reps = reps.withColumn("u", draws.uniforms(lambda i: md5_int(seed, *by, "rep", i), len(kinds)))
    drawn = draws.drawn(reps, [*by, "rep"], ["u", "cells"], lambda u, cells: draws.with_replacement(u, cells, cells.sum(1)))
    cells = F.array(*[F.struct(F.lit(t).alias("truth"), F.lit(y).alias("label"), F.get("drawn", F.lit(i)).alias("n")) for i, (t, y) in enumerate(kinds)])
    return drawn.select(*by, "rep", F.inline(cells))


def item_interval(cell_counts: DataFrame, by: list[str], replicates: int = 1000, seed: int = 42, names: tuple[str, ...] = ("accuracy", "kappa", "macro_f1")) -> DataFrame:
    """(by..., and for each metric: mean over replicates, percentile interval, number of undefined replicates)."""
    keys = [*by, "rep"]
    values = metrics(confusion(item_replicates(cell_counts, by, replicates, seed), keys), keys, list(names))
    return values.groupBy(*by).agg(*[x for m in names for x in (F.avg(m).alias(f"{m}_mean"), *interval(m))])


def kappa_interval(cell_counts: DataFrame, by: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(by..., kappa_lo, kappa_hi, kappa_undefined, skipped); replicates in which either side has a single class are skipped."""
    keys = [*by, "rep"]
    table = confusion(item_replicates(cell_counts, by, replicates, seed), keys)
    several = lambda total: sum((F.when(total(c) > 0, 1).otherwise(0) for c in LABELS), F.lit(0)) > 1
    kept = several(truth_total) & several(label_total)
    values = table.select(*by, kept.alias("kept"), F.when(kept, METRICS["kappa"]()).alias("kappa"))
    return values.groupBy(*by).agg(*interval("kappa"), F.count_if(~F.col("kept")).alias("skipped"))


def permutation_null(item_cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(system, rep, delta): null of kappa(rater1) - kappa(rater2) when a system's labels are shuffled over items, drawn on counts.

    ``item_cells``: (system, rater1, rater2, label, n). Shuffling keeps how many items each pair of ratings and each label
    has, so the pairs' counts among the items of a label are multivariate hypergeometric: the first label draws from all
    items, the second one from those left, the third one takes the rest. Chance agreement doesn't change.
    """
    pairs = [(a, b) for a in LABELS for b in LABELS]
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double")
    tables = item_cells.groupBy("system").agg(
        F.array(*[count((F.col("rater1") == a) & (F.col("rater2") == b)) for a, b in pairs]).alias("cells"),
        F.array(*[count(F.col("label") == c) for c in LABELS]).alias("labels"),
    )
    reps = dealt(tables.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))), ["system", "rep"])
    reps = reps.withColumn("u", draws.uniforms(lambda i: md5_int(seed, "system", "rep", i // len(pairs), i % len(pairs)), 2 * len(pairs)))
    first = np.array([[p[side] == c for p in pairs] for side in (0, 1) for c in LABELS], float)  # which pairs have a rating

    def deltas(u: np.ndarray, cells: np.ndarray, labels: np.ndarray) -> np.ndarray:
        one = draws.without_replacement(u[:, : len(pairs)], cells, labels[:, 0])
        two = draws.without_replacement(u[:, len(pairs) :], cells - one, labels[:, 1])
        taken, total = [one, two, cells - one - two], cells.sum(1)

        def kappa(side: int) -> np.ndarray:
            rated = first[3 * side : 3 * side + 3]
            hits = sum(t @ r for t, r in zip(taken, rated, strict=True))
            chance = sum((cells @ r) * labels[:, c] for c, r in enumerate(rated)) / (total * total)
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(chance < 1, (hits / total - chance) / (1.0 - chance), np.nan)

        return (kappa(0) - kappa(1))[:, None]

    delta = F.get("drawn", F.lit(0))
    return draws.drawn(reps, ["system", "rep"], ["u", "cells", "labels"], deltas).select("system", "rep", F.when(~F.isnan(delta), delta).alias("delta"))


def permutation_test(null: DataFrame, observed: DataFrame) -> DataFrame:
    """(system, observed, null_mean, delta_lo, delta_hi, delta_undefined, p): two-sided, about the null's mean. observed: (system, observed)."""
    mean = null.groupBy("system").agg(F.avg("delta").alias("null_mean"), *interval("delta"))
    known = mean.join(observed, "system")
    off = F.abs(F.col("delta") - F.col("null_mean")) >= F.abs(F.col("observed") - F.col("null_mean")) - F.lit(1e-12)
    p = null.join(F.broadcast(known), "system").groupBy("system").agg(F.avg(F.when(off, 1.0).otherwise(0.0)).alias("p"))  # a row for each system
    return known.join(p, "system")


def rank_shuffled(predictions: DataFrame, replicates: int, seed: int, keep: list[str] | None = None) -> DataFrame:
    """(system, rep, item_id, keep..., label): labels shuffled over items within each system.

    The item at the r-th place by md5 of (seed, system, rep, item) gets the label of the r-th item by md5 of (``place``, item).
    Places are the same in all replicates, so they are found once; a replicate ranks its items and meets one row for each place.
    """
    placed = md5_rank(predictions.select("system", "item_id", "label"), ["system"], "_at", [F.lit("place"), "item_id"], "item_id").select("system", "_at", "label")
    reps = predictions.select("system", "item_id", *(keep or [])).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    ranked = md5_rank(reps, ["system", "rep"], "_at", [seed, "system", "rep", "item_id"], "item_id")
    return ranked.join(placed, ["system", "_at"]).select("system", "rep", "item_id", *(keep or []), "label")


def _planes(numbers: np.ndarray) -> np.ndarray:
    """The numbers' lowest bytes, then their second bytes and so on."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).ravel()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (system, item_id, codes...) sorted by system and item: (system, first item, body) of many items of a system."""
    press = zstandard.ZstdCompressor(level=3)

    def packed(system: str | None, parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts, 1)
        body = np.concatenate([_planes(np.diff(rows[0], prepend=rows[0, :1])), rows[1:].astype(np.uint8).ravel()])
        arrays = [pa.array([system], pa.string()), pa.array([int(rows[0, 0])], pa.int64()), pa.array([press.compress(body.tobytes())], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["system", "first", "body"])

    now, held, n = None, [], 0
    for batch in batches:
        own = batch.column(0).dictionary_encode()
        which = own.indices.fill_null(len(own.dictionary)).to_numpy(zero_copy_only=False)
        names = [*own.dictionary.to_pylist(), None]
        rows = np.stack([c.cast(pa.int64()).to_numpy() for c in batch.columns[1:]])
        cuts = np.flatnonzero(np.diff(which, prepend=-1)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(which)], strict=True):
            if held and (names[which[i]] != now or n >= PACKED):
                yield packed(now, held)
                held, n = [], 0
            now = names[which[i]]
            held.append(rows[:, i:j])
            n += j - i
    if held:
        yield packed(now, held)


def _unpack(first: int, body: bytes, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(item ids, codes by column)."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    n = len(planes) // (8 + columns)
    steps = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view(np.int64).ravel()
    return first + np.cumsum(steps), planes[8 * n :].reshape(columns, n)


def _in_order(numbers: np.ndarray) -> Iterator[np.ndarray]:
    """The places of md5 integers in ascending order, equal ones as they stand there, in pieces of about SORTED."""
    ranges = len(numbers) // SORTED + 1
    for r in range(ranges):
        lo, hi = (r << 32) // ranges, (r + 1 << 32) // ranges
        at = np.flatnonzero((numbers >= lo) & (numbers <= hi - 1))
        order = numbers[at].astype(np.uint64) << np.uint64(32) | np.arange(len(at), dtype=np.uint64)
        order.sort()
        yield at[(order & np.uint64(0xFFFFFFFF)).view(np.int64)]


def shuffled_counts(predictions: DataFrame, replicates: int, seed: int, keep: list[str]) -> DataFrame:
    """(system, rep, keep..., label, n): how many rows of ``rank_shuffled`` have these values, without a row for each item and replicate.

    Items are sorted and packed once, as differences of their ids and one byte for each column. A task gets the items of one
    system and some of its replicates, and sorts each in memory, range by range of the md5 integers, equal ones by item. Systems of more than MOST_HELD items,
    ids that aren't numbers and columns of very many values go the way over rows, which moves and sorts all of them.
    """
    columns = [*keep, "label"]
    held = stored(predictions.select("system", "item_id", *columns), "shuffled-items")
    kinds = dict(held.dtypes)
    sizes = held.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("item_id").isNull()).alias("lacking"))
    most, lacking = sizes.agg(F.max("n"), F.sum("lacking")).first()
    fits = most and most <= MOST_HELD and not lacking and kinds["item_id"] in ("bigint", "int") and all(kinds[c] == "string" for c in ["system", *columns])
    values = held.select(F.explode(F.array(*columns)).alias("v")).where("v is not null").distinct().limit(MOST_KINDS + 1).collect() if fits else []
    names = [None, *sorted(r["v"] for r in values)]
    base, m = len(names), len(columns)
    if not fits or base > MOST_KINDS or base**m > MOST_CODES:
        return rank_shuffled(held, replicates, seed, keep).groupBy("system", "rep", *columns).agg(F.count(F.lit(1)).cast("double").alias("n"))
    code = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in names[1:]]).cast("array<string>"), F.col(c)), F.lit(0)).cast("int")
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = held.select("system", F.col("item_id").cast("long").alias("item_id"), *[code(c).alias(c) for c in columns])
    ranged = coded.repartitionByRange(parts, "system", "item_id").sortWithinPartitions("system", "item_id")
    packed = ranged.mapInArrow(_pack, "system string, first long, body binary")
    shares = min(replicates, max(SHARES, held.sparkSession.sparkContext.defaultParallelism))
    small = lambda n: np.min_scalar_type(n - 1)

    def shuffled(system: str | None, share: int, bodies: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        def numbers(prefix: str) -> np.ndarray:
            return np.concatenate([md5_ints(prefix, _unpack(*x, m)[0]) for x in bodies])

        rated, label = [], []
        for x in bodies:
            codes = _unpack(*x, m)[1]
            rated.append(sum((c.astype(np.int64) * base ** (m - 2 - i) for i, c in enumerate(codes[:-1])), np.zeros(codes.shape[1], np.int64)).astype(small(base ** (m - 1))))
            label.append(codes[-1])
        rated, label = np.concatenate(rated), np.concatenate(label)
        label = np.concatenate([label[at] for at in _in_order(numbers("place|"))])
        for rep in range(share, replicates, shares):
            prefix = "|".join([str(seed), *([] if system is None else [system]), str(rep), ""])
            n, start = np.zeros(base**m, np.int64), 0
            for at in _in_order(numbers(prefix)):
                n += np.bincount(rated[at].astype(np.int64) * base + label[start : start + len(at)], minlength=base**m)
                start += len(at)
            there = np.flatnonzero(n)
            values = [[names[k] for k in (there // base ** (m - 1 - i) % base).tolist()] for i in range(m)]
            arrays = [pa.array([system] * len(there), pa.string()), pa.array([rep] * len(there), pa.int32()), *[pa.array(v, pa.string()) for v in values], pa.array(n[there].astype(float))]
            yield pa.RecordBatch.from_arrays(arrays, ["system", "rep", *columns, "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bodies = None, []
        for batch in batches:
            for system, share, first, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (system, share) != now and bodies:
                    yield from shuffled(*now, bodies)
                    bodies = []
                now = (system, share)
                bodies.append((first, body))
        if bodies:
            yield from shuffled(*now, bodies)

    dealt = packed.select("system", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "first", "body")
    dealt = dealt.repartition(2 * shares, "system", "share").sortWithinPartitions("system", "share", "first")
    kind = ", ".join(["system string", "rep int", *[f"`{c}` string" for c in columns], "n double"])
    return dealt.mapInArrow(work, kind)
