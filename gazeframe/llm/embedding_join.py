"""Embedding near-duplicates: an epsilon grid order join of unit vectors.

Cosine >= c of unit vectors is Euclidean distance <= e = sqrt(2 - 2c). Equal vectors are one point with a weight. Points
are projected onto their leading principal axes (covariance summed over all rows), and sorted by the cells of a grid of
width e on the first of them. The sorted sequence is cut into intervals of a bounded number of points, each written to
the shared folder. Pairs of stretches of the sequence are then joined recursively: from the whole sequence down, sixteen
parts at a time, a pair goes on only if its boxes are not provably further apart than e; what is left are pairs of
intervals, dealt out evenly as small jobs. Within a job the recursion goes on by halves. In the smallest parts, the
projections and the length of what they leave out bound every cosine from above (one product of narrow matrices); pairs
that the bound doesn't exclude are compared in double precision. A job returns counts of links and a spanning forest,
never the pairs.

A box excludes much where the vectors spread over several times e on the leading axes, and little where they fill all
directions alike; the bound by projections works for both.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
vectors of different length don't link. Rows of equal vec_id are one node: they don't link with each other, links are
counted by pairs of rows, and each row gets its node's result. A null vec_id has no links and a null component and
isn't kept. A vector may be of any length; the axes are those of its first WIDEST components. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.common import bounded_batches, components, forest, join_hot, shared_dir, written
from gazeframe.llm.files import get, put

#: Axes of the grid, of the intervals' boxes, and of the bounds; points of an interval, points of a leaf of the recursion.
GRID, BOX, AXES, INTERVAL, LEAF = 4, 8, 24, 1024, 256
#: Components that the axes are taken from, and bytes of an interval's vectors.
WIDEST, INTERVAL_BYTES = 1024, 4 << 20
#: Parts that a stretch of the sequence falls into, and intervals on either side of a job.
FAN, JOB = 16, 4
#: Room for the rounding of projections in what counts as provably distant.
SLACK = 1e-5


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their unit vectors) of the valid vectors in a list array, for each length, a few megabytes at a time."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
    at = column.offsets.to_numpy()
    length = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))
    for n in np.unique(length[length > 0]).tolist():
        same = np.flatnonzero(length == n)
        for k in range(0, len(same), max(1, (1 << 20) // n)):
            rows = same[k : k + max(1, (1 << 20) // n)]
            x = values[at[rows][:, None] + np.arange(n)]
            top = np.abs(x).max(1)
            good = np.isfinite(top) & (top > 0)
            x = x[good] / top[good][:, None]  # no overflow or underflow in the squares
            yield rows[good], x / np.sqrt((x * x).sum(1))[:, None]


def axes(vectors: DataFrame, width: int) -> np.ndarray:
    """(width + 1) x width: principal axes by falling variance as columns, and the mean's place on them as last row.

    Each task sums up one small matrix. The matrices are added up by blocks of rows, in two steps.
    """
    block = 64

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            for _, x in _units(batch.column(1)):
                x = x[:, :width]
                x = np.hstack([np.ones((len(x), 1)), x, np.zeros((len(x), width - x.shape[1]))])
                total += x.T @ x
        if total[0, 0]:
            at = list(range(0, width + 1, block))
            part = [TaskContext.get().partitionId() % 32] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part), pa.array([total[k : k + block].tobytes() for k in at], pa.binary())], ["k", "part", "m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, part, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = np.frombuffer(m)
                total[k, part] = total[k, part] + m if (k, part) in total else m
        names = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in names], pa.int64()), pa.array([p for _, p in names], pa.int64()), pa.array([total[n].tobytes() for n in names], pa.binary())], ["k", "part", "m"])

    kind = "k long, part long, m binary"
    once = vectors.mapInArrow(sums, kind).repartition("k", "part").mapInArrow(added, kind)
    twice = once.select("k", F.lit(0).cast("long").alias("part"), "m").repartition("k").mapInArrow(added, kind)
    total = np.zeros((width + 1, width + 1))
    for r in twice.toLocalIterator():  # (width + 1) ** 2 numbers in all
        rows = np.frombuffer(r["m"]).reshape(-1, width + 1)
        total[r["k"] : r["k"] + len(rows)] = rows
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    turn = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))[1][:, ::-1]
    return np.vstack([turn, mean @ turn])


def _projected(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Places on the axes, and the length of what they leave out: distances shrink by this, and products don't."""
    k = min(x.shape[1], len(turn) - 1)
    y = x[:, :k] @ turn[:k]
    return np.hstack([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(1)))[:, None]])


CELLS = [f"c{g}" for g in range(GRID)]


def placed(vectors: DataFrame, turn, eps: float) -> DataFrame:
    """(vec_id, length, c0.., digest, x) of the valid rows, in the shared folder: cells on the first axes, and the unit vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for rows, x in _units(batch.column(1)):
                y = _projected(x, turn.value)[:, :-1] - turn.value[-1]
                cells = np.zeros((len(x), GRID), np.int64)
                cells[:, : y.shape[1]] = np.floor(y[:, :GRID] / eps)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1])), *[pa.array(c) for c in cells.T], pa.array([v.tobytes() for v in x + 0.0], pa.binary())], ["vec_id", "length", *CELLS, "x"])

    rows = vectors.mapInArrow(work, f"vec_id long, length long, {', '.join(f'{c} long' for c in CELLS)}, x binary")
    return written(rows.withColumn("digest", F.unhex(F.sha2("x", 256))), "grid-vectors")


def points(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, weight, times, length, c0.., x) of the different vectors; and (vec_id, id) of the rows that share one.

    weight: rows with that vector. times: rows of ``id`` among them, 1 if all have different ids. Rows of a repeated
    vec_id are a point of their own for each of its vectors.
    """
    again = written(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "grid-again")
    keyed = rows.withColumn("key", F.col("digest")).withColumn("repeated", F.lit(False))
    if again.take(1):
        own = F.concat("digest", F.encode(F.col("vec_id").cast("string"), "UTF-8"))
        keyed = keyed.join(again, "vec_id", "left_anti").unionByName(rows.join(again, "vec_id", "left_semi").withColumn("key", own).withColumn("repeated", F.lit(True)))
    kept = keyed.groupBy("key", "length", "repeated", *CELLS).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("x").alias("x"))
    kept = written(kept.withColumn("times", F.when(F.col("repeated"), F.col("weight")).otherwise(1)), "grid-points")
    shared = kept.where("weight > 1 and not repeated").select("key", "id", "weight")
    members = join_hot(rows.select("vec_id", F.col("digest").alias("key")), shared, "key", "weight").select("vec_id", "id")
    return kept, members.join(again, "vec_id", "left_anti") if again.take(1) else members


def intervals(kept: DataFrame, turn, size: int = INTERVAL) -> DataFrame:
    """Writes the intervals of the grid order; (no, path, length, lo0.., hi0..): the place in the sequence, and the box."""
    folder = shared_dir(kept.sparkSession, "grid")
    dims = _dims(turn)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        now, most = None, size

        def flush() -> pa.RecordBatch:
            nonlocal place
            ids, weight, times, x = zip(*held, strict=True)
            x = np.frombuffer(b"".join(x)).reshape(len(ids), -1)
            f = _projected(x, turn.value)
            out = io.BytesIO()
            np.savez(out, ids=np.array(ids, np.int64), weight=np.array(weight, np.int64), times=np.array(times, np.int64), x=x, f=f.astype(np.float32))
            f = np.hstack([f[:, : dims - 1], f[:, -1:]])
            row = [part, place, put(folder, "part.npz", out.getvalue()), now, *f.min(0).tolist(), *f.max(0).tolist()]
            place += 1
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["part", "place", "path", "length", *_box("lo", dims), *_box("hi", dims)])

        for batch in batches:
            for point_id, weight, times, length, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (length != now or len(held) >= most):
                    yield flush()
                    held = []
                if length != now:
                    now, most = length, max(1, min(size, INTERVAL_BYTES // (8 * length)))
                held.append((point_id, weight, times, x))
        if held:
            yield flush()

    order = ["length", *CELLS, "id"]
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bounded_batches(kept).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "weight", "times", "length", "x")
    kind = "part long, place long, path string, length long" + "".join(f", {c} double" for c in _box("lo", dims) + _box("hi", dims))
    cuts = written(rows.mapInArrow(cut, kind), "grid-intervals")
    count = cuts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each range
    start = count.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return written(cuts.join(F.broadcast(start), "part").withColumn("no", F.col("start") + F.col("place")).drop("part", "place", "start"), "grid-numbers")


def _dims(turn) -> int:
    """Axes of the intervals' boxes, with the length of what the projections leave out as the last one."""
    return min(turn.value.shape[1], BOX) + 1


def _box(side: str, dims: int) -> list[str]:
    return [f"{side}{k}" for k in range(dims)]


def _apart(dims: int) -> Column:
    """The squared distance of the boxes of ``a`` and ``b``."""
    gaps = [F.greatest(F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}"), F.lit(0.0)) for k in range(dims)]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def interval_pairs(cuts: DataFrame, dims: int, eps: float) -> DataFrame:
    """(a, b): numbers a <= b of the intervals of one length whose boxes, and those of all stretches above them, are not provably apart."""
    top = cuts.agg(F.max("no")).first()[0]
    levels = 0
    while top is not None and top // FAN**levels > 0:
        levels += 1
    pairs = cuts.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(levels, -1, -1):
        node = F.floor(F.col("no") / FAN**level)
        box = [f(c).alias(c) for side, f in (("lo", F.min), ("hi", F.max)) for c in _box(side, dims)]
        nodes = cuts.groupBy(node.alias("node")).agg(*box, F.min("length").alias("short"), F.max("length").alias("long"))
        nodes = nodes.withColumn("up", F.floor(F.col("node") / FAN) if level < levels else F.lit(0).cast("long"))
        left = pairs.join(nodes.alias("a"), F.col("a.up") == pairs["a"]).select(pairs["b"].alias("other"), F.struct("a.*").alias("a"))
        both = left.join(nodes.select(F.struct("*").alias("b")), F.col("b.up") == F.col("other"))
        meet = (F.col("a.node") <= F.col("b.node")) & (F.col("a.short") <= F.col("b.long")) & (F.col("b.short") <= F.col("a.long"))
        pairs = both.where(meet & (_apart(dims) <= eps * eps + SLACK)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        pairs = written(pairs, "grid-pairs")
    return pairs


def _boxes(f: np.ndarray) -> dict[int, tuple]:
    """Boxes of f's halves, quarters and so on: node k has children 2k+1 and 2k+2."""
    out: dict[int, tuple] = {}

    def fill(k: int, lo: int, hi: int) -> None:
        out[k] = (lo, hi, f[lo:hi].min(0), f[lo:hi].max(0))
        if hi - lo > LEAF:
            mid = (lo + hi) // 2
            fill(2 * k + 1, lo, mid)
            fill(2 * k + 2, mid, hi)

    fill(0, 0, len(f))
    return out


def _close(a: dict, b: dict, p0: int, p1: int, q0: int, q1: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two leaves with at least that cosine: by the bound of the projections, and what is left in double precision."""
    i, j = np.nonzero(a["f"][p0:p1] @ b["f"][q0:q1].T >= np.float32(cosine - SLACK))
    if not len(i):
        return i, j
    if 16 * len(i) > (p1 - p0) * (q1 - q0):
        i, j = np.nonzero(a["x"][p0:p1] @ b["x"][q0:q1].T >= cosine)
        return i + p0, j + q0
    i, j = i + p0, j + q0
    step = max(1, (1 << 20) // a["x"].shape[1])
    near = [np.einsum("ij,ij->i", a["x"][i[k : k + step]], b["x"][j[k : k + step]]) >= cosine for k in range(0, len(i), step)]
    near = np.concatenate(near)
    return i[near], j[near]


def linked_pairs(a: dict, b: dict, same: bool, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) with at least that cosine; if ``same``, each pair once."""
    limit = eps * eps + SLACK
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        p0, p1, p_lo, p_hi = a["boxes"][p]
        q0, q1, q_lo, q_hi = b["boxes"][q]
        if same and q1 <= p0:
            continue
        gap = np.maximum(np.maximum(p_lo - q_hi, q_lo - p_hi), 0)
        if gap @ gap > limit:
            continue
        if p1 - p0 <= LEAF and q1 - q0 <= LEAF:
            i, j = _close(a, b, p0, p1, q0, q1, cosine)
            if same:
                i, j = i[i < j], j[i < j]
            found_i.append(i)
            found_j.append(j)
        elif p1 - p0 >= q1 - q0:
            stack += [(2 * p + 1, q), (2 * p + 2, q)]
        else:
            stack += [(p, 2 * q + 1), (p, 2 * q + 2)]
    return np.concatenate(found_i), np.concatenate(found_j)


def interval_links(cuts: DataFrame, pairs: DataFrame, cosine: float, eps: float) -> DataFrame:
    """(id, links, root): links of each point with those of the other intervals, and an edge of a spanning forest.

    A job is the pairs between two runs of JOB intervals; jobs are dealt out in turn, whatever their keys.
    """
    paths = cuts.select("no", "path")
    named = (
        pairs.join(paths.select(F.col("no").alias("a"), F.col("path").alias("path_a")), "a")
        .join(paths.select(F.col("no").alias("b"), F.col("path").alias("path_b")), "b")
        .groupBy(F.floor(F.col("a") / JOB).alias("ja"), F.floor(F.col("b") / JOB).alias("jb"))
        .agg(F.sort_array(F.collect_list(F.struct("path_a", "path_b"))).alias("pairs"))  # JOB * JOB at most
    )
    jobs = written(named.select("pairs"), "grid-jobs")
    n = jobs.count()

    def load(path: str) -> dict:
        got = dict(np.load(io.BytesIO(get(path))))
        return got | {"boxes": _boxes(got["f"])}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.column(0).to_pylist():
                held: OrderedDict[str, dict] = OrderedDict()

                def take(path: str, held=held) -> dict:
                    if path not in held:
                        if len(held) > 2 * JOB:
                            held.popitem(last=False)
                        held[path] = load(path)
                    return held[path]

                for pair in job:
                    a, b = take(pair["path_a"]), take(pair["path_b"])
                    same = pair["path_a"] == pair["path_b"]
                    if a["x"].shape[1] != b["x"].shape[1]:
                        continue
                    i, j = linked_pairs(a, b, same, cosine, eps)
                    other = a["ids"][i] != b["ids"][j]
                    i, j = i[other], j[other]
                    if not len(i):
                        continue
                    ids = a["ids"] if same else np.concatenate([a["ids"], b["ids"]])
                    shift = 0 if same else len(a["ids"])
                    count = np.zeros(len(ids), np.int64)
                    np.add.at(count, i, a["times"][i] * b["weight"][j])
                    np.add.at(count, j + shift, b["times"][j] * a["weight"][i])
                    root = ids.copy()
                    for k, r in forest(np.arange(len(ids)), i, j + shift):
                        root[k] = ids[r]
                    there = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[there]), pa.array(count[there]), pa.array(root[there])], ["id", "links", "root"])

    parts = int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = jobs.repartition(max(1, min(n, max(4 * parts, n // 64))))
    return written(dealt.mapInArrow(work, "id long, links long, root long"), "grid-links")


def join(embeddings: DataFrame, cosine: float = 0.9, size: int = INTERVAL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding)."""
    if not 0 < cosine < 1:
        raise ValueError("cosine must be between 0 and 1")
    eps = float(np.sqrt(2 - 2 * cosine))
    vectors = bounded_batches(embeddings).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = vectors.where("vec_id is not null and embedding is not null")
    width = min(WIDEST, max(1, valid.agg(F.max(F.size("embedding"))).first()[0] or 1))
    turn = embeddings.sparkSession.sparkContext.broadcast(axes(valid, width)[:, : min(width, AXES)])
    kept, members = points(placed(valid, turn, eps))
    cuts = intervals(kept, turn, size)
    found = interval_links(cuts, interval_pairs(cuts, _dims(turn), eps), cosine, eps)
    label = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), "grid").withColumnRenamed("node", "id")
    by_id = written(found.groupBy("id").agg(F.sum("links").alias("links")).join(label, "id"), "grid-nodes")
    # rows that share a vector have what its point has, and each other
    shared = kept.where("weight > 1 and not repeated").select("id", "weight").join(by_id, "id", "left")
    shared = written(shared.select("id", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "id").alias("root")), "grid-shared")
    in_class = join_hot(members, shared, "id", "weight").select("vec_id", "links", "root")
    alone = by_id.join(shared, "id", "left_anti").select(F.col("id").alias("vec_id"), "links", "root")
    done = (
        vectors.where("vec_id is not null").select("vec_id")
        .join(alone.unionByName(in_class), "vec_id", "left")
        .select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
    nameless = vectors.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("kept"))
    return done.unionByName(nameless)
