"""Helpers that the training-data operators share: tables, the shared folder, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes of an Arrow batch of texts, about: a task holds a few copies of one batch in the JVM and in Python.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding this session's Arrow batches by bytes, as rows of texts may be long or short."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def map_whole_rows(docs: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` after ``work``, which keeps the columns; they are numbered meanwhile, as names with dots or of the same letters don't resolve."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    kind = StructType([StructField(name, field.dataType) for name, field in zip(names, docs.schema.fields, strict=True)])
    return bounded_batches(docs).toDF(*names).mapInArrow(work, kind).toDF(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name below the folder that ``spark.checkpoint.dir`` names; a temporary one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    if (own := _own.get()) is not None:
        own.append(path)
    return path


_made: list[str] = []
#: The folders that a ``step`` has made so far.
_own: ContextVar[list[str] | None] = ContextVar("_own", default=None)


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def cleanup(spark: SparkSession) -> int:
    """Deletes all folders that this process's operators have made so far, and says how many; their results can't be read any more."""
    gone = 0
    while _made:
        gone += _delete(spark, _made.pop())
    return gone


def step(spark: SparkSession, tag: str, work: Callable[[], DataFrame], used: list[str]) -> tuple[DataFrame, list[str]]:
    """What ``work`` gives, ``written``, and the folder that holds it. All other folders made meanwhile go, and so do those in ``used``.

    Shuffle files of the jobs go too, which the driver would else keep until it next happens to collect its garbage.
    """
    here: list[str] = []
    mark = _own.set(here)
    try:
        out = written(work(), tag)
    finally:
        _own.reset(mark)
    for folder in [*used, *here[:-1]]:  # the last one is the result's
        _delete(spark, folder)
        if folder in _made:
            _made.remove(folder)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out, here[-1:]


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: later jobs don't depend on executors' files."""
    spark = df.sparkSession
    out = shared_dir(spark, tag)
    df.write.option("compression", codec).parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def join_hot(rows: DataFrame, groups: DataFrame, key: str, count: str, hot: int = 1 << 17) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row for each ``key`` and in ``count`` how many rows have it.

    Keys of more than ``hot`` rows, which are few as their rows add up to a table's, are broadcast; the others are
    shuffled. So a key that a third of all rows has meets no single task.
    """
    many = groups.where(F.col(count) > hot)
    if not many.take(1):
        return rows.join(groups, key)
    few = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(groups.where(F.col(count) <= hot), key)
    return few.unionByName(rows.join(F.broadcast(many), key))


def components(edges: DataFrame, tag: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, root) with the smallest node of each component as root, for every node that has an edge.

    ``edges`` has two long columns ``u`` and ``v``. Each round gives every label the smallest label that an edge joins it
    to, and then that one's own label; rounds are few (logarithmic in the usual case) and each reads what the previous
    one wrote to the shared folder. A hub's edges are met by a join and by partial minima, never gathered.
    Nulls and loops are dropped; an empty input gives an empty result.
    """
    e = (
        edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = written(e, f"{tag}-edges")
    nodes = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = e.select(F.col("v").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    label = written(nodes.unionByName(roots.withColumn("root", F.col("node"))), f"{tag}-labels")
    for _ in range(max_rounds):
        # each edge, as an edge between the labels of its ends
        far = (
            e.join(label.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u")
            .join(label.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
            .where("ru <> rv")
            .select(F.greatest("ru", "rv").alias("hi"), F.least("ru", "rv").alias("lo"))
        )
        hooks = written(far.groupBy("hi").agg(F.min("lo").alias("lo")), f"{tag}-hooks")
        if not hooks.take(1):  # both ends of every edge have the same label, which is then the smallest node
            return label
        jumps = label.where("root <> node").select(F.col("node").alias("hi"), F.col("root").alias("up"))
        moved = (
            label.join(hooks.withColumnRenamed("hi", "root"), "root", "left")
            .select("node", F.coalesce("lo", "root").alias("root"))
        )
        step = (
            moved.join(jumps.withColumnRenamed("hi", "root"), "root", "left")
            .select("node", F.least("root", F.coalesce("up", "root")).alias("root"))
        )
        label = written(step, f"{tag}-labels")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def forest(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges (name, name of its tree's first member) of a spanning forest of the links between names[i] and names[j]."""
    root = np.arange(len(names))
    while len(i):
        lo = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], lo)
        np.minimum.at(new, root[j], lo)
        new = new[new][root]
        if (new == root).all():
            break
        root = new
    return [(int(names[k]), int(names[r])) for k, r in enumerate(root.tolist()) if k != r]
