"""Readers of annotation, metadata, prediction and generation files."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.operators.quality import integrity_violations, require_empty, union_all
from gazeframe.operators.sequences import children, duplicate_frames
from gazeframe.schema import ANNOTATION_COLUMNS, ANNOTATION_TYPES


def _headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their header. Spark takes one file's header for all files of a read, so each kind is read by itself."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    named = F.arrays_overlap(F.split("value", ","), F.array(*[F.lit(c) for c in ANNOTATION_COLUMNS]))  # no value equals a column's name
    heads = lines.where(named).groupBy("path").agg(F.first("value").alias("value"))
    out = defaultdict(list)
    for r in heads.collect():  # one short row for each file
        out[tuple(r["value"].strip().split(","))].append(r["path"])
    return out


def _whole(c: str) -> Column:
    """A number that may be written as ``224.0``, as an int; a fraction fails."""
    number = F.col(c).cast("double")
    return F.when(number % 1 != 0, F.raise_error(F.concat(F.lit(f"{c} is not a whole number: "), c)).cast("int")).otherwise(number.cast("int"))


def annotations(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """Frames of ``root/annotations/{train,val,test}/*.csv``, for one folder or all: columns by name, typed; a missing column or bad value fails."""
    paths = [f"{root}/annotations/{s}/*.csv" for s in ([split] if split else ["train", "val", "test"])]
    parts = []
    for header, files in _headers(spark, paths).items():
        missing = [c for c in ANNOTATION_COLUMNS if c not in header]
        if missing:
            raise ValueError(f"{files[0]} lacks the columns {missing}")
        schema = ", ".join(f"`{c}` string" for c in header)
        rows = spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(sorted(files))
        kinds = {c: ANNOTATION_TYPES.get(c, "double") for c in ANNOTATION_COLUMNS}
        parts.append(rows.select(*[(_whole(c) if k == "int" else F.col(c).cast(k)).alias(c) for c, k in kinds.items()], F.col("_metadata.file_path").alias("path")))
    if not parts:
        raise ValueError(f"no annotation files in {root}")
    return union_all(parts).withColumn("child_id", F.concat("clip", F.lit(":person_"), F.col("person_id").cast("string")))


def metadata(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A clips, splits or videos CSV; a key that occurs twice fails."""
    rows = spark.read.option("header", True).csv(path)
    if twice := rows.groupBy(key).count().where("count > 1").take(1):
        raise ValueError(f"{path}: {key} {twice[0][key]} occurs more than once")
    return rows


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


PREDICTION = "system string, item_id string, label string, confidence double, reasoning string"


def predictions(spark: SparkSession, folder: str, pattern: str = "*_3class.csv", truth: str = "ground_truth_3class.csv") -> DataFrame:
    """(system, item_id, label, confidence, reasoning) of all prediction files; summaries and files without a label are skipped.

    ``pattern``: a glob, or several in braces (``{rule*,llm_*}_3class.csv``). A match may be one file or a folder of parts
    that Spark wrote, which many tasks read. No row if none qualifies.
    """
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    store = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [s.getPath().toString() for s in store.globStatus(found) or []]  # one for each system
    parts = []
    for path in sorted(files):
        name = path.rsplit("/", 1)[1]
        if name == truth or "_summary" in name:
            continue
        rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
        if not {"child_id", "pred_3class"} <= set(rows.columns):
            continue
        parts.append(_prediction(rows, name))
    return union_all(parts) if parts else spark.createDataFrame([], PREDICTION)


def prediction_tables(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """The same of predictions that Spark wrote: each name is a folder of CSV parts of one system."""
    parts = []
    for name in sorted(names):
        rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(f"{folder}/{name}")
        if {"child_id", "pred_3class"} <= set(rows.columns):
            parts.append(_prediction(rows, name))
    return union_all(parts) if parts else spark.createDataFrame([], PREDICTION)


def _prediction(rows: DataFrame, name: str) -> DataFrame:
    extra = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("confidence", "double"), ("reasoning", "string"))]
    return rows.select(F.lit(name.removesuffix(".csv").removesuffix("_3class")).alias("system"), F.col("child_id").alias("item_id"), F.col("pred_3class").alias("label"), *extra)


def prompt_store(spark: SparkSession, path: str) -> DataFrame:
    """(condition, item_id, prompt) of a nested JSON object condition -> item -> prompt."""
    text = spark.read.text(path, wholetext=True)
    store = text.select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("condition", "items"))
    return store.select("condition", F.explode("items").alias("item_id", "prompt"))


def generations(spark: SparkSession, folder: str) -> DataFrame:
    """(model, condition, item_id, raw) of files ``model__condition.jsonl``; blank lines are skipped."""
    rows = spark.read.option("pathGlobFilter", "*__*.jsonl").schema("child_id string, raw string").json(folder)
    stem = F.split(F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", ""), "__")
    return rows.select(stem[0].alias("model"), stem[1].alias("condition"), F.col("child_id").alias("item_id"), "raw").where("item_id is not null")


def sequences_of(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """Frames of children with their clip's split, video, channel and fps, of one split or all; the split is the clip's, not the folder's.

    Reads ``root/annotations``, ``clips.csv``, ``splits.csv`` and ``videos.csv``. A frame whose clip is not listed fails, as
    do a clip without a split, with another split than listed, or of a video that isn't listed, and a repeated frame.
    """
    clips = metadata(spark, f"{root}/clips.csv", "clip")
    require_empty(integrity_violations(clips, metadata(spark, f"{root}/splits.csv", "clip"), metadata(spark, f"{root}/videos.csv", "video_id")), "clips, splits and videos differ")
    return enriched(annotations(spark, root), clips, split)


def enriched(frames: DataFrame, clips: DataFrame, split: str | None = None) -> DataFrame:
    """Children's frames with split, video_id, channel_id and fps of their clips, for one split or all."""
    known = clips.select("clip", "split", "video_id", "channel_id", F.col("fps").cast("double").alias("fps"))
    mine = children(frames)
    require_empty(mine.join(known, "clip", "left_anti").select("clip").limit(1), "frames of a clip that isn't listed")
    require_empty(duplicate_frames(mine).limit(1), "a frame of a sequence occurs twice")
    joined = mine.join(known, "clip")
    return joined.where(F.col("split") == split) if split else joined
