"""Checks of tables against each other and against themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.functions.text import stripped


def integrity_violations(clips: DataFrame, splits: DataFrame, videos: DataFrame) -> DataFrame:
    """(problem, key): clips without a split, with another split than listed, or of a video that isn't there."""
    no_split = clips.join(splits, "clip", "left_anti").select(F.lit("no_split").alias("problem"), F.col("clip").alias("key"))
    other = clips.alias("a").join(splits.alias("b"), "clip").where("a.split <> b.split").select(F.lit("split_differs").alias("problem"), F.col("clip").alias("key"))
    no_video = clips.join(videos, "video_id", "left_anti").select(F.lit("no_video").alias("problem"), F.col("clip").alias("key"))
    return no_split.unionByName(other).unionByName(no_video)


def require_empty(violations: DataFrame, what: str) -> None:
    """Fails with an example if there is any row."""
    if found := violations.take(1):
        raise ValueError(f"{what}: for example {found[0].asDict()}")


def forbidden_tokens(df: DataFrame, token: str) -> DataFrame:
    """(column, hits): how many values of each string column hold the token, in any case."""
    names = [c for c, t in df.dtypes if t == "string"]
    hits = df.agg(*[F.count_if(F.contains(F.lower(c), F.lit(token.lower()))).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("hits")) for c in names])
    return hits.select(F.inline(rows))


def missing_predictions(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """(system, n_items, n_missing): items of the ground truth that a system has no label for."""
    given = predictions.where("label is not null").select("system", "item_id").distinct().join(items.select("item_id"), "item_id", "left_semi")
    total = items.agg(F.count(F.lit(1)).alias("n_items"))
    counted = predictions.select("system").distinct().join(given.groupBy("system").agg(F.count(F.lit(1)).alias("given")), "system", "left")
    return counted.crossJoin(F.broadcast(total)).select("system", "n_items", (F.col("n_items") - F.coalesce("given", F.lit(0))).alias("n_missing"))


def differs(df: DataFrame, a: str, b: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose two columns differ by more than the tolerance."""
    return df.where(F.abs(F.col(a) - F.col(b)) > tolerance)


def labelled(df: DataFrame, label: str, known: list[str]) -> DataFrame:
    """Rows with a known label, without white space around it; fails if there is none."""
    kept = df.withColumn(label, stripped(F.col(label))).where(F.col(label).isin(known))
    if not kept.take(1):
        raise ValueError(f"no row has one of the labels {known}")
    return kept


def unknown_classes(frames: DataFrame, known: list[str]) -> DataFrame:
    """(gaze_class, n) of classes outside the documented ones; such rows stay in the data."""
    return frames.where(~F.coalesce(F.col("gaze_class").isin(known), F.lit(False))).groupBy("gaze_class").agg(F.count(F.lit(1)).alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
