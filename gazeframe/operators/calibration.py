"""Calibration of confidences: expected calibration error and AUROC from counts by distinct confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 10


def score_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., confidence, n, right) of rows with a confidence, a truth and a label."""
    known = rows.where("confidence is not null and label is not null and truth is not null")
    ok = F.when(F.col("label") == F.col("truth"), 1).otherwise(0)
    return known.groupBy(*by, "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("right"))


def calibration(rows: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """(by..., n, accuracy, conf_mean, conf_correct, conf_wrong, ece, auroc, distinct_conf).

    Bins are equal and closed on the right. Ties count half in the AUROC, which is null if all or none are right.
    """
    counts = score_counts(rows, by)
    edges = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    bin_of = F.size(F.filter(edges, lambda e: e < F.col("confidence")))
    binned = counts.groupBy(*by, bin_of.alias("bin")).agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum(F.col("confidence") * F.col("n")).alias("conf"))
    ece = binned.groupBy(*by).agg((F.sum(F.abs(F.col("right") - F.col("conf"))) / F.sum("n")).alias("ece"))
    below = Window.partitionBy(*by).orderBy("confidence").rowsBetween(Window.unboundedPreceding, -1)
    wrong = F.col("n") - F.col("right")
    won = F.col("right") * (F.coalesce(F.sum(wrong).over(below), F.lit(0)) + wrong / F.lit(2.0))
    area = (
        counts.withColumn("won", won)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("n"),
            (F.sum("right") / F.sum("n")).alias("accuracy"),
            (F.sum(F.col("confidence") * F.col("n")) / F.sum("n")).alias("conf_mean"),
            F.try_divide(F.sum(F.col("confidence") * F.col("right")), F.sum("right")).alias("conf_correct"),
            F.try_divide(F.sum(F.col("confidence") * wrong), F.sum(wrong)).alias("conf_wrong"),
            F.try_divide(F.sum("won"), F.sum("right") * F.sum(wrong)).alias("auroc"),
            F.count(F.lit(1)).alias("distinct_conf"),
        )
    )
    return area.join(ece, by)
