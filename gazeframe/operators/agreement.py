"""Agreement of systems with raters. Every metric here is algebra on counts by (truth, prediction): one aggregation.

``cells`` counts items by the grouping columns, truth and prediction; ``confusion`` turns each group's counts into one
row of nine columns ``n_<truth>_<prediction>``; the metrics are expressions over these columns.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.operators.labels import family
from gazeframe.schema import LABELS, label_order


def _sum(cols) -> Column:
    return reduce(add, cols)


def with_references(predictions: DataFrame, ratings: DataFrame, references: tuple[str, ...] = ("rater1", "rater2", "consensus")) -> DataFrame:
    """(system, item_id, label, reference, truth, ...): predictions joined to ratings, a row for each reference."""
    joined = predictions.join(ratings, "item_id")
    keep = [c for c in joined.columns if c not in references]
    pairs = ", ".join(f"'{r}', {r}" for r in references)
    return joined.select(*keep, F.expr(f"stack({len(references)}, {pairs}) as (reference, truth)"))


def reference_cells(predictions: DataFrame, ratings: DataFrame, by: list[str], references: tuple[str, ...] = ("rater1", "rater2", "consensus")) -> DataFrame:
    """(by..., reference, truth, label, n): items are counted by all references at once, and only the counts fall apart by reference.

    ``by`` names columns of predictions or ratings. For each of its groups there are 27 times 3 counts at most. Ratings, a row
    for each item, are hashed, so that the many predictions pass by unsorted.
    """
    counted = predictions.where("label is not null").join(ratings.hint("shuffle_hash"), "item_id").groupBy(*by, *references, "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = ", ".join(f"'{r}', {r}" for r in references)
    long = counted.select(*by, "label", "n", F.expr(f"stack({len(references)}, {pairs}) as (reference, truth)"))
    return long.where("truth is not null").groupBy(*by, "reference", "truth", "label").agg(F.sum("n").alias("n"))


def cells(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(by..., truth, label, n), missing labels left out."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return rows.where("truth is not null and label is not null").groupBy(*by, "truth", "label").agg(n.cast("double").alias("n"))


def confusion(cell_counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_<truth>_<label> for all nine, n)."""
    at = lambda y, p: F.sum(F.when((F.col("truth") == y) & (F.col("label") == p), F.col("n")).otherwise(0.0))
    return cell_counts.groupBy(*by).agg(*[at(y, p).alias(f"n_{y}_{p}") for y in LABELS for p in LABELS], F.sum("n").alias("n"))


def n(y: str, p: str) -> Column:
    return F.col(f"n_{y}_{p}")


def truth_total(y: str) -> Column:
    return _sum(n(y, p) for p in LABELS)


def label_total(p: str) -> Column:
    return _sum(n(y, p) for y in LABELS)


def _ratio(a: Column, b: Column, empty=0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def accuracy() -> Column:
    return _ratio(_sum(n(c, c) for c in LABELS), F.col("n"), None)


def kappa() -> Column:
    """Cohen's kappa; null where chance agreement is complete."""
    total = F.col("n")
    chance = _sum(truth_total(c) * label_total(c) for c in LABELS) / (total * total)
    return F.when((total > 0) & (chance < 1), (accuracy() - chance) / (F.lit(1.0) - chance))


def ac1() -> Column:
    """Gwet's AC1 for three classes."""
    share = [(truth_total(c) + label_total(c)) / (F.lit(2.0) * F.col("n")) for c in LABELS]
    chance = _sum(s * (F.lit(1.0) - s) for s in share) / F.lit(float(len(LABELS) - 1))
    return F.when(F.col("n") > 0, (accuracy() - chance) / (F.lit(1.0) - chance))


def precision(c: str) -> Column:
    return _ratio(n(c, c), label_total(c))


def recall(c: str) -> Column:
    return _ratio(n(c, c), truth_total(c))


def f1(c: str) -> Column:
    return _ratio(F.lit(2.0) * n(c, c), truth_total(c) + label_total(c))


def macro_f1(convention: str = "all") -> Column:
    """Mean F1 over all labels, over those in truth or prediction (``union``), or over those in the truth (``present``)."""
    there = {"all": lambda c: F.lit(True), "union": lambda c: truth_total(c) + label_total(c) > 0, "present": lambda c: truth_total(c) > 0}[convention]
    count = _sum(F.when(there(c), 1.0).otherwise(0.0) for c in LABELS)
    return _ratio(_sum(F.when(there(c), f1(c)).otherwise(0.0) for c in LABELS), count, None)


def weighted_f1() -> Column:
    return _ratio(_sum(truth_total(c) * f1(c) for c in LABELS), F.col("n"), None)


def balanced_accuracy() -> Column:
    count = _sum(F.when(truth_total(c) > 0, 1.0).otherwise(0.0) for c in LABELS)
    return _ratio(_sum(recall(c) for c in LABELS), count, None)


def majority_gain() -> Column:
    """Accuracy minus that of always saying the most frequent true label."""
    return accuracy() - F.greatest(*[truth_total(c) for c in LABELS]) / F.col("n")


def top_share() -> Column:
    """Share of the most frequent predicted label."""
    return F.greatest(*[label_total(c) for c in LABELS]) / F.col("n")


METRICS = {
    "accuracy": accuracy,
    "balanced_accuracy": balanced_accuracy,
    "kappa": kappa,
    "ac1": ac1,
    "macro_f1": macro_f1,
    "macro_f1_union": lambda: macro_f1("union"),
    "macro_f1_present": lambda: macro_f1("present"),
    "weighted_f1": weighted_f1,
    "majority_gain": majority_gain,
    "top_share": top_share,
}


def metrics(table: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """(by..., n, metrics...) from ``confusion``'s rows."""
    return table.select(*by, "n", *[METRICS[m]().alias(m) for m in names or METRICS])


def per_class(table: DataFrame, by: list[str]) -> DataFrame:
    """(by..., class, precision, recall, f1, support)."""
    rows = F.array(*[F.struct(F.lit(c).alias("class"), precision(c).alias("precision"), recall(c).alias("recall"), f1(c).alias("f1"), truth_total(c).cast("long").alias("support")) for c in LABELS])
    return table.select(*by, F.inline(rows))


def crosstab(cell_counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., truth, focused, mix, others, total) in label order with a margin row ``all``; absent cells are 0."""
    margins = cell_counts.withColumn("truth", F.explode(F.array("truth", F.lit("all"))))
    at = lambda p: F.sum(F.when(F.col("label") == p, F.col("n")).otherwise(0.0)).cast("long").alias(p)
    counted = margins.groupBy(*by, "truth").agg(*[at(p) for p in LABELS], F.sum("n").cast("long").alias("total"))
    keys = cell_counts.select(*by).distinct().withColumn("truth", F.explode(F.array(*[F.lit(c) for c in [*LABELS, "all"]])))
    return keys.join(counted, [*by, "truth"], "left").fillna(0)


def rater_kappa(table: DataFrame) -> DataFrame:
    """(system, rater1, rater2, consensus): kappa of each system with each reference, a column for each."""
    scored = table.select("system", "reference", kappa().alias("kappa"))
    return scored.groupBy("system").pivot("reference", ["rater1", "rater2", "consensus"]).agg(F.max("kappa"))


def delta_kappa(table: DataFrame, varied_below: float = 0.95) -> DataFrame:
    """(system, family, kappa_rater1, kappa_rater2, delta, varied): how much closer a system is to one rater."""
    wide = rater_kappa(table)
    varied = table.where("reference = 'consensus'").select("system", (top_share() < varied_below).alias("varied"))
    return wide.join(varied, "system").select(
        "system", family(F.col("system")).alias("family"), F.col("rater1").alias("kappa_rater1"), F.col("rater2").alias("kappa_rater2"), (F.col("rater1") - F.col("rater2")).alias("delta"), "varied"
    )


def family_contrast(deltas: DataFrame) -> DataFrame:
    """One row: mean delta of the LLM family minus that of rules and supervised systems, varied systems only."""
    of = lambda *f: F.avg(F.when(F.col("varied") & F.col("family").isin(*f), F.col("delta")))
    return deltas.agg((of("llm") - of("rule", "supervised")).alias("contrast"))


def not_degenerate(kappas: DataFrame) -> DataFrame:
    """Systems with a kappa other than 0 for one of the raters."""
    return kappas.where("abs(rater1) > 1e-6 or abs(rater2) > 1e-6")


def item_difficulty(rows: DataFrame) -> DataFrame:
    """(item_id, n_correct, n_systems), hardest first when ordered by n_correct."""
    return rows.groupBy("item_id").agg(F.count_if(F.col("label") == F.col("truth")).alias("n_correct"), F.count("label").alias("n_systems"))


def disagreement_zone(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """For items whose raters differ: how many systems side with the first, with the second, or with neither."""
    split = ratings.where("rater1 <> rater2").select("item_id", "rater1", "rater2")
    return (
        predictions.where("label is not null")
        .join(split.hint("shuffle_hash"), "item_id")  # a row for each item is held, the many predictions pass by unsorted
        .groupBy("item_id", "rater1", "rater2")
        .agg(
            F.count_if(F.col("label") == F.col("rater1")).alias("sided_rater1"),
            F.count_if(F.col("label") == F.col("rater2")).alias("sided_rater2"),
            F.count_if((F.col("label") != F.col("rater1")) & (F.col("label") != F.col("rater2"))).alias("third"),
        )
    )


def sided_by_family(predictions: DataFrame, ratings: DataFrame, varied: DataFrame | None = None) -> DataFrame:
    """The same counts by family, with a row ``total``. varied: (system) that count, all if none is given."""
    predictions = predictions if varied is None else predictions.join(F.broadcast(varied), "system", "left_semi")  # a row for each system
    rows = predictions.where("label is not null").join(ratings.where("rater1 <> rater2"), "item_id").withColumn("family", family(F.col("system")))
    counted = rows.rollup("family").agg(
        F.count_if(F.col("label") == F.col("rater1")).alias("sided_rater1"),
        F.count_if(F.col("label") == F.col("rater2")).alias("sided_rater2"),
        F.count(F.lit(1)).alias("n"),
    )
    return counted.withColumn("family", F.coalesce("family", F.lit("total")))


def difficulty_table(rows: DataFrame, systems: list[str]) -> DataFrame:
    """``item_difficulty`` with every system's label as s0, s1, ..., and ``place`` from 1: fewest right answers first, then by item."""
    labels_of = [F.min(F.when(F.col("system") == s, F.col("label"))).alias(f"s{k}") for k, s in enumerate(systems)]
    counted = rows.groupBy("item_id").agg(F.count_if(F.col("label") == F.col("truth")).alias("n_correct"), F.count("label").alias("n_systems"), *labels_of)
    levels = counted.groupBy("n_correct").agg(F.count(F.lit(1)).alias("_n"))  # a row for each number of systems
    starts = levels.select("n_correct", (F.sum("_n").over(Window.orderBy("n_correct")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("n_correct").orderBy("item_id"))
    return counted.withColumn("_inside", inside).join(F.broadcast(starts), "n_correct").withColumn("place", F.col("_start") + F.col("_inside")).drop("_inside", "_start")


def label_resolution(ratings: DataFrame) -> DataFrame:
    """(raters_agree, consensus_matches, n): how the consensus came about."""
    matches = (
        F.when((F.col("consensus") == F.col("rater1")) & (F.col("consensus") == F.col("rater2")), "both")
        .when(F.col("consensus") == F.col("rater1"), "rater1")
        .when(F.col("consensus") == F.col("rater2"), "rater2")
        .otherwise("neither")
    )
    return ratings.select((F.col("rater1") == F.col("rater2")).alias("raters_agree"), matches.alias("consensus_matches")).groupBy("raters_agree", "consensus_matches").agg(F.count(F.lit(1)).alias("n"))


def class_pairs(ratings: DataFrame) -> DataFrame:
    """(pair, n): the two labels of items whose raters differ, in alphabetical order."""
    pair = F.concat_ws(" / ", F.array_sort(F.array("rater1", "rater2")))
    return ratings.where("rater1 <> rater2").groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(ratings: DataFrame) -> DataFrame:
    """(rater, label, n) with 0 for labels that a rater never used."""
    long = ratings.select(F.expr("stack(3, 'rater1', rater1, 'rater2', rater2, 'consensus', consensus) as (rater, label)"))
    counted = long.groupBy("rater").agg(*[F.count_if(F.col("label") == c).alias(c) for c in LABELS])
    return counted.select("rater", F.expr(f"stack(3, {', '.join(f"'{c}', {c}" for c in LABELS)}) as (label, n)"))


def flips(predictions: DataFrame, base: str, keys: list[str]) -> DataFrame:
    """(system, condition, n, flip_rate, same): each condition's labels against the base condition's, same system and item."""
    before = predictions.where(F.col("condition") == base).select(*keys, F.col("label").alias("base_label"))
    joined = predictions.where(F.col("condition") != base).join(before, keys)
    changed = F.when(F.col("label") != F.col("base_label"), 1.0).otherwise(0.0)
    return joined.groupBy("system", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg(changed).alias("flip_rate"), F.count_if(F.col("label") == F.col("base_label")).alias("same"))


def best_by(table: DataFrame, group: str, score: str, first: str) -> DataFrame:
    """The row of the largest score in each group; ties go to the smallest ``first``. For small tables of results."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), first))
    return table.withColumn("_place", place).where("_place = 1").drop("_place")


def wide(predictions: DataFrame, systems: list[str]) -> DataFrame:
    """(item_id, a column for each system): for export. Of repeated predictions the first in the alphabet."""
    return predictions.groupBy("item_id").pivot("system", systems).agg(F.min("label"))


def ordered(table: DataFrame, label: str = "truth") -> DataFrame:
    """Rows in the order of the labels."""
    return table.orderBy(label_order(F.col(label)))
