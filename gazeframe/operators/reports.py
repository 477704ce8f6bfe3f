"""Tables of the study's reports: conditions of a prompt, few-shot draws, cases, gate and agreement audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.operators import agreement
from gazeframe.schema import LABELS


def condition_metrics(rows: DataFrame, ratings: DataFrame, rule: DataFrame) -> DataFrame:
    """One row for each (system, condition): parse failures, label counts, accuracy, kappa with each reference, F1 of
    ``others``, agreement with the rule. rows: (system, condition, item_id, label, status); rule: (item_id, rule_label)."""
    by = ["system", "condition"]
    counts = (
        rows.join(rule.hint("shuffle_hash"), "item_id")  # a row for each item is held, the rows pass by unsorted
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("status") == "no_json").alias("no_json"),
            F.count_if(F.col("status") == "invalid_label").alias("invalid"),
            *[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in LABELS],
            F.avg(F.when(F.col("label") == F.col("rule_label"), 1.0).otherwise(0.0)).alias("agree_with_rule"),
        )
    )
    table = agreement.confusion(agreement.reference_cells(rows, ratings, by), [*by, "reference"])
    scores = table.select(*by, "reference", agreement.accuracy().alias("accuracy"), agreement.kappa().alias("kappa"), agreement.f1("others").alias("f1_others"))
    of = lambda c, r: F.max(F.when(F.col("reference") == r, F.col(c)))
    wide = scores.groupBy(*by).agg(
        of("accuracy", "consensus").alias("accuracy"), of("f1_others", "consensus").alias("f1_others"), *[of("kappa", r).alias(f"kappa_{r}") for r in ("rater1", "rater2", "consensus")]
    )
    return counts.join(wide, by)


def kappa_by_condition(metrics: DataFrame, conditions: list[str], value: str = "kappa_consensus") -> DataFrame:
    """(system, a column for each condition, and its change against the first one)."""
    wide = metrics.groupBy("system").pivot("condition", conditions).agg(F.first(value))
    return wide.select("*", *[(F.col(c) - F.col(conditions[0])).alias(f"change_{c}") for c in conditions[1:]])


def draws_table(metrics: DataFrame, base: str) -> DataFrame:
    """(system, kappa_base, kappa_mean, delta, predicted_others, unparsed): the mean of all conditions but the base against it."""
    is_base = F.col("condition") == base
    out = metrics.groupBy("system").agg(
        F.max(F.when(is_base, F.col("kappa_consensus"))).alias("kappa_base"),
        F.avg(F.when(~is_base, F.col("kappa_consensus"))).alias("kappa_mean"),
        F.sum(F.when(~is_base, F.col("n_others")).otherwise(0)).alias("predicted_others"),
        F.sum(F.when(~is_base, F.col("no_json") + F.col("invalid")).otherwise(0)).alias("unparsed"),
    )
    return out.withColumn("delta", F.col("kappa_mean") - F.col("kappa_base"))


def label_locator(rows: DataFrame, ratings: DataFrame, rule: DataFrame, label: str = "others") -> DataFrame:
    """(condition, system, item_id, consensus, rule_label) of every prediction of one label."""
    return rows.where(F.col("label") == label).join(ratings.select("item_id", "consensus"), "item_id").join(rule, "item_id").select("condition", "system", "item_id", "consensus", "rule_label")


def gate_audit(items: DataFrame) -> DataFrame:
    """One row: flagged items, how many of them the rule has right, how many are truly ``others``. items: (gated, rule_label, truth)."""
    g = F.col("gated")
    return items.agg(F.count_if(g).alias("flagged"), F.count_if(g & (F.col("rule_label") == F.col("truth"))).alias("rule_right"), F.count_if(g & (F.col("truth") == "others")).alias("truly_others"))


def case_studies(items: DataFrame, rare: str = "others") -> DataFrame:
    """Items of the rare class, and gated ones, with the rule's label and the votes."""
    return items.where((F.col("truth") == rare) | F.col("gated")).select("item_id", "truth", "gated", "rule_label", *[f"votes_{c}" for c in LABELS])


def group_medians(features: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, n, the median of each column)."""
    return features.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.median(c).alias(c) for c in columns])


def first_items(rows: DataFrame, n: int, key: str = "item_id") -> DataFrame:
    """The first n rows by key."""
    return rows.orderBy(key).limit(n)
