"""Labels: the five-to-three map, the rule, gates and votes, families of systems."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.operators.sequences import stability
from gazeframe.functions.text import stripped
from gazeframe.schema import FIVE_TO_THREE, GATE, LABELS, RULE, STABILITY_WEIGHTS, label_order

__all__ = ["label_order"]


def to_three(label: Column, strict: bool = True) -> Column:
    """Three-class label of a five- or three-class one; null and empty give null. Unknown ones fail, or give null if not strict."""
    pairs = {**FIVE_TO_THREE, **{x: x for x in LABELS}}
    table = F.create_map(*[F.lit(x) for x in chain(*pairs.items())])
    found = F.coalesce(F.try_element_at(table, label), F.try_element_at(table, stripped(label)))  # white space is looked for in labels that aren't known as they are
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(label.isNull() | (label == ""), F.lit(None).cast("string")).when(found.isNotNull(), found).otherwise(unknown)


def unknown_label(label: Column) -> Column:
    """True for labels that ``to_three`` doesn't know."""
    return label.isNotNull() & (label != "") & to_three(label, strict=False).isNull()


def rule(score: Column | None = None) -> Column:
    """struct(label, confidence) of the ordered rule over the feature columns."""
    score = F.col("attention_stability_score") if score is None else score
    out = lambda label, c: F.struct(F.lit(label).alias("label"), F.lit(c).alias("confidence"))
    visible, shift, motion, least, sure = RULE["steady"]
    steady = (F.col("visible_ratio") >= visible) & (F.col("gaze_shift_ratio") <= shift) & (F.col("mean_gaze_motion") <= motion) & (score >= least)
    shifting, moving, mixed = RULE["moving"]
    return (
        F.when(F.col("eyes_closed_ratio") >= RULE["eyes_closed"][0], out("others", RULE["eyes_closed"][1]))
        .when(F.col("occlusion_ratio") >= RULE["occlusion"][0], out("others", RULE["occlusion"][1]))
        .when(steady, out("focused", sure))
        .when((F.col("gaze_shift_ratio") >= shifting) | (F.col("mean_gaze_motion") >= moving), out("mix", mixed))
        .otherwise(out("mix", RULE["rest"]))
    )


def weight_sets() -> list[tuple[str, tuple[float, ...]]]:
    """The 18 sets of stability weights: the standard ones, equal ones, each left out, and each shift of 0.05."""
    base = STABILITY_WEIGHTS
    out = [("paper", base), ("equal", (0.25,) * 4)]
    for k in range(4):
        rest = sum(w for i, w in enumerate(base) if i != k)
        out.append((f"without_{k}", tuple(0.0 if i == k else w / rest for i, w in enumerate(base))))
    for a in range(4):
        for b in range(4):
            if a != b:
                out.append((f"shift_{a}_{b}", tuple(round(w + 0.05 * (i == b) - 0.05 * (i == a), 2) for i, w in enumerate(base))))
    return out


def stability_grid(feats: DataFrame) -> DataFrame:
    """(child_id, weights, label) for each of the weight sets; the grid of 18 rows is broadcast."""
    grid = feats.sparkSession.createDataFrame([(n, *w) for n, w in weight_sets()], "weights string, w0 double, w1 double, w2 double, w3 double")
    score = stability(
        F.col("visible_ratio"), F.col("max_visible_streak") / F.col("observed_frames"), F.col("mean_gaze_motion"), F.col("gaze_shift_ratio"), tuple(F.col(f"w{k}") for k in range(4))
    )
    return feats.crossJoin(F.broadcast(grid)).select("child_id", "weights", rule(score).label.alias("label"))


def gate() -> Column:
    """True where the features are too unreliable for any label but ``others``."""
    return (F.col("visible_ratio") < GATE["visible"]) | (F.col("max_occlusion_streak") > GATE["occlusion_streak"]) | (F.col("eyes_closed_ratio") > GATE["eyes_closed"])


def vote_counts(predictions: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, votes_focused, votes_mix, votes_others, voters)."""
    return predictions.groupBy(key).agg(*[F.count_if(F.col("label") == c).alias(f"votes_{c}") for c in LABELS], F.count("label").alias("voters"))


def hybrid(alpha: Column) -> Column:
    """Gate, then the best of alpha * rule + (1 - alpha) * share of votes (0 without votes); ties go to the earlier label."""
    ranked = F.array(
        *[
            F.struct(
                (alpha * F.when(F.col("rule_label") == c, 1.0).otherwise(0.0) + (F.lit(1.0) - alpha) * F.coalesce(F.try_divide(f"votes_{c}", "voters"), F.lit(0.0))).alias("score"),
                F.lit(-k).alias("order"),
                F.lit(c).alias("label"),
            )
            for k, c in enumerate(LABELS)
        ]
    )
    return F.when(F.col("gated"), "others").otherwise(F.array_max(ranked).label)


def alpha_sweep(items: DataFrame, steps: int = 10) -> DataFrame:
    """``items`` (item_id, gated, rule_label, votes_*, voters, ...) for alpha = 0, 0.1, ..., 1, with the hybrid label."""
    grid = items.sparkSession.createDataFrame([(k / steps,) for k in range(steps + 1)], "alpha double")
    return items.crossJoin(F.broadcast(grid)).withColumn("label", hybrid(F.col("alpha")))


def majority(predictions: DataFrame, key: str = "item_id") -> DataFrame:
    """The most frequent label of each item; ties go to the first in the alphabet."""
    counts = vote_counts(predictions.where("label is not null"), key)
    ranked = F.array(*[F.struct(F.col(f"votes_{c}").alias("n"), F.lit(-k).alias("order"), F.lit(c).alias("label")) for k, c in enumerate(sorted(LABELS))])
    return counts.select(key, F.array_max(ranked).label.alias("label"))


def agreement_pattern(predictions: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, pattern): ``all_agree`` or ``split_n_ways``; nulls don't count as a way."""
    n = F.countDistinct("label")
    return predictions.groupBy(key).agg(n.alias("ways")).select(key, F.when(F.col("ways") == 1, "all_agree").otherwise(F.concat(F.lit("split_"), F.col("ways").cast("string"), F.lit("_ways"))).alias("pattern"))


def family(system: Column) -> Column:
    """Family of a system by its name; the order of the tests matters."""
    s = F.lower(system)
    return (
        F.when(s.startswith("rule_based"), "rule")
        .when(s.contains("llm_"), "llm")
        .when(s.contains("dummy"), "dummy")
        .when(s.startswith("supervised_"), "supervised")
        .when(s.isin("bart", "deberta", "distilbert") | s.startswith("nli_"), "nli")
        .otherwise("supervised")
    )


# The replacements that shorten a system's name, in order.
SHORTENINGS = [
    ("llm_models_", ""),
    ("supervised_", ""),
    ("Qwen--Qwen2_5", "Qwen2.5"),
    ("01-ai--Yi-1_5", "Yi-1.5"),
    ("meta-llama--Llama-3_1", "Llama-3.1"),
    ("microsoft--Phi-4-mini", "Phi-4-mini"),
    ("mistralai--Mistral-7B-Instruct-v0_3", "Mistral-7B-v0.3"),
    ("-Instruct", ""),
    ("--", "/"),
    ("_", " "),
]


def short_name(system: Column) -> Column:
    out = F.regexp_replace(system, "_3class$", "")
    for old, new in SHORTENINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def file_name(spec: Column) -> Column:
    """A model's name as part of a file name."""
    return F.replace(F.replace(spec, F.lit("/"), F.lit("_")), F.lit(":"), F.lit("__"))


def annotation_sheet(items: DataFrame, predictions: DataFrame, systems: list[str], blanks: tuple[str, ...] = ("annotator_label", "notes")) -> DataFrame:
    """Items with every system's prediction (the first in the alphabet, if repeated), the agreement pattern, and empty columns to fill in."""
    wide = predictions.groupBy("item_id").pivot("system", systems).agg(F.min("label"))
    joined = items.join(wide, "item_id", "left").join(agreement_pattern(predictions), "item_id", "left")
    return joined.select("*", *[F.lit(None).cast("string").alias(b) for b in blanks])
