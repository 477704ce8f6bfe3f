"""Prompts from features, and labels from generated text, as column expressions."""

from __future__ import annotations

import json
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.functions.hashing import md5_int, md5_rank, md5_uniform
from gazeframe.schema import DESCRIPTIONS, LABELS, label_order

# Wording and bins that prompts must share with the published study.
ANCHOR = "Return ONLY a valid JSON object"
INTRO = (
    "You are an expert in child visual attention analysis.\n\n"
    "Given the following structured behavioral features extracted from a child's gaze tracking data in a video clip, "
    "classify the child's overall attention behavior into exactly ONE of these three categories:\n\n"
)
OUTRO = (
    "\n\n" + ANCHOR + " with these three fields:\n"
    '  - "label": one of the three category names above (exactly as written)\n'
    '  - "confidence": a float between 0 and 1\n'
    '  - "reasoning": a short explanation (1-2 sentences)\n\n'
    "Do NOT include any text before or after the JSON object.\n\n"
    "Features:\n"
)
GUIDANCE = (
    "Use these reference thresholds when interpreting the features:\n"
    "  - others: eyes_closed_ratio >= 0.30, or occlusion_ratio >= 0.35.\n"
    "  - focused: visible_ratio >= 0.75 and gaze_shift_ratio <= 0.10 and mean_gaze_motion <= 120 and attention_stability_score >= 0.65.\n"
    "  - mix: every other case.\n\n"
)
FEWSHOT_INTRO = "Here are three labelled example clips from other videos, one per category:\n\n"
FEWSHOT_OUTRO = "Now classify the following clip.\n\n"
RATIOS = ["attention_stability_score", "eyes_closed_ratio", "gaze_shift_ratio", "occlusion_ratio", "on_screen_ratio", "visible_gaze_fraction", "visible_ratio"]
STREAKS = ["max_occlusion_streak", "max_visible_streak"]
COUNTS = ["gaze_shift_events", "max_occlusion_streak", "max_visible_streak", "num_interactions", "num_segments", "observed_frames"]
PAYLOAD = [*RATIOS, *COUNTS, "dominant_gaze_class", "mean_gaze_motion", "mean_head_area", "mean_head_motion"]
LABEL_SETS = {
    "L1 bare names": {c: c for c in LABELS},
    "L2 short phrases": {"focused": "focused attention", "mix": "mixed or exploratory attention", "others": "unreliable gaze evidence"},
    "L3 full definitions": DESCRIPTIONS,
}
TEMPLATES = {"T1 paper": "This clip is best described as {}.", "T2 attention": "The child's attention in this clip is {}.", "T3 definition": "{}"}
COMBINATIONS = [("L1 bare names", "T1 paper"), ("L1 bare names", "T2 attention"), ("L2 short phrases", "T1 paper"), ("L2 short phrases", "T2 attention"), ("L3 full definitions", "T3 definition")]
LEGACY_LABELS = ["inside_visible", "outside", "unsure"]
LEGACY_INTRO = (
    "You are an expert in child behavior analysis.\n"
    "Given the following structured features, classify gaze behavior.\n\n"
    "Return ONLY valid JSON with:\n"
    "- label (one of: inside_visible, outside, unsure)\n"
    "- confidence (0 to 1)\n"
    "- reasoning (short explanation)\n\n"
    "Features:\n"
)


def payload_json(names: list[str], values: dict[str, Column] | None = None) -> Column:
    """The features as a JSON object with sorted keys."""
    values = values or {}
    return F.to_json(F.struct(*[values.get(n, F.col(n)).alias(n) for n in sorted(names)]))


def prompt(payload: Column, labels: dict[str, str] = DESCRIPTIONS) -> Column:
    block = "\n".join(f"  - {k}: {v}" for k, v in labels.items())
    return F.concat(F.lit(INTRO + block + OUTRO), payload)


def legacy_prompt(payload: Column) -> Column:
    return F.concat(F.lit(LEGACY_INTRO), payload)


def insert_before(text: Column, addition: Column, anchor: str = ANCHOR) -> Column:
    """``addition`` before the first occurrence of the anchor; fails if there is none."""
    at = F.instr(text, anchor)
    put = F.concat(F.substring(text, F.lit(1), at - 1), addition, F.substring(text, at, F.length(text)))
    return F.when(at > 0, put).otherwise(F.raise_error(F.lit(f"no anchor: {anchor}")).cast("string"))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end, where ``trim`` takes blanks only."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def third(x: Column) -> Column:
    return F.when(x < 1 / 3, "low").when(x < 2 / 3, "medium").otherwise("high")


def binned(names: list[str]) -> dict[str, Column]:
    """Features as words: ratios and streaks by thirds, gaze motion by 100 and 200 pixels."""
    out = {c: third(F.col(c)) for c in RATIOS if c in names}
    out |= {c: third(F.when(F.col("observed_frames") != 0, F.col(c) / F.col("observed_frames")).otherwise(0.0)) for c in STREAKS if c in names}
    m = F.col("mean_gaze_motion")
    return out | {"mean_gaze_motion": F.when(m < 100, "low").when(m < 200, "medium").otherwise("high")}


def perturbed(names: list[str], seed: int, key: str = "child_id", share: float = 0.05) -> dict[str, Column]:
    """Every number times a uniform factor in 1 +- share, from md5 of (seed, key, feature); ratios clipped, counts rounded."""
    out = {}
    for c in names:
        if c == "dominant_gaze_class":
            continue
        v = F.col(c) * (F.lit(1.0 - share) + F.lit(2.0 * share) * md5_uniform(seed, key, F.lit(c)))
        v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) if c in RATIOS else v
        out[c] = F.rint(v).cast("long") if c in COUNTS else v
    return out


def conditions(features: DataFrame, seed: int = 20261005, mask: str = "dominant_gaze_class") -> DataFrame:
    """(child_id, condition, prompt) for C0 to C4: plain, guided, binned, one feature masked, perturbed."""
    base = prompt(payload_json(PAYLOAD))
    made = {
        "C0": base,
        "C1": insert_before(base, F.lit(GUIDANCE)),
        "C2": prompt(payload_json(PAYLOAD, binned(PAYLOAD))),
        "C3": prompt(payload_json([p for p in PAYLOAD if p != mask])),
        "C4": prompt(payload_json(PAYLOAD, perturbed(PAYLOAD, seed))),
    }
    rows = F.array(*[F.struct(F.lit(c).alias("condition"), p.alias("prompt")) for c, p in made.items()])
    return features.select("child_id", F.inline(rows))


def premises() -> dict[str, Column]:
    """P1: keys and values; P2: natural language."""
    pct = lambda c: F.format_string("%.0f%%", F.lit(100.0) * F.col(c))
    p1 = F.format_string(
        "Child gaze behavior summary. visible_ratio=%.3f, gaze_shift_ratio=%.3f, occlusion_ratio=%.3f, eyes_closed_ratio=%.3f, "
        "mean_gaze_motion=%.2f, attention_stability_score=%.3f, max_visible_streak=%d.",
        "visible_ratio", "gaze_shift_ratio", "occlusion_ratio", "eyes_closed_ratio", "mean_gaze_motion", "attention_stability_score", "max_visible_streak",
    )
    p2 = F.concat(
        F.lit("In this clip, the child's gaze is visible in "), pct("visible_ratio"), F.lit(" of the frames, shifts between targets in "), pct("gaze_shift_ratio"),
        F.lit(" of the frames, is occluded or uncertain in "), pct("occlusion_ratio"), F.lit(" of the frames, and the eyes are closed in "), pct("eyes_closed_ratio"),
        F.format_string(
            " of the frames. The longest uninterrupted visible stretch lasts %d of %d frames. The gaze point moves on average %.0f pixels between frames, "
            "and the attention stability score is %.2f out of 1.", "max_visible_streak", "observed_frames", "mean_gaze_motion", "attention_stability_score",
        ),
    )
    return {"P1": p1, "P2": p2}


def hypotheses(spark) -> DataFrame:
    """(label_set, template, label, hypothesis) of the five combinations."""
    rows = [(s, t, c, TEMPLATES[t].replace("{}", LABEL_SETS[s][c])) for s, t in COMBINATIONS for c in LABELS]
    return spark.createDataFrame(rows, "label_set string, template string, label string, hypothesis string")


def entailment_labels(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., label, confidence) from entailment logits (keys..., label, logit): softmax over labels, largest wins, ties in label order."""
    order = Window.partitionBy(*keys)
    top = F.max("logit").over(order)
    soft = scores.withColumn("_e", F.exp(F.col("logit") - top))
    return soft.groupBy(*keys).agg(F.max_by("label", F.struct("logit", -label_order(F.col("label")))).alias("label"), (F.max("_e") / F.sum("_e")).alias("confidence"))


def fewshot_examples(items: DataFrame, seed: int, keep: list[str] | None = None) -> DataFrame:
    """(item_id, place, example_id, label, keep...): for each item one example of each label from another cluster, in random order.

    ``items``: (item_id, cluster, label); ``keep`` names more of its columns, which travel with the examples. The items of a
    label stand in one order, cluster by cluster and by md5 within; those outside a cluster are all but one stretch of it. So
    a target draws a place among them by md5 and meets one row, however many items a label or a cluster has. What a cluster
    leaves of each label is a small row that every target gets, so its examples have their places before they are met.
    """
    kept = items.where("label is not null and cluster is not null")
    ranked = md5_rank(kept, ["label", "cluster"], "_rank", [seed, "item_id"], "item_id")
    counts = kept.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("_own"))
    by_cluster = Window.partitionBy("label").orderBy("cluster")  # a row for each label and cluster
    starts = counts.withColumn("_start", F.sum("_own").over(by_cluster) - F.col("_own"))
    order = ranked.join(F.broadcast(starts), ["label", "cluster"]).select("label", (F.col("_start") + F.col("_rank") - 1).alias("_at"), F.col("item_id").alias("example_id"), *(keep or []))
    totals = counts.groupBy("label").agg(F.sum("_own").alias("_all"))
    clusters = items.select("cluster").distinct().crossJoin(F.broadcast(totals))  # a few labels for each cluster
    room = clusters.join(starts, ["label", "cluster"], "left").fillna(0, ["_own", "_start"]).where("_all > _own")
    rooms = room.groupBy("cluster").agg(F.collect_list(F.struct("label", "_own", "_start", "_all")).alias("_rooms"))
    placed = F.array_sort(F.transform("_rooms", lambda r: F.struct(md5_int(seed, "item_id", F.lit("place"), r.label).alias("_md5"), r.label.alias("label"), r["_own"].alias("_own"), r["_start"].alias("_start"), r["_all"].alias("_all"))))
    targets = items.select("item_id", "cluster").join(F.broadcast(rooms), "cluster").select("item_id", F.posexplode(placed).alias("_pos", "r")).select("item_id", (F.col("_pos") + 1).alias("place"), "r.*")
    pick = F.pmod(md5_int(seed, "item_id", "label"), F.col("_all") - F.col("_own"))
    drawn = targets.withColumn("_pick", pick).select("item_id", "place", "label", F.when(F.col("_pick") < F.col("_start"), F.col("_pick")).otherwise(F.col("_pick") + F.col("_own")).alias("_at"))
    return drawn.join(order.hint("shuffle_hash"), ["label", "_at"]).select("item_id", "place", "example_id", "label", *(keep or []))  # one row for each key


def fewshot_prompts(prompts: DataFrame, examples: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """(item_id, prompt) with the examples before the anchor. prompts: (item_id, prompt); payloads: (item_id, payload), or none if examples have ``payload``."""
    text = F.concat(F.lit("Example "), F.col("place").cast("string"), F.lit(":\nFeatures:\n"), "payload", F.lit("\nCategory: "), "label", F.lit("\n\n"))
    told = examples if payloads is None else examples.join(payloads.withColumnRenamed("item_id", "example_id"), "example_id")
    block = told.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))).alias("e"))
    shown = F.concat(F.lit(FEWSHOT_INTRO), F.array_join(F.transform("e", lambda x: x.text), ""), F.lit(FEWSHOT_OUTRO))
    return prompts.join(block, "item_id").select("item_id", insert_before(F.col("prompt"), shown).alias("prompt"))


def payload_of(text: Column) -> Column:
    """The JSON object after ``Features:`` in a prompt; empty if there is none."""
    return F.regexp_extract(text, r"(?s)Features:\s*(\{.+\})", 1)


def _repaired(c: str, quotes: bool) -> str:
    more = max(0, c.count("{") - c.count("}"))
    if c == "" or c.endswith("}"):
        return c
    cut = quotes and more > 0 and '"reasoning"' in c  # taken as cut off inside the reasoning
    return c + '"' * cut + "}" * more


def _whole(digits: str) -> int | float:
    return int(digits) if len(digits) < 300 else float(digits)


def _strict_json(c: str) -> list:
    """The JSON value that ``c`` is, in a list; an empty list if it isn't exactly one value.

    The grammar is the standard's: no raw control characters in strings, no NaN, no other quotes, nothing behind the value. Of equal keys the last one counts.
    """
    try:
        return [json.loads(c, parse_constant=int, parse_int=_whole)]  # int("NaN") fails
    except (ValueError, RecursionError):
        return []


def _as_text(v) -> str:
    """A JSON value as Python's str() writes it, but for numbers and nested values, which are written as JSON."""
    return v if isinstance(v, str) else str(v) if v is None or isinstance(v, bool) else json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _read(raw: str, allowed: list[str], default: str, rescue: bool, repair_quotes: bool, fold: bool) -> tuple:
    """(label, confidence, reasoning, status, declared) of one text."""
    whole = raw.strip()
    first, last = whole.find("{"), whole.rfind("}")
    candidates = chain(  # lazily: most texts are JSON as a whole
        [whole], (m[1] for m in _FENCED.finditer(whole)), [whole[first : last + 1]] if -1 < first < last else [], [whole[first:]] if first > -1 else []
    )
    found = next((v for c in candidates if (v := _strict_json(_repaired(c.strip(), repair_quotes)))), [None])[0]
    if not isinstance(found, dict):
        return None, None, None, "no_json", None
    try:
        number = float(found.get("confidence", 0.0))
    except (TypeError, ValueError):
        return None, None, None, "invalid_confidence", None
    seen = (lambda c: c.strip().lower()) if fold else str.strip
    declared = seen(_as_text(found.get("label", default)))
    label = declared if declared in allowed else next((a for a in allowed if rescue and (a in declared or declared in a)), default)
    shown = _SHOWN.search(whole)
    status = "ok" if shown and seen(shown[1]) in allowed else "invalid_label"
    return label, max(0.0, min(1.0, number)), _as_text(found.get("reasoning", "")).strip(), status, declared


_FENCED = re.compile(r"```(?:json)?[ \t\n\x0b\f\r]*(.*?)[ \t\n\x0b\f\r]*```", re.S)
_SHOWN = re.compile(r'"label"[ \t\n\x0b\f\r]*:[ \t\n\x0b\f\r]*"([^"]*)"')
_PARSED = "struct<label: string, confidence: double, reasoning: string, status: string, declared: string>"


def parse_generation(raw: Column, allowed: list[str] = LABELS, default: str = "mix", rescue: bool = True, repair_quotes: bool = False, fold: bool = True) -> Column:
    """struct(label, confidence, reasoning, status, declared) of a generated text.

    Candidates are the whole text, fenced blocks, the widest braces, and the text from the first brace; missing braces at
    the end are added; the first that is strictly valid JSON counts. status: ``no_json`` (no label: no candidate is valid, or
    the first one is no object), ``invalid_confidence`` (no label: null, a list, an object, or a text that is no number),
    ``invalid_label`` (the text that the generation itself shows as its label isn't allowed, or it shows none), ``ok``. A missing
    confidence is 0, true is 1; NaN as a bare word is not JSON.

    Python's own JSON reader does it, an Arrow batch at a time; a text that occurs again in the batch is read once.
    """

    def work(column: pa.Array) -> pa.Array:
        codes = column.fill_null("").dictionary_encode()
        rows = [_read(x, allowed, default, rescue, repair_quotes, fold) for x in codes.dictionary.to_pylist()]
        fields = list(zip(*rows, strict=True)) or [()] * 5
        plain = lambda x: x if x is None else x.encode("utf-8", "replace").decode()  # a lone surrogate has no UTF-8
        parts = [pa.array(f, pa.float64()) if k == 1 else pa.array(map(plain, f), pa.string()) for k, f in enumerate(fields)]
        return pa.StructArray.from_arrays(parts, ["label", "confidence", "reasoning", "status", "declared"]).take(codes.indices)

    return F.arrow_udf(work, _PARSED)(raw)


def parse_legacy(raw: Column) -> Column:
    """The same for the older prompt: other labels, no rescue of near labels, a repair inside the reasoning."""
    return parse_generation(raw, LEGACY_LABELS, "unsure", rescue=False, repair_quotes=True, fold=False)


def raw_reproduction(pairs: DataFrame) -> DataFrame:
    """(system, n, identical, prefixes, extra_min, extra_median, extra_max) from (system, raw_a, raw_b)."""
    a, b = stripped(F.col("raw_a")), stripped(F.col("raw_b"))
    extra = F.when(b.startswith(a) & (a != b), F.length(b) - F.length(a))
    return pairs.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(a == b).alias("identical"),
        F.count_if(b.startswith(a)).alias("prefixes"),
        F.min(extra).alias("extra_min"),
        F.median(extra).alias("extra_median"),
        F.max(extra).alias("extra_max"),
    )


def vote_text(counts: dict[str, Column]) -> Column:
    """``mix 6, focused 1``: labels with votes, most first, ties in label order."""
    votes = F.array_sort(
        F.filter(F.array(*[F.struct((-v).alias("minus"), F.lit(k).alias("order"), F.lit(c).alias("label")) for k, (c, v) in enumerate(counts.items())]), lambda x: x.minus < 0)
    )
    return F.array_join(F.transform(votes, lambda x: F.concat(x.label, F.lit(" "), (-x.minus).cast("string"))), ", ")


def vote_counts(text: Column) -> dict[str, Column]:
    """The counts in a vote text."""
    table = F.str_to_map(text, F.lit(", "), F.lit(" "))
    return {c: F.coalesce(F.try_element_at(table, F.lit(c)).cast("int"), F.lit(0)) for c in LABELS}
