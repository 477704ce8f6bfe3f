"""The study's tables made from general-purpose ones: frames from events, ratings from orders, systems from ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.functions.hashing import md5_int
from gazeframe.operators import labels, sequences

#: (system, per cent of labels that differ from the consensus, or -1: always ``focused``).
SYSTEMS = [
    ("rule_based", 15),
    ("llm_models_Qwen--Qwen2_5-72B-Instruct", 20),
    ("llm_models_01-ai--Yi-1_5-9B-Chat", 27),
    ("llm_models_microsoft--Phi-4-mini-instruct", 33),
    ("supervised_RandomForest", 25),
    ("supervised_Dummy_majority", -1),
    ("nli_bart", 55),
    ("deberta", 60),
]
GENERATION_KINDS = 16


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sequence for each user of ``events``, a frame for each event."""
    return _read(spark, sf_dir, "events").selectExpr(
        "concat('u', user_id) as clip",
        "concat('u', user_id, ':person_1') as child_id",
        "1 as person_id",
        "cast(row_number() over (partition by user_id order by ts, event_id) as int) as frame",
        "cast(event_id % 50 as double) as bbox_x",
        "cast(event_id % 40 as double) as bbox_y",
        "cast(40 + event_id % 20 as double) as bbox_width",
        "cast(40 + event_id % 25 as double) as bbox_height",
        """case when user_id % 2 = 0 and event_id % 5 <> 0 then 'inside_visible'
                when user_id % 7 = 0 and event_type in ('signup', 'error') then 'eyes_closed'
                when user_id % 11 = 0 and event_type in ('signup', 'click') then 'inside_uncertain'
                when event_type = 'view' then 'inside_visible' when event_type = 'click' then 'gaze_shift'
                when event_type = 'purchase' then 'inside_occluded' when event_type = 'signup' then 'outside_frame'
                when event_id % 3 = 0 then 'inside_ambiguous' else 'eyes_closed' end as gaze_class""",
        "value * (case when user_id % 4 = 0 then 0.1D else 1.0D end) as gaze_x",
        "cast(event_id % 97 as double) * (case when user_id % 4 = 0 then 0.1D else 1.0D end) as gaze_y",
        "case when user_id % 10 = 0 then 0 else 1 end as is_child",
        "case user_id % 3 when 0 then 2.4D when 1 then 2.5D else 3.0D end as fps",
        "user_id % 10 as channel_id",
        "user_id % 21 as video_id",
    )


def child_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.children(frames(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.features(child_frames(spark, sf_dir))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, cluster, fine_cluster, rater1, rater2, consensus): an item for each order; the second rater via a five-class label."""
    status = F.when(F.col("o_orderstatus") == "O", "focused_attention").when(F.col("o_orderstatus") == "F", "mixed_attention").otherwise("occluded_attention")
    urgency = F.substring("o_orderpriority", 1, 1)
    other = F.when(urgency == "1", "focused_attention").when(urgency == "2", "mixed_attention").when(urgency == "3", "exploratory_attention").when(urgency == "4", "occluded_attention").otherwise("reduced_visual_availability")
    five = F.when(md5_int(F.lit("r2"), "item_id") % 100 < 70, status).otherwise(other)
    joined = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rated = joined.select(
        F.col("o_orderkey").alias("item_id"), F.col("c_nationkey").alias("cluster"), F.col("o_custkey").alias("fine_cluster"), "o_orderstatus", "o_orderpriority"
    )
    said = rated.select("item_id", "cluster", "fine_cluster", status.alias("_one"), five.alias("_two"))  # columns, as the map reads a label several times
    both = F.struct(labels.to_three(F.col("_one")).alias("rater1"), labels.to_three(F.col("_two")).alias("rater2"))
    raters = said.select("item_id", "cluster", "fine_cluster", F.inline(F.array(both)))  # filters on ratings stay behind ``inline``, where they don't read the map again
    pick = F.when((F.col("rater1") == F.col("rater2")) | (md5_int(F.lit("consensus"), "item_id") % 2 == 0), F.col("rater1")).otherwise(F.col("rater2"))
    return raters.withColumn("consensus", pick)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system, item_id, label, confidence) of eight systems; one of them lacks some labels."""
    grid = spark.createDataFrame(SYSTEMS, "system string, error int")
    rows = ratings(spark, sf_dir).select("item_id", "consensus").crossJoin(F.broadcast(grid))
    rows = rows.withColumn("u", md5_int(F.lit("label"), "system", "item_id"))
    u, order = F.col("u"), labels.label_order(F.col("consensus")) - 1
    turned = F.element_at(F.array(*[F.lit(c) for c in labels.LABELS]), (F.pmod(order + 1 + F.floor(u / 100) % 2, F.lit(3)) + 1).cast("int"))
    label = F.when(F.col("error") < 0, "focused").when(u % 100 < F.col("error"), turned).otherwise(F.col("consensus"))
    missing = (F.col("system") == "nli_bart") & (md5_int(F.lit("missing"), "item_id") % 20 == 0)
    confidence = F.round((md5_int(F.lit("confidence"), "system", "item_id") % 101) / F.lit(100.0), 2)
    # ``inline`` keeps filters on labels from being pushed down to where they would draw each label again
    labelled = rows.select("system", "item_id", F.inline(F.array(F.struct(F.when(~missing, label).alias("label")))))
    return labelled.select("system", "item_id", "label", confidence.alias("confidence"))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system, item_id, kind, raw): the LLM systems' labels as generated text of GENERATION_KINDS kinds."""
    p = predictions(spark, sf_dir).where("system like 'llm%'")
    kind = (md5_int(F.lit("kind"), "system", "item_id") % GENERATION_KINDS).cast("int")
    confidence = F.format_string("%.2f", "confidence")
    obj = F.concat(F.lit('{"label": "'), "label", F.lit('", "confidence": '), confidence, F.lit(', "reasoning": "seen in the clip"}'))
    raw = (
        F.when(F.col("kind") == 0, obj)
        .when(F.col("kind") == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(F.col("kind") == 2, F.concat(F.lit("Sure, here it is: "), obj, F.lit(" Hope this helps.")))
        .when(F.col("kind") == 3, F.concat(F.lit("  "), F.substring(obj, F.lit(1), F.length(obj) - 1)))
        .when(F.col("kind") == 4, F.concat(F.lit('{"label": "banana", "confidence": '), confidence, F.lit("}")))
        .when(F.col("kind") == 5, F.concat(F.lit("I cannot tell, maybe "), "label"))
        .when(F.col("kind") == 6, F.concat(obj, F.lit("\n")))
        .when(F.col("kind") == 7, F.concat(F.lit("\n\t "), obj, F.lit(" \r\n\t")))
        .when(F.col("kind") == 8, F.concat(F.lit('\n{"label": "\\t'), F.initcap("label"), F.lit(' \\n", "confidence": '), confidence, F.lit("}\n")))
        .when(F.col("kind") == 10, F.concat(F.lit('{"label": "'), "label", F.lit('", "confidence": '), confidence, F.lit(', "reasoning": "first line\nsecond line"}')))
        .when(F.col("kind") == 11, F.concat(F.lit('{"label": "banana", "confidence": 2, "label": "'), "label", F.lit('", "confidence": '), confidence, F.lit("}")))
        .when(F.col("kind") == 12, F.concat(F.lit('{"label": "'), "label", F.lit('", "confidence": true}')))
        .when(F.col("kind") == 13, F.concat(F.lit("["), obj, F.lit("]")))
        .when(F.col("kind") == 14, F.concat(F.lit('{"confidence": " '), confidence, F.lit('", "label": "'), "label", F.lit('"}')))
        .when(F.col("kind") == 15, F.concat(F.lit('{"label": "'), "label", F.lit('", "confidence": NaN}')))
        .otherwise(F.concat(F.lit('The answer:\n```\n{"label": "rather \\"'), "label", F.lit('\\" I think", "confidence": '), confidence, F.lit("\n```\n")))
    )
    return p.withColumn("kind", kind).select("system", "item_id", "label", "confidence", "kind", raw.alias("raw"))


CONDITIONS = ["C0", "C1", "C2"]


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system, condition, item_id, label, status) of the LLM systems; conditions after the first change some labels."""
    rows = predictions(spark, sf_dir).where("system like 'llm%'").withColumn("condition", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])))
    u = F.col("u")
    label = F.when((F.col("condition") != "C0") & (u % 10 < 2), "mix").otherwise(F.col("label"))
    status = F.when(u % 25 == 0, "no_json").when(u % 25 == 1, "invalid_label").otherwise("ok")
    drawn = rows.withColumn("u", md5_int("condition", "system", "item_id")).select("system", "condition", "item_id", "u", F.inline(F.array(F.struct(label.alias("label")))))
    return drawn.select("system", "condition", "item_id", "label", status.alias("status"))


def rule_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where("system = 'rule_based'").select("item_id", F.col("label").alias("rule_label"))
