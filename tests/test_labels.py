import pytest
from pyspark.sql import functions as F

from gazeframe.operators import labels


def test_to_three(spark):
    given = ["focused_attention", "mixed_attention", "exploratory_attention", "occluded_attention", "reduced_visual_availability", "focused", "mix", "others", " mix ", None, ""]
    want = ["focused", "mix", "mix", "others", "others", "focused", "mix", "others", "mix", None, None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, label string")
    assert [r[0] for r in df.orderBy("i").select(labels.to_three(F.col("label"))).collect()] == want
    bad = spark.createDataFrame([("banana",), ("  ",)], "label string")
    assert [r[0] for r in bad.select(labels.unknown_label(F.col("label"))).collect()] == [True, True]
    with pytest.raises(Exception, match="unknown label"):
        bad.select(labels.to_three(F.col("label"))).collect()


def test_weight_sets():
    sets = dict(labels.weight_sets())
    assert len(sets) == 18 and all(abs(sum(w) - 1) < 1e-9 for w in sets.values())


def test_votes(spark):
    p = spark.createDataFrame([(1, "a", "mix"), (1, "b", "focused"), (2, "a", "others"), (2, "b", "others"), (3, "a", None), (3, "b", "mix")], "item_id int, system string, label string")
    assert {r[0]: r[1] for r in labels.majority(p).collect()} == {1: "focused", 2: "others", 3: "mix"}
    assert {r[0]: r[1] for r in labels.agreement_pattern(p).collect()} == {1: "split_2_ways", 2: "all_agree", 3: "all_agree"}


def test_hybrid(spark):
    rows = [(1, False, "mix", 1, 0, 1, 2), (2, True, "mix", 2, 0, 0, 2), (3, False, "others", 1, 1, 0, 2)]
    items = spark.createDataFrame(rows, "item_id int, gated boolean, rule_label string, votes_focused long, votes_mix long, votes_others long, voters long")
    got = {(r["item_id"], r["alpha"]): r["label"] for r in labels.alpha_sweep(items).collect()}
    assert len(got) == 33
    assert (got[1, 0.0], got[1, 1.0], got[2, 0.0], got[3, 0.0], got[3, 1.0]) == ("focused", "mix", "others", "focused", "others")


def test_names(spark):
    names = ["rule_based", "llm_models_x", "supervised_Dummy_majority", "supervised_RF", "bart", "nli_x", "other"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r[0] for r in df.select(labels.family(F.col("s"))).collect()] == ["rule", "llm", "dummy", "supervised", "nli", "nli", "supervised"]
    one = spark.createDataFrame([("llm_models_Qwen--Qwen2_5-7B-Instruct_3class",)], "s string")
    assert one.select(labels.short_name(F.col("s"))).first()[0] == "Qwen2.5-7B"
