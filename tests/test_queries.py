"""Registered queries against their SQL, on the smallest tables where these are there."""

import hashlib
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from gazeframe.plans import driver_tables as tables
from gazeframe.plans import queries as study

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["seq_features", "segments", "interactions", "rule_labels", "stability_sensitivity", "hybrid_vote_sweep", "system_metrics", "confusion", "mcnemar_pairs", "holm_adjusted", "calibration", "boot_cluster_ci", "parse_generations", "fewshot_examples", "prompt_conditions", "clip_source_frames", "condition_metrics", "perm_null_rank", "boot_item_ci", "perm_null", "parse_legacy", "raw_repro"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(frame, columns):
    number = lambda v: bool(v) if isinstance(v, (bool, np.bool_)) else int(v) if isinstance(v, (int, np.integer)) else float(v) if isinstance(v, (float, np.floating)) else v
    rows = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(repr(tuple(map(number, r))) for r in rows.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(want.columns))


def test_enough_replicates():
    assert study.RESAMPLES == 1000 and study.PERMUTATIONS == 5000


def test_null_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(study, "SHUFFLES", 3)
    kinds = study.LABELS
    md5 = lambda *keys: int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16)
    rated = {i: (kinds[md5("a", i) % 3], kinds[md5("b", i) % 3]) for i in range(60)}
    labelled = {(s, i): kinds[md5(s, i) % 3] for s in ("x", "y", "z") for i in range(60) if s != "z" or i % 7}
    p = spark.createDataFrame([(s, i, c) for (s, i), c in labelled.items()], "system string, item_id long, label string")
    r = spark.createDataFrame([(i, a, b) for i, (a, b) in rated.items()], "item_id long, rater1 string, rater2 string")

    def kappa(pairs):
        agree = sum(a == b for a, b in pairs) / len(pairs)
        chance = sum(sum(a == c for a, _ in pairs) * sum(b == c for _, b in pairs) for c in kinds) / len(pairs) ** 2
        return (agree - chance) / (1 - chance)

    got = {(row["system"], row["rep"]): row["delta"] for row in study._null_rank(p, r).collect()}
    assert len(got) == 9
    for (s, rep), delta in got.items():
        items = [i for t, i in labelled if t == s]
        moved = sorted(items, key=lambda i: (md5(study.SEED, s, rep, i), i))
        mixed = dict(zip(moved, [labelled[s, i] for i in sorted(items, key=lambda i: (md5("place", i), i))], strict=True))
        assert delta == pytest.approx(kappa([(rated[i][0], mixed[i]) for i in items]) - kappa([(rated[i][1], mixed[i]) for i in items]), abs=1e-6)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dead_letters_read_each_text_once(spark):
    plan = study.dead_letters(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["dead_letters"])
def test_more_against_sql(spark, name):
    test_against_sql(spark, name)


def test_halves_round_as_in_sql(spark):
    ratios = [(k / n,) for n in (8, 40, 80, 160, 200, 640) for k in range(n)] + [(-0.575,), (float("nan"),), (None,)]
    got = spark.createDataFrame(ratios, "x double").select("x", *[study.round_as_sql("x", p).alias(f"r{p}") for p in (2, 3, 6)]).collect()
    con = duckdb.connect()
    for r in got:
        want = con.execute("select round($1::double, 2), round($1::double, 3), round($1::double, 6)", [r["x"]]).fetchall()[0]
        assert repr(want) == repr((r["r2"], r["r3"], r["r6"])), r["x"]
    assert (0.57,) in {(r["r2"],) for r in got if r["x"] == 46 / 80}


@pytest.mark.parametrize("name", ["fewshot_prompts"])
def test_fewshot_against_sql(spark, name):
    test_against_sql(spark, name)


def test_disagreement_zone_draws_each_label_once(spark):
    """A filter on ratings or labels must not make the plan draw them again, and the many predictions are not sorted."""
    query = study.disagreement_zone(spark, SF)._jdf.queryExecution()
    plan = query.optimizedPlan().toString()
    assert plan.count("concat_ws(|, label,") == 1 and plan.count("concat_ws(|, r2,") == 2  # once for ratings, once for those that predictions start from
    assert "SortMergeJoin" not in query.executedPlan().toString()
    test_against_sql(spark, "disagreement_zone")


@pytest.mark.parametrize("name", ["condition_kappa", "boot_kappa_multinomial"])
def test_predictions_are_counted_unsorted(spark, name):
    """Items are hashed where predictions meet them, so that a task's memory goes with items; labels are drawn once for each join."""
    query = entry.queries()[name](spark, SF)._jdf.queryExecution()
    joins = {"condition_kappa": 2, "boot_kappa_multinomial": 1}[name]
    assert query.executedPlan().toString().count("ShuffledHashJoin") == joins
    plan = query.optimizedPlan().toString()
    assert plan.count("concat_ws(|, condition") == (joins if name == "condition_kappa" else 0)
    assert plan.count("concat_ws(|, label,") == {"condition_kappa": 3, "boot_kappa_multinomial": 1}[name]  # the rule's labels are a table of their own
    test_against_sql(spark, name)
