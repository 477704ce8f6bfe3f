import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeframe.operators import learn
from gazeframe.schema import LABELS, MODEL_FEATURES
from gazeframe.sources import sinks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = [(i, LABELS[i % 3], i % 5, *[float(i % 3 + rng.normal(0, 0.3)) if k == 0 else float(rng.normal()) for k in range(len(MODEL_FEATURES))]) for i in range(240)]
    return spark.createDataFrame(data, ["item_id", "label", "group", *MODEL_FEATURES]).cache()


def test_folds(rows):
    got = learn.folds(rows).groupBy("label", "fold").count().collect()
    assert len(got) == 15 and all(r["count"] == 16 for r in got)
    assert learn.leave_one_group_out(rows, "group").select("group", "fold").distinct().count() == 5


@pytest.mark.parametrize("name", ["logistic", "linear_svm", "random_forest", "boosted"])
def test_out_of_fold(rows, name):
    folded = learn.folds(rows, most=2)
    out = learn.out_of_fold(folded, name, 2, trees=10, rounds=8).join(rows.select("item_id", "label"), "item_id")
    r = learn.cv_summary(out).first()
    assert out.count() == 240 and out.select("item_id").distinct().count() == 240
    assert r["folds"] == 2 and r["accuracy_mean"] > 0.7
    assert out.where("confidence is null").count() == (240 if name == "linear_svm" else 0)


def test_importance(rows):
    model = learn.fit(rows, learn.classifiers(240, trees=10)["random_forest"])
    assert learn.impurity_importance(model)[0][0] == MODEL_FEATURES[0]
    top = learn.permutation_importance(model, rows, repeats=2).orderBy("drop_mean", ascending=False).first()
    assert top["feature"] == MODEL_FEATURES[0] and top["drop_mean"] > 0.2


def test_dummy(rows):
    assert learn.dummy(rows).select("predicted").distinct().count() == 1
    assert learn.dummy(rows, "stratified").select("predicted").distinct().count() == 3


def test_schemes_side_by_side(rows):
    """Both schemes, each row once for each, by models that never saw its fold; a fold of the only other class is missed wholly."""
    schemes = {"stratified": lambda df: learn.folds(df, most=2), "by_group": lambda df: learn.leave_one_group_out(df, "group")}
    got = learn.cross_validate(rows, schemes, ["logistic"])
    assert {(r["scheme"], r["n"]) for r in got.groupBy("scheme").agg(F.count_distinct("item_id").alias("n")).collect()} == {("stratified", 240), ("by_group", 240)}
    assert got.count() == 480
    own = rows.where("label <> 'others'").withColumn("group", F.col("label"))
    unseen = learn.cross_validate(own, {"by_class": lambda df: learn.leave_one_group_out(df, "group")}, ["logistic"])
    assert unseen.count() == 160 and unseen.where("predicted = label").count() == 0


def test_logistic_regression_and_scaling_against_numpy(rows):
    table = rows.toPandas().sort_values("item_id")
    x, y = table[MODEL_FEATURES].to_numpy(float), table["label"].map(LABELS.index).to_numpy()
    model = learn.fit(rows, learn.classifiers(240)["logistic"])
    assert np.allclose([model.scales[c][1] for c in MODEL_FEATURES], x.std(0)) and np.allclose([model.scales[c][0] for c in MODEL_FEATURES], x.mean(0))
    x = (x - x.mean(0)) / x.std(0)
    one = np.eye(3)[y]
    w, b = np.zeros((x.shape[1], 3)), np.zeros(3)
    for _ in range(4000):  # plain gradient steps on the sum of losses and half the squared weights
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 0.01 * (x.T @ (p - one) + w) / 10
        b -= 0.01 * (p - one).sum(0) / 10
    got = {r["item_id"]: r for r in learn.predict(model, rows).collect()}
    assert all(got[i]["predicted"] == LABELS[k] for i, k in zip(table["item_id"], p.argmax(1), strict=True))
    assert np.allclose([got[i]["confidence"] for i in table["item_id"]], p.max(1), atol=5e-3)


def test_bundle(spark, rows, tmp_path):
    """All parts and the manifest are there, an existing bundle is refused, a bundle that lost a part or rows is not read."""
    predicted = rows.select(F.lit("s").alias("system"), "item_id", "label", F.lit("mix").alias("predicted"), (F.col("item_id") % 2).cast("int").alias("fold"))
    path = f"file://{tmp_path}/bundle"
    learn.save_results(learn.cv_summary(predicted), predicted, path)
    got = {r["name"]: r["rows"] for r in sinks.read_manifest(spark, path).collect()}
    assert got == {"summary": 1, "predictions": 240, "confusion": 4, "reports": 3}
    assert spark.read.json(f"{path}/summary.json", multiLine=True).first()["folds"] == 2
    with pytest.raises(FileExistsError):
        learn.save_results(learn.cv_summary(predicted), predicted, path)
    predicted.limit(3).write.mode("overwrite").parquet(f"{path}/predictions")
    with pytest.raises(Exception, match="not the rows"):
        sinks.read_manifest(spark, path).collect()


def test_forests_keep_their_rows_nodes(spark):
    """Else each level sends all trees to the tasks and walks every row down from every root."""
    assert learn.classifiers(10)["random_forest"].getCacheNodeIds()


def test_places_are_ranked_once(spark):
    rows = spark.createDataFrame([(i, "mix" if i % 2 else "focused", float(i % 2), float(i)) for i in range(40)], "item_id long, label string, a double, b double")
    model = learn.fit(rows, learn.classifiers(40, trees=3)["random_forest"], ["a", "b"])
    drops = learn.permutation_importance(model, rows, 2, features=["a", "b"])
    plan = drops._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 2 and drops.count() == 2


def test_importance_by_lots_of_trees(rows, monkeypatch):
    """One lot gives the forest's own importance; with many rows no fit holds more trees than the bounds, all trees are there, and the greatest stays first."""
    forest = learn.classifiers(240, trees=12)["random_forest"]
    whole = dict(learn.impurity_importance(learn.fit(rows, forest)))
    assert dict(learn.forest_importance(rows, forest)) == pytest.approx(whole, abs=1e-12)
    lots, own = [], type(forest)._fit
    monkeypatch.setattr(type(forest), "_fit", lambda self, df: lots.append((self.getNumTrees(), self.getSeed())) or own(self, df))
    monkeypatch.setattr(learn, "MOST_TREE_ROWS", 5 * 240)
    monkeypatch.setattr(learn, "MOST_NODES", 500)
    found = learn.forest_importance(rows, forest)
    assert sum(n for n, _ in lots) == 12 and lots[0][0] == 2 and max(n for n, _ in lots) <= 5 and len({s for _, s in lots}) == len(lots)
    assert found[0][0] == MODEL_FEATURES[0] and sum(v for _, v in found) == pytest.approx(1) and dict(found) == pytest.approx(whole, abs=0.1)


def test_the_query_fits_its_forest_by_lots(spark, monkeypatch):
    from gazeframe.plans import queries as study

    sizes, own = [], learn.RandomForestClassifier._fit
    monkeypatch.setattr(learn.RandomForestClassifier, "_fit", lambda self, df: sizes.append(self.getNumTrees()) or own(self, df))
    monkeypatch.setattr(study, "_learnable", lambda s, d: s.createDataFrame([(i, LABELS[i % 3], *[float((i * 7 + k) % 11) for k in range(len(MODEL_FEATURES))]) for i in range(60)], ["item_id", "label", *MODEL_FEATURES]))
    monkeypatch.setattr(learn, "MOST_TREE_ROWS", 60 * 200)
    assert study.impurity_importance(spark, "").count() == len(MODEL_FEATURES)
    assert sum(sizes) == 500 and max(sizes) <= 200
