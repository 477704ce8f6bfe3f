"""Supervised systems with MLlib: folds, out-of-fold predictions, importances.

Folds come from md5 ranks within each class, so they are the same on any partitioning. Scaling is fitted inside a fold.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.functions.hashing import md5_rank, md5_uniform
from gazeframe.operators import agreement
from gazeframe.schema import MODEL_FEATURES
from gazeframe.sources.shared import shared_folder, stored
from gazeframe.sources.sinks import write_bundle

#: Rows times trees that a lot of a forest is fitted to, at about 12 bytes each over all executors; nodes of a lot, at
#: about a kilobyte each on the driver. One tree is the least.
MOST_TREE_ROWS = 20_000_000
MOST_NODES = 200_000


def folds(rows: DataFrame, seed: int = 42, most: int = 5, key: str = "item_id") -> DataFrame:
    """Adds ``fold``: stratified; as many folds as the rarest class has items, from 2 to ``most``."""
    counts = rows.groupBy("label").count().agg(F.min("count").alias("rarest"))
    k = F.greatest(F.lit(2), F.least(F.lit(most), F.col("rarest")))
    ranked = md5_rank(rows, ["label"], "_place", [seed, key], key)
    return ranked.crossJoin(F.broadcast(counts)).withColumn("fold", F.pmod(F.col("_place") - 1, k).cast("int")).drop("rarest", "_place")


def leave_one_group_out(rows: DataFrame, group: str) -> DataFrame:
    """Adds ``fold``: the rank of the row's group among all groups."""
    groups = rows.select(group).distinct()
    return rows.join(F.broadcast(groups.withColumn("fold", (F.dense_rank().over(Window.orderBy(group)) - 1).cast("int"))), group)


def with_labels(features: DataFrame, labels: DataFrame, key: str = "child_id") -> tuple[DataFrame, DataFrame]:
    """Features of the labelled items with their labels; and one row (n_missing): labelled items that have no features."""
    return features.join(labels, key), labels.join(features.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))


def balanced_weights(rows: DataFrame) -> DataFrame:
    """Adds ``weight`` = n / (classes * n of the class)."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return rows.join(F.broadcast(counts.crossJoin(total)), "label").withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def classifiers(n_rows: int, trees: int = 200, rounds: int = 200, seed: int = 42) -> dict:
    """Logistic regression, linear SVM, random forest and boosted trees over ``scaled`` and ``y``.

    The penalty of the logistic regression is the mean loss's, hence 1 / n for a penalty of 1 on the sum.
    """
    common = {"featuresCol": "scaled", "labelCol": "y"}
    return {
        "logistic": LogisticRegression(**common, family="multinomial", regParam=1.0 / max(1, n_rows), standardization=False, maxIter=2000),
        "linear_svm": OneVsRest(classifier=LinearSVC(maxIter=5000, tol=1e-4, regParam=1.0 / max(1, n_rows), standardization=False), **common),
        "random_forest": RandomForestClassifier(**common, numTrees=trees, maxDepth=30, weightCol="weight", seed=seed, cacheNodeIds=True),
        "boosted": Boosted(GBTClassifier(**common, maxIter=rounds, maxDepth=4, stepSize=0.1, seed=seed, validationIndicatorCol="held", validationTol=1e-3)),
    }


class Boosted:
    """One set of boosted trees for each class against the others; each stops when the rows held for it no longer gain.

    One row in five is held, by its features' hash. ``transform`` adds ``prediction`` and ``probability``, the classes' own
    probabilities made to add up to one.
    """

    def __init__(self, stage: GBTClassifier):
        self.stage, self.models = stage, []

    def fit(self, train: DataFrame) -> Boosted:
        made = Boosted(self.stage)
        rows = train.withColumn("held", F.pmod(F.xxhash64(F.lit(7), vector_to_array("scaled")), F.lit(5)) == 0).withColumn("class", F.col("y")).drop("y")
        for k in [r[0] for r in rows.select("class").distinct().orderBy("class").collect()]:  # classes are few
            made.models.append((k, self.stage.fit(rows.withColumn("y", (F.col("class") == k).cast("double")))))
        return made

    def transform(self, rows: DataFrame) -> DataFrame:
        own = []
        for i, (_, model) in enumerate(self.models):
            rows = model.transform(rows).withColumn(f"_p{i}", F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")
            own.append(F.col(f"_p{i}"))
        total = F.greatest(sum(own, F.lit(0.0)), F.lit(1e-12))
        best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-k).alias("k")) for p, (k, _) in zip(own, self.models, strict=True)])).k
        return rows.withColumn("prediction", -best).withColumn("probability", array_to_vector(F.array(*[p / total for p in own]))).drop(*[f"_p{i}" for i in range(len(own))])


class Model:
    """A fitted classifier with the scaling and the labels of its training rows."""

    def __init__(self, labels: list[str], scales: dict[str, tuple[float, float]], stage):
        self.labels, self.scales, self.stage = labels, scales, stage

    def scaled(self, rows: DataFrame) -> DataFrame:
        parts = [(F.col(c).cast("double") - F.lit(mean)) / F.lit(spread or 1.0) for c, (mean, spread) in self.scales.items()]
        return rows.withColumn("scaled", array_to_vector(F.array(*parts)))


def _prepared(train: DataFrame, features: list[str]) -> tuple[Model, DataFrame]:
    """A model that only scales as yet, and the rows that train it: scaled, y, weight."""
    summary = train.agg(F.array_sort(F.collect_set("label")).alias("labels"), *[f(c).alias(f"{n}_{c}") for c in features for n, f in (("mean", F.avg), ("spread", F.stddev_pop))]).first()
    model = Model(summary["labels"], {c: (summary[f"mean_{c}"] or 0.0, summary[f"spread_{c}"] or 0.0) for c in features}, None)
    known = F.array(*[F.lit(x) for x in model.labels])
    rows = model.scaled(balanced_weights(train.where("label is not null"))).withColumn("y", (F.array_position(known, F.col("label")) - 1).cast("double"))
    return model, rows.select("scaled", "y", "weight").persist()  # every round of a fit reads them; a lost block is computed again


def fit(train: DataFrame, classifier, features: list[str] = MODEL_FEATURES) -> Model:
    """A model of ``train`` (label, features); a class that isn't there can't be predicted. Scaling is by the mean and the population deviation."""
    model, rows = _prepared(train, features)
    model.stage = classifier.fit(rows)
    rows.unpersist()
    return model


def predict(model: Model, rows: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, predicted, confidence); confidence is null for models without probabilities. Rows need no label."""
    scored = model.stage.transform(model.scaled(rows))
    confidence = F.array_max(vector_to_array("probability")) if "probability" in scored.columns else F.lit(None).cast("double")
    named = F.get(F.array(*[F.lit(x) for x in model.labels]), F.col("prediction").cast("int"))
    return scored.select(key, named.alias("predicted"), confidence.alias("confidence"))


def cross_validate(rows: DataFrame, schemes: dict[str, Callable[[DataFrame], DataFrame]], names: list[str], key: str = "item_id", at_once: int = 4, **options) -> DataFrame:
    """(scheme, model, key, label, fold, predicted, confidence): every row predicted by models that never saw its fold.

    ``rows``: key, label, features. A scheme adds ``fold`` to them. Rows with their folds are written once; ``at_once``
    fits run side by side, each a set of Spark jobs of its own, and each writes what it predicts. A fold whose training rows
    have one class only is predicted to be of that class.
    """
    written = {s: stored(add(rows), f"folds-{s}") for s, add in schemes.items()}
    out = shared_folder(rows.sparkSession, "out-of-fold")
    jobs = [(s, m, r["fold"], r["n"]) for s, df in written.items() for r in _training_sizes(df) for m in names]

    def run(job: tuple[str, str, int, int]) -> None:
        scheme, name, fold, n = job
        df = written[scheme]
        train = df.where(F.col("fold") != fold).drop("fold")
        held = df.where(F.col("fold") == fold).drop("fold", "label")
        classes = [r[0] for r in train.select("label").distinct().limit(2).collect()]
        if len(classes) < 2:
            got = held.select(key, F.lit(classes[0] if classes else None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("confidence"))
        else:
            got = predict(fit(train, classifiers(n, **options)[name]), held, key)
        got.withColumn("fold", F.lit(fold)).write.parquet(f"{out}/scheme={scheme}/model={name}/part={fold}")

    with ThreadPool(at_once) as pool:
        pool.map(inheritable_thread_target(rows.sparkSession)(run), jobs, chunksize=1)
    found = rows.sparkSession.read.parquet(out).drop("part")
    return found.join(rows.select(key, "label"), key)


def _training_sizes(folded: DataFrame) -> list:
    """(fold, n): folds are as few as their scheme's groups."""
    sizes = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("own"))
    total = sizes.agg(F.sum("own").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select("fold", (F.col("total") - F.col("own")).alias("n")).orderBy("fold").collect()


def out_of_fold(rows: DataFrame, name: str, n_folds: int | None = None, key: str = "item_id", **options) -> DataFrame:
    """(key, predicted, confidence, fold) of every row by a model that never saw its fold. rows: key, label, fold, features."""
    plain = rows.drop("fold")
    folds_ = rows.select(key, "fold")
    return cross_validate(plain, {"given": lambda df: df.join(folds_, key)}, [name], key, **options).select(key, "predicted", "confidence", "fold")


def dummy(rows: DataFrame, strategy: str = "majority", seed: int = 42, key: str = "item_id") -> DataFrame:
    """(key, predicted): the most frequent label, or labels drawn by their shares with md5 uniforms."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if strategy == "majority":
        top = counts.agg(F.max_by("label", F.struct("n", "label")).alias("predicted"))
        return rows.select(key).crossJoin(F.broadcast(top))
    order = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = counts.withColumn("hi", F.sum("n").over(order) / F.sum("n").over(Window.partitionBy(F.lit(0))))
    table = shares.agg(F.array_sort(F.collect_list(F.struct("hi", "label"))).alias("table"))
    u = md5_uniform(seed, key)
    return rows.select(key).crossJoin(F.broadcast(table)).select(key, F.element_at(F.filter("table", lambda t: t.hi > u), 1).label.alias("predicted"))


def majority_out_of_fold(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, predicted, fold): the most frequent label of the other folds (ties: last in the alphabet). Counts by fold and label suffice."""
    counts = rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("label").agg(F.sum("n").alias("all"))
    folds_ = counts.select("fold").distinct().crossJoin(F.broadcast(total))
    rest = folds_.join(counts, ["fold", "label"], "left").withColumn("rest", F.col("all") - F.coalesce("n", F.lit(0)))
    best = rest.groupBy("fold").agg(F.max_by("label", F.struct("rest", "label")).alias("predicted"))
    return rows.select(key, "fold").join(best, "fold").select(key, "predicted", "fold")


def save_results(summary: DataFrame, predicted: DataFrame, path: str) -> None:
    """The bundle of a cross-validation: summary, predictions (system, item_id, label, predicted, fold), confusion matrices, class reports."""
    rows = predicted.select("system", F.col("label").alias("truth"), F.col("predicted").alias("label"))
    cells = agreement.cells(rows, ["system"])
    write_bundle(
        {"summary": summary, "predictions": predicted, "confusion": agreement.crosstab(cells, ["system"]), "reports": agreement.per_class(agreement.confusion(cells, ["system"]), ["system"])}, path, summary="summary"
    )


def cv_summary(predicted: DataFrame) -> DataFrame:
    """(folds, and for accuracy, kappa and macro_f1: mean and population deviation over folds, and the pooled value). predicted: fold, label, predicted."""
    names = ["accuracy", "kappa", "macro_f1_union"]
    rows = predicted.select("fold", F.col("label").alias("truth"), F.col("predicted").alias("label"))
    cells = agreement.cells(rows, ["fold"])
    by_fold = agreement.metrics(agreement.confusion(cells, ["fold"]), ["fold"], names)
    spread = by_fold.agg(F.count(F.lit(1)).alias("folds"), *[f(m).alias(f"{m}_{n}") for m in names for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    pooled = agreement.metrics(agreement.confusion(cells.withColumn("all", F.lit(1)), ["all"]), ["all"], names).select(*[F.col(m).alias(f"{m}_pooled") for m in names])
    return spread.crossJoin(F.broadcast(pooled))


def impurity_importance(model: Model) -> list[tuple[str, float]]:
    """(feature, importance) of a forest, the greatest first."""
    return sorted(zip(model.scales, model.stage.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def forest_importance(train: DataFrame, forest: RandomForestClassifier, features: list[str] = MODEL_FEATURES) -> list[tuple[str, float]]:
    """``impurity_importance`` of ``forest`` fitted to ``train`` (label, features), without holding all its trees.

    The driver grows a forest's nodes, and a row carries two numbers for each tree. A forest's importance is the mean of its
    trees', so the trees are fitted some at a time, each lot with a seed of its own, and only what a lot adds up to stays.
    A forest that is one lot is the one that ``fit`` makes.
    """
    model, rows = _prepared(train, features)
    n, trees, done, most_nodes = max(1, rows.count()), forest.getNumTrees(), 0, 1
    total = np.zeros(len(features))
    while done < trees:
        lot = min(trees - done, MOST_TREE_ROWS // n, MOST_NODES // most_nodes)
        if not done and trees * n > 5 * MOST_NODES:  # the first lot tells how large trees grow, so where rows are many it is a small one
            lot = min(lot, MOST_NODES // n)
        lot = max(1, lot)
        grown = forest.copy({forest.numTrees: lot, forest.seed: forest.getSeed() + done}).fit(rows)
        nodes = [tree.numNodes for tree in grown.trees]
        most_nodes = max(most_nodes, *nodes)
        total += grown.featureImportances.toArray() * sum(k > 1 for k in nodes)  # trees that split count alike
        done += lot
        del grown  # else the driver's Java side keeps it
        gc.collect()
    rows.unpersist()
    return sorted(zip(features, (total / (total.sum() or 1.0)).tolist(), strict=True), key=lambda x: -x[1])


def permutation_importance(model, rows: DataFrame, repeats: int = 5, seed: int = 42, features: list[str] = MODEL_FEATURES, key: str = "item_id") -> DataFrame:
    """(feature, drop_mean, drop_std) of accuracy when one column is shuffled over rows by md5 ranks; one scoring job for all."""
    spark = rows.sparkSession
    right = lambda: F.avg(F.when(F.col("_id.label") == F.col("predicted"), 1.0).otherwise(0.0))
    base = predict(model, rows.withColumn("_id", F.struct("label")), "_id").agg(right().alias("base"))
    grid = spark.createDataFrame([(f, r) for f in features for r in range(repeats)], "feature string, repeat int")
    held = rows.select(key, "label", *[F.col(f).cast("double").alias(f) for f in features])
    # a row's place among all doesn't depend on the feature, so it is found once
    placed = md5_rank(held.withColumn("_all", F.lit(1)), ["_all"], "_place", [seed, F.lit("place"), key], key).select(F.col("_place").alias("_other"), F.struct(*features).alias("_from"))
    part = ["feature", "repeat"]
    ranked = md5_rank(held.crossJoin(F.broadcast(grid)), part, "_other", [seed, "feature", "repeat", key], key)
    moved = ranked.join(placed, "_other")
    shuffled = moved.select(F.struct("feature", "repeat", "label").alias("_id"), *[F.when(F.col("feature") == f, F.col(f"_from.{f}")).otherwise(F.col(f)).alias(f) for f in features])
    scored = predict(model, shuffled, "_id").select("_id.feature", "_id.repeat", "_id", "predicted")
    drops = scored.groupBy("feature", "repeat").agg(right().alias("accuracy")).crossJoin(F.broadcast(base)).withColumn("drop", F.col("base") - F.col("accuracy"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("drop_mean"), F.stddev_pop("drop").alias("drop_std"))
