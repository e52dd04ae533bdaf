"""Imputation, leave-one-group-out folds, scores, accuracy, equal error rate, classifiers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept

#: What becomes of rows with components that are not finite.
IMPUTE_MODES = ("nanmean", "drop", "zero")
#: Quantiles that cut distinct scores into ranges for cumulative counts.
SCORE_RANGES = 64


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def all_finite(vector: str) -> Column:
    return F.forall(vector, finite)


def _means(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """One row (__means): column means of the fully finite rows, or of all finite components if
    no row is, or 0."""
    whole = all_finite(vector)
    item = lambda i: F.get(vector, F.lit(i)).cast("double")
    return rows.agg(
        F.array(
            *[
                F.coalesce(F.avg(F.when(whole, item(i))), F.avg(F.when(finite(item(i)), item(i))), F.lit(0.0))
                for i in range(size)
            ]
        ).alias("__means")
    )


def impute_mean(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """Non-finite components become the column mean of the fully finite rows, or of all finite
    components if no row is, or 0. The means are one row of ``size`` numbers."""
    fixed = F.zip_with(vector, "__means", lambda x, m: F.when(finite(x.cast("double")), x.cast("double")).otherwise(m))
    # One row: a bound known from the aggregate.
    return rows.join(F.broadcast(_means(rows, vector, size))).withColumn(vector, fixed).drop("__means")


def impute(rows: DataFrame, vector: str, size: int, mode: str = "nanmean") -> DataFrame:
    """Rows with finite vectors of doubles. ``nanmean`` fills with column means over all rows,
    ``drop`` leaves rows out that are not finite, ``zero`` puts 0."""
    if mode not in IMPUTE_MODES:
        raise ValueError(f"{mode} is none of {', '.join(IMPUTE_MODES)}")
    if mode == "nanmean":
        return impute_mean(rows, vector, size)
    double = F.transform(vector, lambda x: x.cast("double"))
    if mode == "drop":
        return rows.where(all_finite(vector)).withColumn(vector, double)
    return rows.withColumn(vector, F.transform(double, lambda x: F.when(finite(x), x).otherwise(0.0)))


def equal_error_rate(rows: DataFrame, y: str, score: str) -> DataFrame:
    """One row (eer): least mean error in percent where both errors differ by under 0.01, else 100.

    Scores are counted first. Distinct scores are cut at quantiles into ranges; cumulative
    counts run within ranges and are raised by the ranges before, so no task gets all scores.
    """
    by = rows.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("n")
    )
    marks = [F.lit(k / SCORE_RANGES) for k in range(1, SCORE_RANGES)]
    # One row of SCORE_RANGES - 1 numbers.
    cuts = by.agg(F.percentile_approx("s", F.array(*marks), F.lit(10_000)).alias("cuts"))
    ranged = by.join(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c > F.col("s")))).drop("cuts")
    sums = ranged.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    # At most SCORE_RANGES rows.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        "range",
        F.coalesce(F.sum("rp").over(before), F.lit(0)).alias("bp"),
        F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("bn"),
        F.sum("rp").over(every).alias("P"),
        F.sum("rn").over(every).alias("N"),
    )
    within = Window.partitionBy("range").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.select("range", F.sum("p").over(within).alias("cp"), F.sum("n").over(within).alias("cn"))
    rates = counted.join(F.broadcast(offsets), "range").select(
        F.expr("try_divide(bn + cn, N)").alias("fa"), (1 - F.expr("try_divide(bp + cp, P)")).alias("miss")
    )
    best = F.min(F.when(F.abs(F.col("fa") - F.col("miss")) < 0.01, (F.col("fa") + F.col("miss")) / 2))
    return rates.agg((F.coalesce(best, F.lit(1.0)) * 100).alias("eer"))


def _sums(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, sums, c): element-wise sums as one array; partial sums are a row a key and place."""
    items = rows.select(*keys, F.posexplode(vector).alias("i", "x"))
    own = items.groupBy(*keys, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("c"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "s")))
    return own.groupBy(*keys).agg(F.transform(pairs, lambda p: p["s"]).alias("sums"), F.max("c").alias("c"))


def centroid_scores(rows: DataFrame, key: str, group: str, y: str, vector: str) -> DataFrame:
    """(key, group, y, pred, score): nearest centroid, each row's group left out of the centroids
    it meets. With two classes the score is the distance to the lower one less that to the
    higher, squared; else 0.

    Sums by (group, class) come first; a fold's centroid is the class total less the group's
    own share. Totals are one row of classes x components numbers, and every row works out its
    distances in place.
    """
    own = _sums(rows, [group, y], vector)
    total = own.select(y, "c", F.posexplode("sums").alias("i", "s")).groupBy(y, "i").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "s")))
    total = total.groupBy(y).agg(F.transform(pairs, lambda p: p["s"]).alias("s"), F.max("c").alias("c"))
    classes = total.agg(F.array_sort(F.collect_list(F.struct(F.col(y).alias("cls"), "c", "s"))).alias("classes"))
    mine = own.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(y, F.struct("c", "sums")))).alias("mine"))
    far = F.expr(
        f"""transform(classes, k -> struct(
              round(aggregate(zip_with({vector}, zip_with(k.s, coalesce(try_element_at(mine, k.cls).sums, array_repeat(0D, size(k.s))),
                (a, b) -> try_divide(a - b, k.c - coalesce(try_element_at(mine, k.cls).c, 0L))), (x, m) -> pow(CAST(x AS DOUBLE) - m, 2)),
                0D, (a, b) -> a + b), 6) AS d, k.cls AS cls))"""
    )
    # One row of totals.
    met = rows.select(key, group, y, vector).join(mine, group).join(F.broadcast(classes)).withColumn("far", far)
    met = met.withColumn("near", F.filter("far", lambda f: f["d"].isNotNull())).where(F.size("near") > 0)
    margin = F.when(F.size("classes") == 2, F.expr("far[0].d - far[1].d")).otherwise(F.lit(0.0))
    return met.select(
        key, group, y, F.array_min("near")["cls"].alias("pred"), F.coalesce(margin, F.lit(0.0)).alias("score")
    )


def centroid_predictions(rows: DataFrame, key: str, group: str, y: str, vector: str) -> DataFrame:
    return centroid_scores(rows, key, group, y, vector).select(key, group, y, "pred")


@dataclass
class Learner:
    """An estimator of the engine: what makes it, where its score stands, what is done to vectors."""

    make: Callable
    score: str = "margin"  # the margin, or the higher class's probability where there are two
    map: Callable | None = None  # (rows, size) -> rows with other vectors


def fourier(components: int = 256, seed: int = 0) -> Callable:
    """Random Fourier features of the RBF kernel, whose width follows the vectors' variance."""

    def run(rows: DataFrame, size: int) -> DataFrame:
        items = F.explode("vector").alias("x")
        spread = rows.select(items).agg(F.var_pop("x")).first()[0] or 1.0
        rng = np.random.default_rng(seed)
        weights = rng.normal(0, math.sqrt(2 / (size * spread)), (size, components))
        shift = rng.uniform(0, 2 * math.pi, components)

        @F.pandas_udf("array<double>")
        def wave(vectors: pd.Series) -> pd.Series:
            x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, size))
            return pd.Series(list(math.sqrt(2 / components) * np.cos(x @ weights + shift)))

        return rows.withColumn("vector", wave("vector"))

    return run


def classifiers(trees: int = 300, rounds: int = 300) -> dict[str, Learner]:
    """Learners by name. ``svm`` is a linear machine over random Fourier features of the RBF
    kernel; ``xgb`` has no L2 term on leaves, which the engine's trees lack."""
    from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier

    return {
        "rf": Learner(lambda: RandomForestClassifier(numTrees=trees, seed=42, maxDepth=10), "probability"),
        "gb": Learner(lambda: GBTClassifier(maxIter=rounds, seed=42, maxDepth=3, stepSize=0.1)),
        "lr": Learner(lambda: LogisticRegression(maxIter=5000, regParam=1e-3)),
        "svm": Learner(lambda: LinearSVC(maxIter=rounds), map=fourier()),
        "xgb": Learner(
            lambda: GBTClassifier(
                maxIter=rounds, seed=0, maxDepth=4, stepSize=0.05, subsamplingRate=0.9, featureSubsetStrategy="0.9"
            ),
            "probability",
        ),
    }


def loso_cv(
    rows: DataFrame,
    key: str,
    group: str,
    y: str,
    vector: str,
    size: int,
    learner: Learner | str = "centroid",
    mode: str = "nanmean",
    fit_params: dict | None = None,
    threads: int = 4,
) -> DataFrame:
    """(key, group, y, pred, score) of every row, predicted without its group.

    ``learner`` is "centroid", which needs no loop, or one of classifiers(): one fit a group,
    a few at a time, with ``fit_params`` set on the estimator. A group whose rest has one class, or that is left empty by
    ``drop``, is skipped. Predictions are written to the shared folder, and what was cached is let go.
    """
    data = impute(rows.select(key, group, y, F.col(vector).alias("vector")), "vector", size, mode)
    if learner == "centroid":
        return centroid_scores(data, key, group, y, "vector")
    from multiprocessing.pool import ThreadPool

    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = rows.sparkSession
    if learner.map:
        data = learner.map(data, size)
    data = data.select(key, group, F.col(y).cast("double").alias("label"), array_to_vector("vector").alias("features")).persist()
    # One row a group and class: groups are as many as models that are to be fitted.
    counts = data.groupBy(group, "label").count().collect()
    kinds = {r["label"] for r in counts}
    folds = []
    for fold in sorted({r[group] for r in counts}):
        if len({r["label"] for r in counts if r[group] != fold}) > 1:
            folds.append(fold)

    def predict(fold) -> DataFrame:
        estimator = learner.make()
        estimator = estimator.copy({estimator.getParam(k): v for k, v in (fit_params or {}).items()})
        out = estimator.fit(data.where(F.col(group) != fold)).transform(data.where(F.col(group) == fold))
        if learner.score == "margin" and "rawPrediction" in out.columns:
            score = F.get(vector_to_array("rawPrediction"), F.lit(1))
        elif len(kinds) == 2 and "probability" in out.columns:
            score = F.get(vector_to_array("probability"), F.lit(1))
        else:
            score = F.lit(0.0)
        kind = rows.schema[y].dataType
        out = out.select(key, group, F.col("label").cast(kind).alias(y), F.col("prediction").cast(kind).alias("pred"), score.alias("score"))
        return kept(out)

    with ThreadPool(threads) as pool:
        parts = pool.map(predict, folds)
    data.unpersist()
    if not parts:
        empty = f"{key} {rows.schema[key].dataType.simpleString()}, {group} {rows.schema[group].dataType.simpleString()}"
        kind = rows.schema[y].dataType.simpleString()
        return spark.createDataFrame([], f"{empty}, {y} {kind}, pred {kind}, score double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def accuracy(results: DataFrame, y: str = "y") -> DataFrame:
    """One row (acc, n); acc is null where nothing was predicted."""
    return results.agg(F.avg((F.col(y) == F.col("pred")).cast("double")).alias("acc"), F.count("*").alias("n"))


def per_group(results: DataFrame, group: str, key: str, y: str = "y", lists: bool = False) -> DataFrame:
    """(group, acc, n) and, if asked, preds, true and scores in order of the key: a group's rows
    in one cell, for groups that are speakers."""
    hit = F.avg((F.col(y) == F.col("pred")).cast("double")).alias("acc")
    if not lists:
        return results.groupBy(group).agg(hit, F.count("*").alias("n"))
    sorted_rows = F.array_sort(F.collect_list(F.struct(key, "pred", F.col(y).alias("true"), "score")))
    got = results.groupBy(group).agg(hit, F.count("*").alias("n"), sorted_rows.alias("r"))
    return got.select(group, "acc", "n", F.col("r.pred").alias("preds"), F.col("r.true").alias("true"), F.col("r.score").alias("scores"))


def save_model(model, path: str, meta: dict) -> None:
    """Model in Spark's own format and its metadata as JSON beside it; nothing is pickled."""
    import json

    from pyspark.sql import SparkSession

    model.write().overwrite().save(path)
    text = json.dumps(meta, ensure_ascii=False)
    rows = SparkSession.active().createDataFrame([(text,)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def load_model(kind, path: str) -> tuple:
    """(model, meta) saved by save_model; ``kind`` is the model's class."""
    import json

    from pyspark.sql import SparkSession

    text = SparkSession.active().read.text(f"{path}.meta").first()["value"]
    return kind.load(path), json.loads(text)


def ablation_grid(
    rows: DataFrame,
    key: str,
    group: str,
    y: str,
    feature_sets: dict[str, tuple[Column, int]],
    learners: dict[str, Learner | str],
    mode: str = "nanmean",
    fit_params: dict[str, dict] | None = None,
) -> DataFrame:
    """(feature, classifier, acc, n_train): every feature set, a vector and its size, with every
    learner, left-group-out; n_train counts groups."""
    groups = rows.select(group).distinct().count()
    out = None
    for feature, (vector, size) in feature_sets.items():
        data = rows.select(key, group, y, vector.alias("features_in"))
        for name, learner in learners.items():
            done = loso_cv(data, key, group, y, "features_in", size, learner, mode, (fit_params or {}).get(name))
            part = accuracy(done, y).select(
                F.lit(feature).alias("feature"), F.lit(name).alias("classifier"), "acc", F.lit(groups).alias("n_train")
            )
            out = part if out is None else out.unionByName(part)
    return out
