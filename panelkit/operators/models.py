"""Model fitting with MLlib.

Design matrices are built by Spark (``VectorAssembler``, one-hot encoders);
fits are MLlib estimators that distribute over the executors. Only model
*parameters* reach the driver (coefficients, importances: one value per
feature), never the rows.

Scaling follows the reference's scaler (population standard deviation):
``standardize`` computes means and population stds in one aggregate and
applies them as column expressions, lazily."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (OneHotEncoder, PolynomialExpansion, StringIndexer,
                                VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (GBTRegressor, IsotonicRegression, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest
from .joins import with_scalars


def standardize(df: DataFrame, cols, fit_on: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """(x - mean) / population std, statistics from ``fit_on`` (default
    ``df``); a constant column becomes 0."""
    src = fit_on if fit_on is not None else df
    stats = src.agg(*[F.avg(c).alias(f"__mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__sd_{c}") for c in cols])
    x = with_scalars(df, stats)
    x = x.withColumns({f"{c}{suffix}": F.coalesce(F.try_divide(F.col(c) - F.col(f"__mu_{c}"), F.col(f"__sd_{c}")),
                                                   F.lit(0.0)) for c in cols})
    return x.drop(*[f"__mu_{c}" for c in cols], *[f"__sd_{c}" for c in cols])


def design(df: DataFrame, numeric, categorical=(), drop_first: bool = True, out: str = "features"):
    """M6/M7: assemble ``out`` from numeric columns and one-hot categories.

    Categories are indexed alphabetically with an 'unknown' slot; the unknown
    slot is dropped (an unseen level encodes as all zeros) and, with
    ``drop_first``, so is the alphabetically first level (dummy coding).
    Returns (fitted pipeline, transformed frame, feature names)."""
    stages, cat_cols, names = [], [], list(numeric)
    for c in categorical:
        idx = StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                            stringOrderType="alphabetAsc").fit(df)  # learns the (bounded) level list
        labels = idx.labels
        stages += [idx, OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__ohe_all", dropLast=True)]
        if drop_first:
            stages.append(VectorSlicer(inputCol=f"{c}__ohe_all", outputCol=f"{c}__ohe",
                                       indices=list(range(1, len(labels)))))
            names += [f"{c}={lv}" for lv in labels[1:]]
            cat_cols.append(f"{c}__ohe")
        else:
            names += [f"{c}={lv}" for lv in labels]
            cat_cols.append(f"{c}__ohe_all")
    stages.append(VectorAssembler(inputCols=list(numeric) + cat_cols, outputCol=out, handleInvalid="keep"))
    model = Pipeline(stages=stages).fit(df)
    return model, model.transform(df), names


def coefficient_table(spark: SparkSession, names, coefs) -> DataFrame:
    """(feature, coefficient, abs_coefficient) ranked by |coefficient|;
    one row per feature (parameters, not data)."""
    rows = [(n, float(c), abs(float(c))) for n, c in zip(names, coefs)]
    df = spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double")
    return df.orderBy(F.col("abs_coefficient").desc(), "feature")


def linear(df: DataFrame, label: str, features: str = "features", reg: float = 0.0):
    """Least squares by the normal equations (ridge when ``reg``>0,
    penalty on the scaled coefficients as Spark defines it)."""
    lr = LinearRegression(featuresCol=features, labelCol=label, solver="normal", regParam=reg,
                          elasticNetParam=0.0, standardization=False)
    return lr.fit(df)


def poly2(df: DataFrame, label: str, features: str = "features"):
    """Degree-2 polynomial expansion of the (already scaled) features,
    then least squares."""
    pe = PolynomialExpansion(degree=2, inputCol=features, outputCol="__poly")
    return Pipeline(stages=[pe, LinearRegression(featuresCol="__poly", labelCol=label, solver="normal")]).fit(df)


def gbt(df: DataFrame, label: str, features: str = "features", max_iter: int = 400, depth: int = 12,
        step: float = 0.05, validation_col: str | None = None, seed: int = 42):
    """Gradient-boosted trees (early stopping on ``validation_col``)."""
    g = GBTRegressor(featuresCol=features, labelCol=label, maxIter=max_iter, maxDepth=depth, stepSize=step, seed=seed)
    if validation_col:
        g = g.setValidationIndicatorCol(validation_col)
    return g.fit(df)


def forest_regressor(df: DataFrame, label: str, features: str = "features", trees: int = 200, depth: int = 12,
                     min_leaf: int = 5, seed: int = 42):
    """M16."""
    return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth,
                                 minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed).fit(df)


def balanced_weights(df: DataFrame, label: str, out: str = "w") -> DataFrame:
    """Class weights n / (k * n_class) (weights sum to n)."""
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    tot = df.agg(F.count(F.lit(1)).alias("__n"), F.count_distinct(label).alias("__k"))
    w = with_scalars(cnt, tot).select(label, (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(out))
    return df.join(F.broadcast(w), label)


#: Rows of a forest's partition at most: each holds, for every tree, how often the row was drawn and its node.
FOREST_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores: a written table of a few small files,
    which a scan packs into few tasks, is little to read and much to fit or score a
    forest on."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // FOREST_ROWS)))


#: Up to so many rows MLlib's own passes over a forest's rows cost least.
FOREST_SMALL = 20_000


def forest_classifier(df, label, features="features", trees=200, depth=14, min_leaf=3, weight="w", seed=42):
    """Balanced random forest. Few rows are fitted by MLlib, and the node that a
    row has reached in each tree is kept (``cacheNodeIds``), so that a level does not
    walk every tree from its root again; lost parts are computed again from the rows,
    without copies on disk. More rows, of two classes with a weight each, are
    binned and grown by ``operators.forest`` into the same kind of model."""
    est = RandomForestClassifier(featuresCol=features, labelCol=label, weightCol=weight, numTrees=trees,
                                 maxDepth=depth, minInstancesPerNode=min_leaf, cacheNodeIds=True, checkpointInterval=-1, seed=seed)
    rows = df.select(label, features, weight)
    kinds = rows.groupBy(label, weight).count().limit(3).collect()
    n, weights = sum(r["count"] for r in kinds), {r[0]: r[1] for r in kinds}
    dealt = spread(rows)
    if n > FOREST_SMALL and len(kinds) == 2 and set(weights) == {0.0, 1.0} and all(w and w > 0 for w in weights.values()):
        return forest.fit(est, rows, dealt, [weights[0.0], weights[1.0]], n)
    return est.fit(dealt)


def logistic(df, label, features="features", weight="w"):
    """Balanced L2 logistic regression (C = 1 -> regParam = 1/n with
    weights summing to n)."""
    n = df.count()
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol=weight, regParam=1.0 / max(n, 1),
                              elasticNetParam=0.0, standardization=False, maxIter=200).fit(df)


def tree(df, label, features="features", depth=10, min_leaf=3, weight="w", seed=42):
    """Balanced decision tree."""
    return DecisionTreeClassifier(featuresCol=features, labelCol=label, weightCol=weight, maxDepth=depth,
                                  minInstancesPerNode=min_leaf, seed=seed).fit(df)


def majority(train: DataFrame, label: str) -> DataFrame:
    """The majority class of the training labels (smallest on ties)."""
    return train.agg(F.mode(label, True).alias("majority"))


def positive_probability(pred: DataFrame, col: str = "probability", out: str = "proba") -> DataFrame:
    return pred.withColumn(out, vector_to_array(F.col(col))[1])


def isotonic_calibrate(train: DataFrame, label: str, fit, folds: int = 3, fold_col: str = "__fold"):
    """For each fold, ``fit`` a classifier on the other folds, score the
    held-out fold with it and fit an isotonic map there, so that no row is
    scored by a classifier that saw it. Returns the (classifier, map) pairs
    (averaged by ``apply_calibration``). One fold after the other: a forest fills
    all cores, and several would keep their drawn rows in memory at once."""

    def one(f):
        model = fit(train.filter(F.col(fold_col) != f))
        held = positive_probability(model.transform(train.filter(F.col(fold_col) == f)), out="__score")
        iso = IsotonicRegression(featuresCol="__score", labelCol="__label", predictionCol=f"__cal{f}").fit(
            held.select("__score", F.col(label).cast("double").alias("__label")))
        return model, iso

    return [one(f) for f in range(folds)]


def apply_calibration(df: DataFrame, pairs, out: str = "proba_cal") -> DataFrame:
    """The mean over (classifier, map) pairs of the mapped probabilities;
    ``df`` has the features that the classifiers were fitted on."""
    cols, x = [], df
    for model, iso in pairs:
        before = x.columns
        x = positive_probability(model.transform(x), out="__score")
        x = iso.transform(x).select(*before, iso.getPredictionCol())
        cols.append(iso.getPredictionCol())
    return x.withColumn(out, sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)).drop(*cols)


def parallel_fits(fn, items, threads: int = 8):
    """Run independent fits concurrently: each fit is a series of small
    Spark jobs, so several can share the executors (the driver only
    schedules; the data stays distributed). Results keep input order."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(items)))) as ex:
        return list(ex.map(fn, items))


def kmeans_best(df: DataFrame, k: int, features: str = "features", restarts: int = 10):
    """Best of ``restarts`` seeds by training cost (seeds fitted
    concurrently; ties go to the smaller seed)."""
    fits = parallel_fits(lambda s: KMeans(k=k, seed=s, featuresCol=features, predictionCol="cluster").fit(df),
                         range(restarts))
    costs = [m.summary.trainingCost for m in fits]
    return fits[costs.index(min(costs))]


def elbow(spark: SparkSession, df: DataFrame, ks=range(2, 11), features: str = "features", restarts: int = 10):
    """(k, inertia) for each k (one small row per k)."""
    pairs = [(k, s) for k in ks for s in range(restarts)]
    fits = parallel_fits(lambda ks_: KMeans(k=ks_[0], seed=ks_[1], featuresCol=features).fit(df).summary.trainingCost,
                         pairs)
    best = {}
    for (k, _), c in zip(pairs, fits):
        best[k] = min(best.get(k, float("inf")), float(c))
    return spark.createDataFrame(sorted(best.items()), "k int, inertia double")


def importance_table(spark: SparkSession, names, importances) -> DataFrame:
    """Feature importances with names, ranked."""
    rows = [(n, float(v)) for n, v in zip(names, importances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
