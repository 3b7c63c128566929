"""Classifiers on Spark ML: assembly, fitting, scoring, stacking, search and selection."""

from __future__ import annotations

import random
import time

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, MinMaxScaler, RobustScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import spread, written
from . import forest_cells
from . import metrics as M
from .imbalance import resample
from .prepare import balanced_weights, random_oversample, target_quota
from .sampling import hash_rank

#: Candidates that a model's search draws from. C is the inverse regularisation of a row.
SPACES = {
    "random_forest": {"numTrees": [100, 200, 300], "maxDepth": [8, 12, 15], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2", "0.3"]},
    "boosted_trees": {"maxIter": [50, 100, 200], "maxDepth": [4, 6, 8], "stepSize": [0.03, 0.05, 0.1, 0.2], "subsamplingRate": [0.6, 0.8, 1.0]},
    "mlp": {"hidden": [(128, 64), (256, 128), (128,), (256, 128, 64)], "stepSize": [5e-4, 1e-3, 3e-3], "blockSize": [256, 512, 1024]},
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "tol": [1e-4, 1e-3]},
}


def estimator(name: str, n_classes: int, n_features: int, n_rows: int, **params):
    """An unfitted classifier. A penalty of 1 / C on the sum of the rows' losses is 1 / (C * rows) on their mean."""
    common = {"featuresCol": "features", "labelCol": "label"}
    if name == "random_forest":
        return RandomForestClassifier(**common | {"weightCol": "weight", "numTrees": 100, "maxDepth": 8, "seed": 42} | params)
    if name == "boosted_trees":
        return OneVsRest(classifier=GBTClassifier(**{"maxIter": 10, "maxDepth": 4, "seed": 42} | params), parallelism=4, **common)
    if name == "mlp":
        hidden = params.pop("hidden", (16,))
        return MultilayerPerceptronClassifier(**common | {"layers": [n_features, *hidden, n_classes], "maxIter": 40, "seed": 42} | params)
    if name == "logistic_regression":
        c = params.pop("C", 1.0)
        return LogisticRegression(**common | {"weightCol": "weight", "family": "multinomial", "regParam": 1.0 / (c * max(1, n_rows)), "maxIter": 100, "tol": 1e-3} | params)
    raise ValueError(f"unknown model {name!r}")


def assemble(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """row_id, features vector, numeric label, balanced weight."""
    vec = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)
    return balanced_weights(vec.select("row_id", "features", F.col(label).cast("double").alias("label")), "label")


def fit(name: str, train: DataFrame, n_classes: int, **params):
    """The fitted classifier in a pipeline of its own; train has features, label and weight."""
    n_features = len(train.select("features").first()[0])
    n_rows = train.count() if name == "logistic_regression" else 0
    return Pipeline(stages=[estimator(name, n_classes, n_features, n_rows, **params)]).fit(train)


def oversampled(train: DataFrame, label: str, row_id: str, target, ratio: float, seed: int = 42) -> DataFrame:
    """train with the target class repeated up to `ratio` of the largest class."""
    grown = random_oversample(hash_rank(train, label, row_id, seed), target_quota(train, label, target, ratio), label)
    return grown.select(*train.columns)


def fit_pipeline(name: str, train: DataFrame, features: list[str], label: str, row_id: str, *, imbalance: str = "weights", target: str | None = None, ratio: float = 0.3, scaler: str = "standard", **params) -> tuple[PipelineModel, list[str]]:
    """Medians for gaps and a scaler fitted on training rows, then a classifier fitted on these rows
    balanced, and the classes in the order of their numbers. imbalance: `weights` (balanced row
    weights), `oversample` (the target class repeated, without weights), `smote`, `borderline_smote` or
    `smote_enn` (synthetic rows of the target class among the scaled rows, imbalance.resample) or `none`;
    it touches neither medians nor scales, and scoring never resamples. Gaps are nulls or NaN."""
    if imbalance not in ("weights", "oversample", "smote", "borderline_smote", "smote_enn", "none"):
        raise ValueError(f"unknown imbalance handling {imbalance!r}")
    indexer = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc").fit(train)
    numbered = indexer.transform(train.withColumns({f: F.col(f).cast("double") for f in features}))
    numbered = numbered.select(F.col(row_id).alias("row_id"), F.col("label_index").alias("label"), *features)
    filled = [f"_{f}" for f in features]
    scalers = {"standard": StandardScaler(inputCol="_raw", outputCol="features", withMean=True), "minmax": MinMaxScaler(inputCol="_raw", outputCol="features"), "robust": RobustScaler(inputCol="_raw", outputCol="features", withCentering=True)}
    gaps = Imputer(strategy="median", inputCols=features, outputCols=filled, relativeError=1e-4)
    prepared = Pipeline(stages=[gaps, VectorAssembler(inputCols=filled, outputCol="_raw"), scalers[scaler]]).fit(numbered)
    ready = prepared.transform(numbered).select("row_id", "label", "features")
    if imbalance == "oversample":
        ready = written(oversampled(ready, "label", "row_id", float(indexer.labels.index(target)), ratio), "oversampled")
    if "smote" in imbalance:
        points = written(ready.select("row_id", vector_to_array("features").alias("x"), "label"), "points")
        grown = resample(points, "label", float(indexer.labels.index(target)), ratio, imbalance)
        ready = written(grown.select("row_id", "label", array_to_vector("x").alias("features")), "resampled")
    ready = balanced_weights(ready, "label") if imbalance == "weights" else ready.withColumn("weight", F.lit(1.0))
    classifier = fit(name, ready, len(indexer.labels), **params)
    return PipelineModel(stages=[*prepared.stages, *classifier.stages]), indexer.labels


def predict(model: PipelineModel, classes: list[str], df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep, y_pred (a class by name), confidence and p_<class> of every row; the rows need no label."""
    out = model.transform(df.withColumns({f: F.col(f).cast("double") for f in features}))
    p = vector_to_array("probability")
    name = F.array(*[F.lit(c) for c in classes])[F.col("prediction").cast("int")]
    return out.select(*keep, name.alias("y_pred"), F.array_max(p).alias("confidence"), *[p[i].alias(f"p_{c}") for i, c in enumerate(classes)])


def score(model, df: DataFrame) -> DataFrame:
    """(row_id, label, y_pred, probability array, confidence). One-vs-rest gives raw scores only: their
    sigmoids are normalised to sum to one."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")
    else:
        raw = F.transform(vector_to_array("rawPrediction"), lambda v: 1 / (1 + F.exp(-v)))
        p = F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, x: a + x))
    scored = out.select("row_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("y_pred"), p.alias("probability"))
    return scored.withColumn("confidence", F.array_max("probability"))


def scoring_durations(model, rows: DataFrame, runs: int = 5) -> list[tuple[float, int]]:
    """(milliseconds, rows) of scoring all rows, `runs` times after one untimed run; nothing is kept."""
    n, out = rows.count(), []
    for k in range(runs + 1):
        begin = time.perf_counter()
        score(model, rows).write.format("noop").mode("overwrite").save()
        if k:
            out.append((1000 * (time.perf_counter() - begin), n))
    return out


def macro_f1(scored: DataFrame, labels: list[int]) -> DataFrame:
    """(model, f1_macro) of scored rows, with `model` if they have it."""
    p = scored if "model" in scored.columns else scored.withColumn("model", F.lit("model"))
    m = M.marginals(M.confusion_matrix(p.select("model", F.col("label").alias("y_true"), "y_pred"), labels))
    return m.groupBy("model").agg(F.avg("f1").alias("f1_macro"))


def stack(train: DataFrame, test: DataFrame, bases: list[str], n_classes: int, folds: int = 3) -> DataFrame:
    """Test rows scored by a logistic meta-model over the bases' out-of-fold probabilities. train has
    `fold`; each base is fitted once a fold and once on all training rows."""

    def meta(parts: list[DataFrame]) -> DataFrame:
        wide = parts[0].select("row_id", "label", F.col("probability").alias("p0"))
        for i, p in enumerate(parts[1:], 1):
            wide = wide.join(p.select("row_id", F.col("probability").alias(f"p{i}")), "row_id")
        wide = spread(wide, "stacked")  # the bases score once
        joined = F.concat(*[F.col(f"p{i}") for i in range(len(parts))])
        return balanced_weights(wide.select("row_id", array_to_vector(joined).alias("features"), F.col("label").cast("double").alias("label")), "label")

    oof, final = [], []
    for name in bases:
        parts = None
        for k in range(folds):
            s = score(fit(name, train.where(F.col("fold") != k), n_classes), train.where(F.col("fold") == k))
            parts = s if parts is None else parts.unionByName(s)
        oof.append(parts)
        final.append(score(fit(name, train, n_classes), test))
    return score(fit("logistic_regression", meta(oof), n_classes), meta(final))


def search(name: str, train: DataFrame, n_classes: int, labels: list[int], folds: int, n_iter: int, seed: int = 42) -> DataFrame:
    """(candidate, params, f1_mean, f1_std) of a seeded subset of the model's grid, scored by macro-F1
    over `fold`; rows with a null fold always train. A candidate that can't be fitted on every fold has null scores."""
    grid = [{}]
    for k, values in SPACES[name].items():
        grid = [g | {k: v} for g in grid for v in values]
    chosen = random.Random(seed).sample(grid, min(n_iter, len(grid)))
    train = spread(train, "search-rows").cache()  # a fit is many short passes; no task repeats the sorts before
    runs, rows = None, []
    for i, params in enumerate(chosen):
        rows.append((i, str(sorted(params.items()))))
        for k in range(folds):
            side = F.coalesce(F.col("fold") != k, F.lit(True))
            try:
                s = score(fit(name, train.where(side), n_classes, **params), train.where(~side))
            except (CapturedException, Py4JJavaError, ValueError, TypeError):
                continue  # this candidate can't be fitted on this fold
            s = s.select(F.struct(F.lit(i).alias("candidate"), F.lit(k).alias("fold")).alias("model"), "label", "y_pred")
            runs = s if runs is None else runs.unionByName(s)
    every = train.sparkSession.createDataFrame(rows, "candidate int, params string")
    if runs is None:
        return every.select("*", F.lit(None).cast("double").alias("f1_mean"), F.lit(None).cast("double").alias("f1_std"))
    per = macro_f1(runs, labels).select("model.*", "f1_macro").groupBy("candidate").agg(F.avg("f1_macro").alias("f1_mean"), F.stddev_pop("f1_macro").alias("f1_std"), F.count("*").alias("_n"))
    whole = per.where(F.col("_n") == folds).drop("_n")  # a mean over fewer folds can't be compared
    return every.join(F.broadcast(whole), "candidate", "left")


def forest_importance(train: DataFrame, features: list[str], n_classes: int, top_k: int | None = None) -> DataFrame:
    """(feature, importance, rk) of a random forest, best first. Many rows are grouped into cells first, where these are fewer."""
    found = forest_cells.cells(train)
    if found is None:
        f = fit("random_forest", train, n_classes).stages[-1].featureImportances.toArray()
    else:
        f = forest_cells.importance(found, lambda df, seed: fit("random_forest", df, n_classes, numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed).stages[-1].featureImportances.toArray())
    rows = train.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(features, f, strict=True)], "feature string, importance double")
    ranked = rows.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # one row a feature
    return ranked.where(F.col("rk") <= top_k) if top_k else ranked


def eliminate(df: DataFrame, features: list[str], label: str, n_classes: int, keep: int, step: int = 1) -> list[str]:
    """Recursive elimination: the least important `step` features go until `keep` are left."""
    left = list(features)
    while len(left) > keep:
        ranked = [r["feature"] for r in forest_importance(assemble(df, left, label), left, n_classes).orderBy("rk").collect()]
        left = [f for f in left if f in set(ranked[: max(keep, len(left) - step)])]
    return left
