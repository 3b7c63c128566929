"""Queries that fit models: checked by their rows and by tests."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.labels import combined_family, finite_or_null
from ..operators import attribution, boosting, network
from ..operators import explain as X
from ..operators import imbalance as I
from ..operators import models as ML
from ..operators import ranking as R
from ..operators import sampling as S
from ..operators import tuning
from ..operators.prepare import balanced_weights
from ..sources import batch, bundles, captures
from ..sources.scratch import spread, written
from .catalog import query
from .views import flows, table

LABELS = list(range(10))
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def vectors(spark, d):
    """The labelled embeddings with folds and a train/test side."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))
    split = S.split_random(e, "y", "row_id")
    return S.stratified_folds(split, "y", "row_id", 3)


def _ready(spark, d):
    from pyspark.ml.functions import array_to_vector

    v = vectors(spark, d).select("row_id", "side", "fold", array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    v = spread(v, "vectors")
    return balanced_weights(v.where("side = 'train'"), "label"), balanced_weights(v.where("side = 'test'"), "label")


def _scored(spark, d, name):
    train, test = _ready(spark, d)
    s = ML.score(ML.fit(name, train.cache(), 10), test)
    return s.select("row_id", "label", "y_pred", F.round("confidence", 6).alias("confidence"))


for _name in ("random_forest", "boosted_trees", "mlp", "logistic_regression"):

    @query(f"model_{_name}")
    def _(spark, d, name=_name):
        """Test rows scored by the model."""
        return _scored(spark, d, name)


@query("model_stacking")
def _(spark, d):
    train, test = _ready(spark, d)
    return ML.stack(train.cache(), test, ["random_forest", "logistic_regression"], 10).select("row_id", "label", "y_pred")


@query("score_batch")
def _(spark, d):
    """Predicted label, truth, every class's probability and the largest."""
    train, test = _ready(spark, d)
    s = ML.score(ML.fit("logistic_regression", train, 10), test)
    return s.select("row_id", "label", "y_pred", "confidence", *[F.round(F.col("probability")[k], 6).alias(f"p_{k}") for k in LABELS])


_FLOW_FEATURES = ["f_rate", "f_value", "f_user", "f_k"]


def _flow_sides(spark, d):
    """Usable flows, gaps left in, with a seeded side."""
    f = flows(spark, d).withColumn("label", combined_family(F.col("label_raw"))).where("label <> 'Other'")
    f = f.select("row_id", "label", *[finite_or_null(F.col(c)).alias(c) for c in _FLOW_FEATURES])
    return written(S.split_random(f, "label", "row_id", min_test=3), "flow-sides")  # read by every step of a fit


@query("model_pipeline")
def _(spark, d):
    """Gaps, scaling and oversampling learnt from training rows, then test rows scored with class names."""
    sides = _flow_sides(spark, d)
    model, classes = ML.fit_pipeline("logistic_regression", sides.where("side = 'train'").drop("side"), _FLOW_FEATURES, "label", "row_id", imbalance="oversample", target="Infiltration")
    scored = ML.predict(model, classes, sides.where("side = 'test'"), _FLOW_FEATURES, ["row_id", "label"])
    return scored.withColumns({c: F.round(c, 6) for c in scored.columns if c.startswith("p_") or c == "confidence"})


@query("score_csv")
def _(spark, d):
    """Uploaded CSVs scored into CSVs: names stripped, features read as numbers, classes by name; read back."""
    sides = _flow_sides(spark, d)
    model, classes = ML.fit_pipeline("random_forest", sides.where("side = 'train'").drop("side"), _FLOW_FEATURES, "label", "row_id", numTrees=20)
    path = captures.scratch_path(spark, "upload")
    test = sides.where("side = 'test'").select("row_id", F.col("label").alias("Label"), *_FLOW_FEATURES)
    test.toDF(*[f" {c}" for c in test.columns]).repartition(3, " row_id").write.option("header", True).csv(f"{path}/in")
    batch.score_csv(spark, f"{path}/in", f"{path}/out", model, classes, _FLOW_FEATURES, keep=["row_id", "Label"])
    return batch.read_predictions(spark, f"{path}/out").select("row_id", "Label", "y_pred", F.round("confidence", 6).alias("confidence"))


@query("model_footprint")
def _(spark, d):
    """Fitted models, stored: macro-F1 on test rows, bytes of their files, measured latency and throughput."""
    train, test = _ready(spark, d)
    train, test = train.cache(), captures.written(test, "scored-rows")
    root, durations, scored = captures.scratch_path(spark, "models"), [], []
    for name in ("logistic_regression", "random_forest"):
        model = ML.fit(name, train, 10)
        model.write().save(f"{root}/{name}")
        stored = PipelineModel.load(f"{root}/{name}")  # what is measured is what is stored
        durations += [(name, *t) for t in ML.scoring_durations(stored, test)]
        scored.append(ML.score(stored, test).withColumn("model", F.lit(name)))
    times = R.latency_summary(spark.createDataFrame(durations, "model string, ms double, n_rows long"))
    return ML.macro_f1(scored[0].union(scored[1]), LABELS).join(times, "model").join(bundles.artifact_sizes(spark, root), "model")


@query("model_search")
def _(spark, d):
    train, _test = _ready(spark, d)
    return ML.search("logistic_regression", train, 10, LABELS, 3, 10)


@query("label_shuffle_sanity")
def _(spark, d):
    """Macro-F1 of a model fitted on permuted labels: near chance."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))
    from pyspark.ml.functions import array_to_vector

    mixed = S.split_random(S.shuffle_labels(S.balanced_cap(e, "y", "row_id", 100_000), "y", "row_id"), "y", "row_id", min_test=3)
    v = balanced_weights(mixed.select("row_id", "side", array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label")), "label")
    s = ML.score(ML.fit("logistic_regression", v.where("side = 'train'").cache(), 10), v.where("side = 'test'"))
    return ML.macro_f1(s, LABELS).select("f1_macro", F.lit(0.1).alias("chance"))


def _lines(spark, d):
    t = table(spark, d, "lineitem").withColumn("row_id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    return t.withColumn("y", F.expr("cast(l_quantity > 25 as int) + cast(l_discount > 0.05 as int)"))


@query("rf_importance")
def _(spark, d):
    return ML.forest_importance(ML.assemble(_lines(spark, d), LINE_FEATURES, "y"), LINE_FEATURES, 3)


@query("rfe")
def _(spark, d):
    kept = ML.eliminate(_lines(spark, d).select("row_id", "y", *LINE_FEATURES), LINE_FEATURES, "y", 3, keep=2, step=2)
    return spark.createDataFrame([(f,) for f in kept], "feature string")


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))


@query("smote")
def _(spark, d):
    """Two synthetic rows from each row of class 3."""
    return I.smote(_points(spark, d), "y", 3, 2).select("seed_id", "copy", "neighbour_id", F.round("gap", 6).alias("gap"), F.size("x").alias("dims"))


@query("borderline_smote")
def _(spark, d):
    p = _points(spark, d)
    return I.smote(p, "y", 3, 1, seeds=I.danger_points(p, "y", 3)).select("seed_id", "copy", "neighbour_id", F.round("gap", 6).alias("gap"))


@query("smote_enn")
def _(spark, d):
    """Synthetic rows of class 3 joined to the rest; rows that lose their neighbours' vote are listed."""
    p = _points(spark, d)
    grown = p.unionByName(I.smote(p, "y", 3, 1).select((-1 - F.col("seed_id")).alias("row_id"), "x", F.lit(3).cast("int").alias("y")))
    grown = written(grown, "grown")  # read several times
    return I.edited_out(I.nearest_votes(grown, "y", 3))


@query("shapley_sampling")
def _(spark, d):
    """Attributions of 40 rows against 20 background rows under a fixed scoring rule; a stated sample."""
    t = _lines(spark, d).select("row_id", "l_quantity", "l_discount", "l_tax")
    pick = lambda n, s: t.orderBy(F.xxhash64(F.lit(s), "row_id"), "row_id").limit(n)
    rule = lambda c: c["l_quantity"] * (1 - c["l_discount"]) + F.when(c["l_tax"] > 0.04, 10.0).otherwise(0.0)
    return X.sampling_shapley(pick(40, 1), pick(20, 2), ["l_quantity", "l_discount", "l_tax"], rule)


@query("tree_attribution")
def _(spark, d):
    """Every test flow's exact attributions of a fitted forest, by class."""
    sides = _flow_sides(spark, d)
    model, classes = ML.fit_pipeline("random_forest", sides.where("side = 'train'").drop("side"), _FLOW_FEATURES, "label", "row_id", numTrees=20)
    phi = attribution.tree_attribution(model, classes, sides.where("side = 'test'"), _FLOW_FEATURES, "row_id")
    return phi.select("row_id", "class", *[F.round(c, 9).alias(c) for c in ("expected", "prediction")], *[F.round(F.col("phi")[f], 9).alias(f"phi_{f}") for f in _FLOW_FEATURES])


@query("kernel_attribution")
def _(spark, d):
    """Attributions of a fitted regression: 1,000 test flows against 200 training flows, the sizes that are the operator's settings."""
    sides = _flow_sides(spark, d)
    model, classes = ML.fit_pipeline("logistic_regression", sides.where("side = 'train'").drop("side"), _FLOW_FEATURES, "label", "row_id")
    ready = PipelineModel(model.stages[:-1]).transform(sides.withColumns({f: F.col(f).cast("double") for f in _FLOW_FEATURES}))
    ready = ready.select("row_id", "side", vector_to_array("features").alias("x"))
    pick = lambda side, n: ready.where(F.col("side") == side).orderBy(F.xxhash64("row_id"), "row_id").limit(n)
    phi = attribution.kernel_attribution(model.stages[-1], pick("test", 1000), pick("train", 200), _FLOW_FEATURES, classes)
    return phi.select("row_id", "class", "feature", F.round("phi", 9).alias("phi"))


@query("model_softmax_boost")
def _(spark, d):
    """Test embeddings scored by softmax boosting with balanced weights."""
    sides = balanced_weights(vectors(spark, d).select("row_id", "side", "x", F.col("y").cast("int").alias("label")).where("side = 'train'"), "label")
    model = boosting.fit(sides, 10, rounds=10, depth=3, rate=0.3)
    test = vectors(spark, d).where("side = 'test'").select("row_id", F.col("y").cast("int").alias("label"), "x")
    scored = boosting.predict(model, test, ["row_id", "label"])
    return scored.select("row_id", "label", "y_pred", F.round(F.array_max("probability"), 6).alias("confidence"))


@query("model_network")
def _(spark, d):
    """Test embeddings scored by a network trained with balanced weights and stopped early."""
    sides = vectors(spark, d).select("row_id", "side", "x", F.col("y").cast("int").alias("label"))
    model = network.fit(balanced_weights(sides.where("side = 'train'"), "label"), 10, hidden=(128, 64), epochs=100)
    scored = network.predict(model, sides.where("side = 'test'"), ["row_id", "label"])
    return scored.select("row_id", "label", "y_pred", F.round(F.array_max("probability"), 6).alias("confidence"))


@query("model_tuned")
def _(spark, d):
    """Candidates of two models, scored by F2 of one class in concurrent jobs under a budget."""
    train = _ready(spark, d)[0].cache()
    out = None
    for name, n in (("logistic_regression", 6), ("random_forest", 2)):
        found, _ = tuning.tune(name, train, 10, 3, n, tuning.f_beta(3), budget=90)
        found = found.select(F.lit(name).alias("model"), "*")
        out = found if out is None else out.unionByName(found)
    train.unpersist()
    return out


@query("model_pipeline_smote")
def _(spark, d):
    """As model_pipeline, with synthetic rows of a rare class among the scaled training rows."""
    sides = _flow_sides(spark, d)
    model, classes = ML.fit_pipeline("logistic_regression", sides.where("side = 'train'").drop("side"), _FLOW_FEATURES, "label", "row_id", imbalance="borderline_smote", target="Heartbleed")
    scored = ML.predict(model, classes, sides.where("side = 'test'"), _FLOW_FEATURES, ["row_id", "label"])
    return scored.select("row_id", "label", "y_pred", F.round("confidence", 6).alias("confidence"))
