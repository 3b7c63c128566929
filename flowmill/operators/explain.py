"""Attribution: sampling Shapley values and their top features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_features(phi: DataFrame, k: int) -> DataFrame:
    """(class, feature, importance, rk): mean absolute attribution, overall ('*') and by class, top k each."""
    a = F.avg(F.abs("phi")).alias("importance")
    every = phi.groupBy("feature").agg(a).select(F.lit("*").alias("class"), "feature", "importance")
    both = every.unionByName(phi.groupBy("class", "feature").agg(a))
    w = Window.partitionBy("class").orderBy(F.desc("importance"), "feature")  # one row a class and feature
    return both.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def sampling_shapley(rows: DataFrame, background: DataFrame, features: list[str], predict: Callable[[dict[str, Column]], Column], permutations: int = 8) -> DataFrame:
    """(row_id, feature, phi): average change of the prediction when a feature takes the row's value
    after those before it in a random order, the rest coming from a background row.

    rows and background (both with row_id and the features) must be bounded samples: the work is
    rows x background x permutations x features, spread over tasks. Orders are seeded by hash, and
    the attributions of a row add up to its prediction minus the background's mean prediction.
    """
    n = len(features)
    pairs = rows.select("row_id", *[F.col(f).alias(f"_x_{f}") for f in features]).join(F.broadcast(background.select(F.col("row_id").alias("_bg"), *[F.col(f).alias(f"_b_{f}") for f in features])))
    pairs = pairs.withColumn("_perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    keyed = F.array(*[F.struct(F.xxhash64("row_id", "_bg", "_perm", F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(n)])
    pairs = pairs.withColumn("_order", F.transform(F.array_sort(keyed), lambda s: s["i"]))
    steps = pairs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = lambda i: F.array_position("_order", F.lit(i)) - 1

    def mixed(last: Column) -> dict[str, Column]:
        return {f: F.when(place(i) <= last, F.col(f"_x_{f}")).otherwise(F.col(f"_b_{f}")) for i, f in enumerate(features)}

    change = predict(mixed(F.col("_k"))) - predict(mixed(F.col("_k") - 1))
    names = F.array(*[F.lit(f) for f in features])
    feature = names[F.get(F.col("_order"), F.col("_k"))]
    return steps.groupBy("row_id", feature.alias("feature")).agg(F.avg(change).alias("phi"))
