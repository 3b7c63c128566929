"""Synthetic over-sampling and editing by exact nearest neighbours (neighbours.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .neighbours import nearest, usable
from .prepare import target_quota
from .sampling import hash_rank


def nearest_minority(queries: DataFrame, points: DataFrame, label: str, target, k: int) -> DataFrame:
    """(row_id, x, neighbours): each query's k nearest other rows of the target class, exact."""
    near = nearest(usable(queries, F.lit(True)), usable(points.where(F.col(label) == target), F.lit(True)), k)
    ids = F.coalesce(F.transform("n", lambda s: s["o"]), F.array().cast("array<long>"))
    return queries.select("row_id", "x").join(near, "row_id", "left").select("row_id", "x", ids.alias("neighbours"))


def minority_targets(df: DataFrame, label: str, ratio: float = 0.3) -> DataFrame:
    """(label, n, goal): every class but the largest is raised to `ratio` of it, rounded down; classes
    that have as many rows keep theirs. One row a class."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("_top"))
    return n.join(F.broadcast(most)).select("label", "n", F.greatest("n", F.floor(F.col("_top") * F.lit(ratio))).alias("goal"))


def smote(points: DataFrame, label: str, target, per_seed: int, k: int = 5, seed: int = 42, seeds: DataFrame | None = None) -> DataFrame:
    """(seed_id, copy, neighbour_id, gap, x): per_seed synthetic rows on the way from each seed to one
    of its k nearest minority neighbours. Choices are hashes of (seed, row, copy)."""
    minority = points.where(F.col(label) == target)
    near = nearest_minority(seeds if seeds is not None else minority, points, label, target, k).where(F.size("neighbours") > 0)
    n = near.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(per_seed))))
    pick = F.pmod(F.xxhash64(F.lit(seed), "row_id", "copy"), F.size("neighbours")).cast("int")
    gap = F.pmod(F.xxhash64(F.lit(seed + 1), "row_id", "copy"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    n = n.select(F.col("row_id").alias("seed_id"), "x", "copy", F.get("neighbours", pick).alias("neighbour_id"), gap.alias("gap"))
    other = minority.select(F.col("row_id").alias("neighbour_id"), F.col("x").alias("_y"))
    between = F.zip_with("x", "_y", lambda a, b: a + F.col("gap") * (b - a))
    return n.join(other, "neighbour_id").select("seed_id", "copy", "neighbour_id", "gap", between.alias("x"))


def danger_points(points: DataFrame, label: str, target, k: int = 10) -> DataFrame:
    """Minority rows of whose k nearest rows at least half, but not all, are of other classes."""
    near = nearest(usable(points.where(F.col(label) == target), F.lit(True)), usable(points, F.col(label) != target), k)
    foes = F.size(F.filter("n", lambda s: s["tag"]))
    danger = near.where((foes >= k / 2) & (foes < k)).select("row_id")
    return points.where(F.col(label) == target).join(danger, "row_id", "left_semi")


def nearest_votes(points: DataFrame, label: str, k: int) -> DataFrame:
    """(row_id, label, votes): the labels of each row's k nearest other rows, exact."""
    own = usable(points, F.col(label))
    near = nearest(own, own, k).select("row_id", F.transform("n", lambda s: s["tag"]).alias("votes"))
    return points.select("row_id", F.col(label).alias("label")).join(near, "row_id")


def edited_out(votes: DataFrame) -> DataFrame:
    """Rows whose label loses the vote of their neighbours."""
    own = F.size(F.filter("votes", lambda x: x == F.col("label")))
    return votes.where(2 * own < F.size("votes")).select("row_id", "label")


def resample(points: DataFrame, label: str, target, ratio: float, strategy: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(row_id, x, label): points with the target class raised to `ratio` of the largest class (rounded up)
    by synthetic rows. strategy: `smote`, `borderline_smote` (seeds are the class's rows in danger; without
    any nothing is added) or `smote_enn` (rows, synthetic ones too, that lose their three neighbours' vote
    go). Seeds take turns in a fixed random order. Synthetic ids lie below all others. A class of one row has
    no neighbours and stays."""
    if strategy not in ("smote", "borderline_smote", "smote_enn"):
        raise ValueError(f"unknown strategy {strategy!r}")
    points = points.select(F.col("row_id").cast("long").alias("row_id"), "x", label)
    quota = target_quota(points, label, target, ratio).first()
    if quota is None:
        raise ValueError(f"no rows of class {target!r}")
    need = quota["desired"] - quota["current"]
    minority = points.where(F.col(label) == target)
    seeds = danger_points(points, label, target) if strategy == "borderline_smote" else minority
    ranked = written(hash_rank(seeds, label, "row_id", seed).select(F.col("row_id").alias("seed_id"), "rn"), "seeds")
    n, least = ranked.count(), min(0, points.agg(F.min("row_id")).first()[0])
    if need > 0 and n:
        turns = -(-need // n)
        own = seeds.join(ranked.select(F.col("seed_id").alias("row_id")), "row_id", "left_semi")
        made = smote(points, label, target, turns, k, seed, own).join(ranked, "seed_id").where((F.col("copy") < turns) | (F.col("rn") <= need - n * (turns - 1)))
        ids = F.lit(least) - (F.col("rn") - 1) * turns - F.col("copy")
        points = points.unionByName(made.select(ids.alias("row_id"), "x", F.lit(target).cast(points.schema[label].dataType).alias(label)))
    if strategy == "smote_enn":
        points = written(points, "grown")
        points = points.join(edited_out(nearest_votes(points.withColumnRenamed(label, "label"), "label", 3)).select("row_id"), "row_id", "left_anti")
    return points
