"""Exact quantiles of many columns without gathering a column's values in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch: it knows a rank to within n / ACCURACY.
ACCURACY = 10_000
#: Rows of a table whose values are few enough for one task a group.
FEW_ROWS = 200_000
#: Groups up to which the brackets (a row a group and column) are broadcast; beyond it the join shuffles.
BROADCAST_GROUPS = 20_000


def same_groups(a: list[str], b: list[str]) -> Column:
    """Null-safe equality of two lists of columns."""
    return reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)], F.lit(True))


def quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., column, q): q holds a value a probability, interpolated between its neighbours, nulls
    where a column has no values. Nulls don't count, NaN is the largest, null groups are groups.

    A sketch brackets each rank. A second scan counts the rows below each bracket and, by value, those
    inside it: about 4 n / ACCURACY rows, of which equal ones are one, are all that is sorted. Up to
    FEW_ROWS rows, one scan with Spark's own exact percentiles is cheaper; the values are the same."""
    by = by or []
    if df.select(F.lit(1)).limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return _of_few(df, columns, probs, by)
    keys = [f"_k{i}" for i in range(len(by))]
    cell = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_v")) for c in columns])
    cells = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.explode(cell).alias("_e")).select(*keys, "_e.*")

    cuts = [max(0.0, min(1.0, p + side * 2 / ACCURACY)) for p in probs for side in (-1, 1)]
    top = F.lit(float("inf"))
    finite = F.when(F.isnan("_v"), top).otherwise(F.col("_v"))  # the sketch can't order NaN
    sketch = cells.groupBy(*keys, "_column").agg(F.count("_v").alias("_n"), F.percentile_approx(finite, cuts, ACCURACY).alias("_c"))
    few = F.col("_n") <= ACCURACY  # all of them: the sketch's bounds say nothing about so few

    def bracket(i: int) -> Column:
        lo, hi = F.col("_c")[2 * i], F.col("_c")[2 * i + 1]
        return F.struct(
            F.lit(i).alias("i"), F.lit(float(probs[i])).alias("p"), F.when(few, -top).otherwise(lo).alias("lo"),
            F.when(few | (hi == top), F.lit(float("nan"))).otherwise(hi).alias("hi"),
        )

    brackets = sketch.select(*[F.col(k).alias(f"{k}b") for k in keys], F.col("_column").alias("_columnb"), "_n", F.array(*[bracket(i) for i in range(len(probs))]).alias("_b"))
    if not by or df.select(*by).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        brackets = F.broadcast(brackets)
    own = [*keys, "_column"]
    met = cells.where("_v is not null").join(brackets, same_groups(own, [f"{k}b" for k in own])).select(*own, "_n", "_v", F.explode("_b").alias("_b")).where("_v <= _b.hi")
    counts = met.groupBy(*own, "_n", "_b.i", "_b.p", F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*own, "i").orderBy(F.asc_nulls_first("_v")))
    at = F.col("p") * (F.col("_n") - 1)
    first, last = F.floor(at), F.ceil(at)
    placed = counts.withColumn("_r", upto)
    ends = placed.groupBy(*own, "i", "p", "_n").agg(
        F.max(F.when(F.col("_v").isNull(), F.col("_r"))).alias("_below"),
        F.min(F.when(F.col("_r") > first, F.col("_v"))).alias("_x"), F.min(F.when(F.col("_r") > last, F.col("_v"))).alias("_y"),
    )
    missed = F.col("_x").isNull() | F.col("_y").isNull() | (F.col("_below") > first)
    mixed = F.when(first == last, F.col("_x")).otherwise((last - at) * F.col("_x") + (at - first) * F.col("_y"))
    value = F.when(missed, F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).otherwise(mixed)
    found = ends.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("_q"))  # an entry a probability
    # columns without values have brackets, but no counts
    groups = sketch.select(*own).join(found.toDF(*[f"{k}b" for k in own], "_q"), same_groups(own, [f"{k}b" for k in own]), "left")
    q = F.coalesce(F.transform("_q", lambda e: e["v"]), F.array_repeat(F.lit(None).cast("double"), len(probs)))
    return groups.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.col("_column").alias("column"), q.alias("q"))


def _of_few(df: DataFrame, columns: list[str], probs: list[float], by: list[str]) -> DataFrame:
    """quantiles() of a small table."""
    none = F.array_repeat(F.lit(None).cast("double"), len(probs))
    wide = df.groupBy(*by).agg(*[F.percentile(F.col(c).cast("double"), probs).alias(f"_q{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(f"_q{i}", none).alias("q")) for i, c in enumerate(columns)])
    return wide.select(*by, F.explode(cells).alias("_e")).select(*by, "_e.*")


def one_row(q: DataFrame, columns: list[str], values: dict[str, Column]) -> DataFrame:
    """The rows of quantiles() without groups as one: a column `prefix + column` of each value over q."""
    return q.agg(*[F.max(F.when(F.col("column") == c, v)).alias(f"{prefix}{c}") for prefix, v in values.items() for c in columns])
