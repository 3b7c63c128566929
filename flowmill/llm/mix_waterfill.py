"""Operator 9: mixing sources to target weights by capped water-filling.

Targets: every source asks for its weight's share of the total, is clamped at max_epochs times its
size, and the excess is shared out again by weight until no target is above its clamp. Sources fill
up in order of clamp / weight, so the fixed point is found with one running sum over the sources
(one row each). Sampling: a source that must be repeated e times is taken floor(e) times whole, and
the fraction is a seeded prefix of its documents in hash order, cut at the document boundary
nearest to the target. The cut is found from totals of hash buckets, so that a source with a third
of all rows is never sorted in one task: only its boundary bucket is.

Defined results: null source is a source of its own, last; a source without words has target 0;
null texts have size 0; repeated rows of a document are taken alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, fresh, materialize, small_side

MAX_EPOCHS = 3
SEED = 17
#: Leading digits of a key that name its bucket (16**3 a source); only the bucket that holds a cut is ordered row by row.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from (source, size); weights 1, 2, 3 repeating by code point, null last."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weighed = per.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("clamp", max_epochs * F.col("source_size"))
    fill = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("clamp").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = weighed.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("weight") >= F.col("clamp"))
    # sources fill in this order; the first that is not full sets the level, and those after it come out lower
    rate = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    return leveled.select("source", "source_size", "weight", F.when(F.col("_full"), F.col("clamp").cast("double")).otherwise(rate * F.col("weight")).alias("target"))


def _key(doc_id: Column, seed: int) -> Column:
    """The seeded order of documents within a source; hexadecimal, so that a prefix names a bucket."""
    own = F.concat(F.lit("null:"), F.coalesce(F.md5("text"), F.lit("")))  # rows without an id go by their texts
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), own)))


def plan(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row a source: (source, source_size, target, whole, cut_key). A document is taken `whole`
    times, and once more if its key isn't above cut_key."""
    rows = docs.select("source", _key(F.col("doc_id"), seed).alias("_key"), word_count(F.col("text")).alias("size"))
    rows = materialize(rows.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS)), "mix-sizes")
    want = targets(rows, max_epochs)
    want = want.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    want = materialize(want.withColumn("_rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    same_source = lambda a, b: a["source"].eqNullSafe(b["source"])
    in_order = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a source
    bucket = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_b"))
    bucket = bucket.withColumn("_start", F.coalesce(F.sum("_b").over(in_order), F.lit(0)))
    bucket = bucket.join(small_side(want), same_source(bucket, want)).select(bucket["source"], "_bucket", "_start", "_rest")
    cut = bucket.where("_start < _rest").groupBy("source").agg(F.max(F.struct("_bucket", "_start", "_rest")).alias("c"))
    cut = materialize(cut.select("source", "c.*"), "mix-cuts")
    # rows of the buckets that hold a cut, in key order
    edge = rows.join(small_side(cut.select(F.col("source").alias("_s"), F.col("_bucket").alias("_cb"), "_start", "_rest")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_cb")))
    edge = edge.groupBy("source", "_key", "_start", "_rest").agg(F.sum("size").alias("size"))
    so_far = Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    # a document is in if most of it lies under the target
    edge = edge.withColumn("_end", F.col("_start") + F.sum("size").over(so_far)).where(2 * F.col("_end") - F.col("size") <= 2 * F.col("_rest"))
    last = edge.groupBy("source").agg(F.max("_key").alias("_last"))
    cut = cut.join(last, same_source(cut, last), "left").select(cut["source"].alias("_s"), F.coalesce("_last", "_bucket").alias("cut_key"))
    out = want.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", "cut_key")
    return materialize(out, "mix-plan")


def _with_copies(docs: DataFrame, mix: DataFrame, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """docs with the plan's columns and `copies`, and the names these have; the plan is broadcast if it
    is small, so rows keep their place."""
    names = dict(zip((*mix.columns, "copies"), fresh(docs, *(f"_{c}" for c in (*mix.columns, "copies"))), strict=True))
    mix = small_side(mix.withColumnsRenamed(names))
    extra = F.when(_key(F.col("doc_id"), seed) <= F.col(names["cut_key"]), 1).otherwise(0)
    return docs.join(mix, F.col("source").eqNullSafe(F.col(names["source"]))).withColumn(names["copies"], F.col(names["whole"]) + extra), names


def copies(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, n_copies): how often the mix takes each row."""
    narrow = docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"))
    out, name = _with_copies(narrow, plan(docs, max_epochs, seed), seed)
    return out.select("doc_id", "source", "size", *[F.col(name[c]).alias(c) for c in ("source_size", "target")], F.col(name["copies"]).alias("n_copies"))


def mixed(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, all columns kept."""
    out, name = _with_copies(docs, plan(docs, max_epochs, seed), seed)
    n = F.col(name["copies"])
    return out.where(n > 0).withColumn(name["copies"], F.explode(F.sequence(F.lit(1), n))).select(*columns_of(docs))
