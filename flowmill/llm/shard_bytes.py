"""Operator 6: contiguous shards of near-equal bytes, native.

The global prefix sum of sizes comes from per-partition totals: rows are range-partitioned by id
once (narrow rows only: the text is reduced to its size and crc before the shuffle) and written to
the shared folder, so that every later step sees the same partitions; the totals of the partitions
(one row each) give each partition's offset, and a running sum within the partition does the rest.
A row goes to the shard in which the middle of its bytes falls, so that each cut is the row
boundary nearest to its equal target.

Defined results: a null text has size 0 plus the overhead; null ids come first; rows that are equal
in id, crc and size are interchangeable; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 24
OVERHEAD = 8
#: Rows that a range partition aims at; their number follows the input.
ROWS_PER_PARTITION = 1_000_000


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards 0 to shards-1 in id order, slots gapless from 0."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = docs.select("doc_id", (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    narrow = materialize(narrow, "shard-sizes")
    order = ["doc_id", "text_crc32", "size"]
    parts = max(int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions")), narrow.count() // ROWS_PER_PARTITION + 1)
    ranged = narrow.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "_tie")
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "shard-ranges")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_b"), F.count("*").alias("_n"))
    offsets = totals.select("_part", F.coalesce(F.sum("_b").over(ahead), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"))
    grand = ranged.agg(F.sum("size").alias("_total"))
    inside = Window.partitionBy("_part").orderBy(*order, "_tie")
    placed = (
        ranged.withColumn("_run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")  # as many rows as partitions
        .join(F.broadcast(grand))  # one row
        .withColumn("_mid2", 2 * (F.col("_b0") + F.col("_run")) - F.col("size"))
        .withColumn("_row", F.col("_n0") + F.col("_rn") - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast((_mid2 * {shards}) div (2 * greatest(_total, 1)) as int)")))
    )
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "_row"), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # at most `shards` rows
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))
