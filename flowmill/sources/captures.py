"""Capture CSVs: Latin-1 scan as text, exact row positions, label index, materialised samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder named by spark.checkpoint.dir, else the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/flowmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, so that a lost executor costs one task."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_captures(df: DataFrame, path: str, by: str) -> str:
    """One folder of CSVs a source, Latin-1, with headers."""
    df.write.partitionBy(by).option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return path


def scan_captures(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All columns as text (no inference pass), with the file's name, block start and scan order."""
    reader = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("recursiveFileLookup", False)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.withColumns({"source_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_mono": F.monotonically_increasing_id()})


def row_positions(scanned: DataFrame, out: str = "row_index") -> DataFrame:
    """Row number within its file, before anything is filtered. Offsets come from the blocks' counts
    (one row a block), so no file is sorted in one task."""
    blocks = scanned.groupBy("source_path", "_block").agg(F.min("_mono").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = scanned.join(blocks, ["source_path", "_block"])
    return placed.withColumn(out, F.col("_ahead") + F.col("_mono") - F.col("_first")).drop("_block", "_mono", "_first", "_ahead")


def positions_by_order(df: DataFrame, group: str, order: str, out: str = "position", block_rows: int = 100_000) -> DataFrame:
    """0-based rank of `order` within `group` without gathering a group: counts of value blocks are
    prefix-summed (a few rows a group) and each block is ranked on its own. order: unique longs."""
    blocked = df.withColumn("_blk", F.floor(F.col(order) / block_rows))
    before = Window.partitionBy(group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocked.groupBy(group, "_blk").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(group, "_blk").orderBy(order)) - 1
    return blocked.withColumn("_in", inside).join(ahead, [group, "_blk"]).withColumn(out, (F.col("_ahead") + F.col("_in")).cast("long")).drop("_blk", "_in", "_ahead")


#: Bitmaps (4 KB for 32,768 positions of a file) up to which they are broadcast.
BROADCAST_BITMAPS = 16_384


def position_bitmaps(chosen: DataFrame, source: str, position: str) -> DataFrame:
    """(source, bucket, bits): the chosen positions of each file as bitmaps."""
    p = F.col(position).cast("long")
    kept = chosen.where(F.col(source).isNotNull() & p.isNotNull()).select(F.col(source).alias("_source"), F.bitmap_bucket_number(p).alias("_bucket"), F.bitmap_bit_position(p).alias("_bit"))
    return kept.groupBy("_source", "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def materialize_rows(df: DataFrame, chosen: DataFrame, source: str, position: str) -> DataFrame:
    """The rows of df at the chosen (source, position). The positions are bitmaps, broadcast after a check of
    their number, so that the scanned side isn't shuffled; beyond it both sides meet by key. Nulls match nothing."""
    bitmaps = written(position_bitmaps(chosen, source, position), "positions")
    if bitmaps.count() > BROADCAST_BITMAPS:
        return df.join(chosen.select(source, position), [source, position], "left_semi")
    p = F.col(position).cast("long")
    pad = "_" * max(len(c) for c in df.columns)  # names that df doesn't have
    bitmaps = bitmaps.toDF(*[pad + c for c in bitmaps.columns])
    bit = F.bitmap_bit_position(p)
    byte = F.conv(F.hex(F.substring(F.col(f"{pad}_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.floor(byte / F.pow(F.lit(2.0), bit % 8)) % 2 == 1
    met = df.join(F.broadcast(bitmaps), (F.col(source) == F.col(f"{pad}_source")) & (F.bitmap_bucket_number(p) == F.col(f"{pad}_bucket")))
    return met.where(held).select(*df.columns)


def alignment_mismatches(index: DataFrame, sample: DataFrame, keys: list[str], label: str) -> DataFrame:
    """How many sampled rows carry another label than the index."""
    a, b = index.select(*keys, F.col(label).alias("_a")), sample.select(*keys, F.col(label).alias("_b"))
    return a.join(b, keys).agg(F.count("*").alias("n_rows"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatches"))
