"""Scoring flows as they arrive: the batch functions are row-local, so they run on a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import combined_family, finite_or_null


def read_flow_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_rows(df: DataFrame, features: list[str], rule) -> DataFrame:
    """Cleaned features and the rule's decision beside the raw label's family."""
    ready = df.withColumns({c: finite_or_null(F.col(c)) for c in features})
    return ready.select("row_id", combined_family(F.col("label_raw")).alias("label"), rule(ready).alias("decision"))


def score_to_parquet(df: DataFrame, out: str, checkpoint: str):
    """Append sink, exactly once by its checkpoint; ends when all present files are read."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
