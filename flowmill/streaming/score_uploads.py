"""A stream of uploaded CSVs: checked, scored, counted a micro-batch, with unreadable rows set aside.

Each micro-batch writes into folders of its own number, replacing what a run that was cut off between a
write and its commit has left there, so that a restart scores no row twice and loses none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RAW = "_raw"


def read_uploads(spark: SparkSession, path: str, columns: list[str], files_per_trigger: int = 8) -> DataFrame:
    """Rows of CSVs with a header as text, `_raw` holding a line with another number of cells. A file whose
    header isn't `columns`, in this order, ends the stream with an error."""
    schema = StructType([StructField(c, StringType()) for c in [*columns, RAW]])
    reader = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).option("encoding", "ISO-8859-1")
    return reader.option("columnNameOfCorruptRecord", RAW).option("maxFilesPerTrigger", files_per_trigger).csv(path)


def checked(df: DataFrame, features: list[str]) -> DataFrame:
    """df with `_fault`: why a row can't be scored, null if it can. A feature may be empty (a gap), infinite or NaN, but not other text."""
    bad = [F.when(F.col(f).isNotNull() & (F.trim(f) != "") & F.expr(f"try_cast(trim(`{f}`) as double)").isNull(), f) for f in features]
    number = F.concat_ws(",", *bad)
    return df.withColumn("_fault", F.when(F.col(RAW).isNotNull(), "cells").when(number != "", F.concat(F.lit("number:"), number)))


def score_uploads(stream: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """The started query: out/scored, out/quarantine and out/counts (rows, quarantined), each by batch. It
    ends when all present files are read. score: from rows with numbers as features to what is kept."""

    def run(batch: DataFrame, number: int) -> None:
        rows = checked(batch, features).persist()
        try:
            good = rows.where("_fault is null").drop("_fault", RAW)
            good = good.withColumns({f: F.expr(f"try_cast(trim(`{f}`) as double)") for f in features})
            parts = {"scored": score(good), "quarantine": rows.where("_fault is not null")}
            parts["counts"] = rows.agg(F.count("*").alias("n_rows"), F.count("_fault").alias("n_quarantined")).withColumn("batch", F.lit(number))
            for name, part in parts.items():
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch-{number}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_part(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    """All batches of one part, or None before the first."""
    try:
        return spark.read.parquet(f"{out}/{name}/batch-*")
    except AnalysisException:
        return None
