"""Tables between two steps: written to the shared folder, so that a lost executor costs one task."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .captures import written

__all__ = ["removed", "spread", "written"]

#: Rows of a partition of a table that a model reads again and again.
FIT_ROWS = 10_000


def spread(df: DataFrame, name: str) -> DataFrame:
    """df (with row_id), written once and read in partitions of about FIT_ROWS rows, two a core at most: iterative
    fits neither repeat the steps before nor wait for the one task that adaptive execution merges small tables into."""
    stored = written(df, name)
    most = 2 * df.sparkSession.sparkContext.defaultParallelism
    return stored.repartition(min(most, 1 + stored.count() // FIT_ROWS), "row_id")


def removed(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {p.rpartition("/")[0] for p in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
