"""Parquet caches that are rebuilt when their inputs change."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bundles import file_fingerprints

_FINGERPRINT = "folder string, name string, size long, modified timestamp"


def _stored(spark: SparkSession, path: str) -> tuple[str, DataFrame] | None:
    """The version that `path` names, and the fingerprint of the inputs that it was built from."""
    try:
        version = spark.read.schema("version string, at timestamp").json(f"{path}/current").orderBy(F.desc("at"), "version").first()
        return (version[0], spark.read.schema(_FINGERPRINT).parquet(f"{path}/{version[0]}/inputs")) if version else None
    except AnalysisException:  # nothing there yet
        return None


def is_stale(spark: SparkSession, path: str, inputs: str) -> bool:
    """Whether the cache lacks, or an input file was added, removed, resized or rewritten since it was built."""
    stored = _stored(spark, path)
    if stored is None:
        return True
    now = file_fingerprints(spark, inputs)
    return not (now.exceptAll(stored[1]).isEmpty() and stored[1].exceptAll(now).isEmpty())


def load_or_build(spark: SparkSession, path: str, inputs: str, build: Callable[[DataFrame], DataFrame], n_rows: int | None = None) -> tuple[DataFrame, bool]:
    """The cached table and whether it was built now. inputs: a folder of Parquet files. A new version
    is written beside the old one and named last, by a further pointer of which the newest counts, so
    that readers see the old version or the new one, never none or half of it. With n_rows a
    table of another size is rebuilt, and an error if it still has another."""
    stale = is_stale(spark, path, inputs)
    if not stale:
        df = spark.read.parquet(f"{path}/{_stored(spark, path)[0]}/data")
        if n_rows is None or df.count() == n_rows:
            return df, False
    version = f"v-{uuid.uuid4().hex}"
    file_fingerprints(spark, inputs).write.parquet(f"{path}/{version}/inputs")
    build(spark.read.parquet(inputs)).write.parquet(f"{path}/{version}/data")
    df = spark.read.parquet(f"{path}/{version}/data")
    if n_rows is not None and (got := df.count()) != n_rows:
        raise ValueError(f"cached table has {got} rows, expected {n_rows}")
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(f"{path}/current")
    return df, True
