"""Result bundles, integrity manifests and caches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import finite_or_null, to_number

#: Columns of a normalised run; absent metrics are null, never 0.
RUN_COLUMNS = {"bundle": "string", "model": "int", "accuracy": "double", "f1_macro": "double", "f1_weighted": "double", "p95_ms": "double"}


def _to_run_schema(df: DataFrame) -> DataFrame:
    def column(name: str, kind: str):
        if name not in df.columns:
            return F.lit(None).cast(kind).alias(name)
        c = F.col(name)
        return (finite_or_null(to_number(c.cast("string"))) if kind == "double" else c.try_cast(kind)).alias(name)

    return df.select(*[column(n, k) for n, k in RUN_COLUMNS.items()])


def read_json_bundle(spark: SparkSession, path: str, bundle: str) -> DataFrame:
    """Documents with nested metrics and cost; numbers in text, NaN included, are read as numbers or null."""
    df = spark.read.schema("model int, metrics struct<accuracy: double, f1_macro: double>, cost struct<p95_ms: string>").json(path)
    return _to_run_schema(df.select(F.lit(bundle).alias("bundle"), "model", "metrics.*", "cost.*"))


def read_csv_bundle(spark: SparkSession, path: str, bundle: str) -> DataFrame:
    return _to_run_schema(spark.read.option("header", True).csv(path).withColumn("bundle", F.lit(bundle)))


def write_results(metrics: DataFrame, tables: dict[str, DataFrame], path: str) -> None:
    """A result bundle below path: metrics (a row a model) as JSON documents, each table as CSV with a
    header, one folder each. A folder that exists is an error."""
    metrics.write.json(f"{path}/metrics")
    for name, df in tables.items():
        df.write.option("header", True).csv(f"{path}/{name}")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(folder, files, bytes) of the result folders below root; contents aren't read."""
    files = file_fingerprints(spark, root).where("name not like '\\\\_%'")
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def artifact_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(model, files, size_bytes) of everything stored below each folder of root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.substring_index("path", f"/{root.rstrip('/').rpartition('/')[2]}/", -1)
    return files.groupBy(F.substring_index(below, "/", 1).alias("model")).agg(F.count("*").alias("files"), F.sum("length").alias("size_bytes"))


def join_sides(metrics: DataFrame, sides: list[DataFrame], key: str) -> DataFrame:
    """metrics (a row a model) with the columns of side tables that it lacks; a model without a side row has nulls."""
    for side in sides:
        new = [c for c in side.columns if c == key or c not in metrics.columns]
        metrics = metrics.join(side.select(*new), key, "left")
    return metrics


def normalize_runs(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, size, modified) of every file; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: Bytes of a file that its digest holds at once.
DIGEST_CHUNK = 1 << 20


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it: local or shared folders, or a store that Arrow opens."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column(0).to_pylist():
            digest, size = hashlib.sha256(), 0
            store, path = _store(uri)
            with store.open_input_stream(path) as f:
                while chunk := f.read(DIGEST_CHUNK):
                    digest.update(chunk)
                    size += len(chunk)
            yield pa.RecordBatch.from_pydict({"name": [uri.rpartition("/")[2]], "size": [size], "sha256": [digest.hexdigest()]})


def _empty_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the files without a byte in each folder, which Spark's readers leave out."""
    for b in batches:
        for uri in b.column(0).to_pylist():
            store, path = _store(uri)
            found = [x.path for x in store.get_file_info(fs.FileSelector(path)) if x.is_file and not x.size and x.base_name[0] not in "_."]
            yield pa.RecordBatch.from_pydict({"name": [x.rpartition("/")[2] for x in found], "size": [0] * len(found), "sha256": [hashlib.sha256().hexdigest()] * len(found)})


def file_digests(spark: SparkSession, folder: str, streamed: bool = True) -> DataFrame:
    """(name, size, sha256) of every file of a folder. Spark lists the files and packs them into tasks by size; each
    is streamed through its digest, so that a file of any size takes DIGEST_CHUNK bytes. For stores that
    only Spark's readers open, streamed=False hashes whole contents: files of 1 byte to 2 GB."""
    schema = "name string, size long, sha256 string"
    files = spark.read.format("binaryFile").load(folder)
    if streamed:
        return files.select("path").mapInArrow(_digests, schema).union(spark.createDataFrame([(folder,)], "path string").mapInArrow(_empty_files, schema))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_diff(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, problem): escapes, missing and undeclared files, other sizes, other hashes."""
    a, m = actual.select("name", F.col("size").alias("_s"), F.col("sha256").alias("_h")), declared
    j = m.join(a, "name", "full_outer")
    problem = F.when(F.col("name").contains("..") | F.col("name").startswith("/"), "path escape").when(F.col("_s").isNull(), "missing").when(F.col("size").isNull(), "undeclared")
    problem = problem.when(F.col("_s") != F.col("size"), "size").when(F.col("_h") != F.col("sha256"), "hash")
    return j.select("name", problem.alias("problem")).where("problem is not null")


def manifest_diff_demo(spark: SparkSession, path: str) -> DataFrame:
    """Problems by kind when one file is left out of the manifest's truth and one is made up."""
    actual = file_digests(spark, path).where("name like 'part-%'")
    first = actual.agg(F.min("name").alias("_f"))
    declared = actual.join(F.broadcast(first)).select("name", "size", F.when(F.col("name") == F.col("_f"), F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    made_up = spark.createDataFrame([("../secret", 1, "0"), ("absent.json", 1, "0")], "name string, size long, sha256 string")
    return manifest_diff(actual, declared.unionByName(made_up)).groupBy("problem").agg(F.count("*").alias("n"))


def require_rows(df: DataFrame, n: int) -> DataFrame:
    """df, or an error if a cached sample has another size."""
    if (got := df.count()) != n:
        raise ValueError(f"cached sample has {got} rows, expected {n}")
    return df
