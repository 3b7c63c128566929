"""Stored manifests of chronological splits: one JSON document each, built, loaded, validated, compared with a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What every manifest of this protocol states. Fixed values.
FIXED = {"order_basis": "csv_row_index", "calibration_size": 0.0, "final_test_locked": True, "random_row_split": False}
SCHEMA = """version string, dataset_id string, order_basis string, sources array<string>, test_size double, min_test_per_class int,
calibration_size double, final_test_locked boolean, random_row_split boolean,
expected_counts map<string, struct<train: long, test: long>>, expected_train_rows long, expected_test_rows long"""


def build_manifest(split: DataFrame, label: str, source: str, version: str, dataset: str, test_size: float = 0.3, min_test: int = 3) -> DataFrame:
    """The manifest of a split (a row with `side`), as one row of SCHEMA, from one scan. It holds an entry a
    class and a source; a null class is named ''."""
    on = lambda side: F.count_if(F.col("side") == side)
    cells = split.groupBy(F.coalesce(F.col(label), F.lit("")).alias("_l"), F.col(source).alias("_s")).agg(on("train").alias("_tr"), on("test").alias("_te"))
    classes = cells.groupBy("_l").agg(F.sum("_tr").alias("train"), F.sum("_te").alias("test"), F.collect_set("_s").alias("_s"))
    entry = F.struct(F.col("_l").alias("key"), F.struct("train", "test").alias("value"))
    one = classes.agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_s")))).alias("sources"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("expected_counts"),
        F.coalesce(F.sum("train"), F.lit(0)).alias("expected_train_rows"), F.coalesce(F.sum("test"), F.lit(0)).alias("expected_test_rows"),
    )
    stated = {"version": version, "dataset_id": dataset, "test_size": test_size, "min_test_per_class": min_test, **FIXED}
    names = [part.split()[0] for part in SCHEMA.replace("<string, struct<train: long, test: long>>", "").split(",")]
    return one.select(*[F.lit(stated[c]).alias(c) if c in stated else F.col(c) for c in names])


def store_manifest(manifest: DataFrame, path: str) -> None:
    """Write the one row as a JSON document in a new folder; a folder that exists is an error."""
    manifest.coalesce(1).write.json(path)


def load_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row a JSON document, with its file's name as `manifest`; fields that are absent or of another kind are null."""
    df = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return df.select(F.col("_metadata.file_name").alias("manifest"), "*")


def manifest_faults(manifests: DataFrame, version_prefix: str, dataset: str, known_sources: list[str]) -> DataFrame:
    """(manifest, field) of every field that is absent or contradicts the protocol, the known sources or the other fields."""
    c = F.col
    counts = F.map_values("expected_counts")

    def total(side: str) -> Column:
        return F.aggregate(counts, F.lit(0).cast("long"), lambda a, v: a + v[side])

    known = F.array(*[F.lit(s) for s in known_sources]).cast("array<string>")
    good = {
        "version": c("version").startswith(version_prefix),
        "dataset_id": c("dataset_id") == dataset,
        **{field: c(field) == F.lit(value) for field, value in FIXED.items()},
        "test_size": (c("test_size") > 0) & (c("test_size") < 1),
        "sources": (F.size("sources") > 0) & (F.size(F.array_distinct("sources")) == F.size("sources")) & (F.size(F.array_except("sources", known)) == 0),
        "expected_counts": (F.size(counts) > 0) & F.forall(counts, lambda v: v["train"].isNotNull() & v["test"].isNotNull()),
        "expected_train_rows": c("expected_train_rows") == total("train"),
        "expected_test_rows": c("expected_test_rows") == total("test"),
    }
    bad = F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(field) for field, ok in good.items()]))
    return manifests.select("manifest", F.explode(bad).alias("field"))


def require_valid(manifests: DataFrame, version_prefix: str, dataset: str, known_sources: list[str]) -> DataFrame:
    """The manifests, or an error that names the fields at fault; no document at all is an error too."""
    faults = manifest_faults(manifests, version_prefix, dataset, known_sources).orderBy("manifest", "field").limit(100).collect()
    if faults:
        raise ValueError("split manifest at fault: " + ", ".join(f"{f['manifest']}: {f['field']}" for f in faults))
    if manifests.isEmpty():
        raise ValueError("no split manifest found")
    return manifests


def declared_counts(manifests: DataFrame) -> DataFrame:
    """(label, n_train, n_test) that the manifest expects."""
    return manifests.select(F.explode("expected_counts").alias("label", "_n")).select("label", F.col("_n.train").alias("n_train"), F.col("_n.test").alias("n_test"))
