"""Column and row cleaning: narrow projections and filters, one stage without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import combined_family, finite_or_null, to_number

# Column names of the public capture files.
RATE_ALIASES = {"Fwd Pkts/s": "Fwd Packets/s", "Bwd Pkts/s": "Bwd Packets/s"}
DUPLICATE_COLUMNS = ("Fwd Header Length.1",)
LEAKY_COLUMNS = ("Flow ID", "Source IP", "Src IP", "Destination IP", "Dst IP", "Source Port", "Src Port", "Timestamp")
SCHEMA_ONLY_COLUMNS = ("Protocol",)
HEADER_TOKEN = "Label"


def strip_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def schema_report(spark: SparkSession, columns: list[str], expected: list[str]) -> DataFrame:
    """(column, status) of every missing or extra column."""
    rows = [(c, "missing") for c in expected if c not in columns] + [(c, "extra") for c in columns if c not in expected]
    return spark.createDataFrame(rows, "column string, status string")


def validate_schema(df: DataFrame, expected: list[str], label: str, strict: bool = True) -> DataFrame:
    """The schema report; a missing label, or in strict mode any missing column, is an error."""
    missing = [c for c in expected if c not in df.columns]
    if label not in df.columns or (strict and missing):
        raise ValueError(f"missing columns: {sorted({*missing, *([label] if label not in df.columns else [])})}")
    return schema_report(df.sparkSession, df.columns, expected)


def align_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in expected])


def assert_absent(df: DataFrame, *columns: str) -> DataFrame:
    """Leak guard: ordering columns must not be among the features."""
    if found := [c for c in columns if c in df.columns]:
        raise ValueError(f"ordering columns among the features: {found}")
    return df


def drop_header_rows(df: DataFrame, label: str, token: str = HEADER_TOKEN) -> DataFrame:
    return df.where(F.coalesce(F.trim(F.col(label)) != token, F.lit(True)))


def null_nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite_or_null(F.col(f"`{c}`")) for c in columns})


def coerce_numeric(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Text to numbers; what doesn't parse, or isn't finite, becomes null."""
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.withColumns({c: finite_or_null(to_number(F.col(f"`{c}`")) if c in text else F.col(f"`{c}`").cast("double")).cast(kind) for c in columns})


def coercion_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, failed): cells that have a text but no number, in one pass over all columns."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & to_number(F.col(f"`{c}`")).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "failed")


def drop_null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def keep_classes(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    return df.where(F.col(label).isin(*classes))


def drop_other(df: DataFrame, label: str, other: str = "Other") -> DataFrame:
    return df.where(F.coalesce(F.col(label) != other, F.lit(True)))


def drop_tiny_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of classes with at least `least` rows: counts are pre-aggregated and joined back, so that
    a class with most of the rows isn't gathered anywhere."""
    enough = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("_label")
    return df.join(enough, F.col(label) == F.col("_label"), "left_semi")


def clean_flows(df: DataFrame, label: str, features: list[str], out_label: str = "label", kind: str = "float") -> DataFrame:
    """The clean chain: known duplicate, leaky and schema-only columns go, header rows go, labels
    become families, unknown labels go, features become finite numbers, rows with a gap go."""
    df = strip_columns(df).withColumnsRenamed(RATE_ALIASES)
    df = df.drop(*[c for c in (*DUPLICATE_COLUMNS, *LEAKY_COLUMNS, *SCHEMA_ONLY_COLUMNS) if c in df.columns])
    df = drop_header_rows(df, label).withColumn("_family", combined_family(F.col(label)))
    df = coerce_numeric(drop_other(df, "_family"), features, kind)
    return drop_null_rows(df, features).drop(label).withColumnRenamed("_family", out_label)


def dedup_keep_first(df: DataFrame, data: list[str], order: list[str], meta: list[str]) -> DataFrame:
    """One row of each distinct `data`: the first in `order`, whose metadata it keeps. Partially
    aggregated before the shuffle; missing numbers must be null already, not NaN."""
    first = F.min_by(F.struct(*meta), F.struct(*order)).alias("_m")
    return df.groupBy(*data).agg(first).select(*data, "_m.*")


def clean_switchable(df: DataFrame, features: list[str], *, drop_inf: bool = True, drop_na: bool = True, drop_duplicates: bool = True) -> DataFrame:
    """The library chain with each step optional; duplicates are over all columns."""
    df = strip_columns(df)
    df = df.drop(*[c for c in DUPLICATE_COLUMNS if c in df.columns])
    df = null_nonfinite(df, features) if drop_inf else df
    df = df.na.drop() if drop_na else df
    return df.dropDuplicates() if drop_duplicates else df


def parse_timestamp(col: Column, pattern: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    return F.try_to_timestamp(col, F.lit(pattern))


def require_timestamps(df: DataFrame, text: str, parsed: str) -> DataFrame:
    """df, or an error that shows up to three texts that are no timestamps."""
    if bad := [r[0] for r in df.where(F.col(parsed).isNull()).select(text).limit(3).collect()]:
        raise ValueError(f"unparseable timestamps, e.g. {bad}")
    return df


def union_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def require_no_gaps(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns with nulls, NaN or infinite numbers; one scan."""
    number = {c for c, kind in df.dtypes if kind in ("float", "double")}
    odd = lambda c: F.col(c).isNull() | (F.isnan(c) | (F.abs(c) == float("inf")) if c in number else F.lit(False))
    row = df.agg(*[F.count_if(odd(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    if gaps := {c: row[i] for i, c in enumerate(columns) if row[i]}:
        raise ValueError(f"the clean corpus has gaps: {gaps}")
    return df
