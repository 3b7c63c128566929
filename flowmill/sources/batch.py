"""Scoring of uploaded flow CSVs into prediction CSVs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import models as ML


def read_upload(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """An upload as text with stripped names; features become finite numbers, gaps stay. A missing
    feature is an error, extra columns stay."""
    df = C.strip_columns(spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)).withColumnsRenamed(C.RATE_ALIASES)
    if missing := [f for f in features if f not in df.columns]:
        raise ValueError(f"the upload lacks {missing}")
    return C.coerce_numeric(df, features)


def score_csv(spark: SparkSession, source: str, target: str, model: PipelineModel, classes: list[str], features: list[str], keep: list[str]) -> None:
    """Predictions of every uploaded row, with `keep` columns, as CSVs with a header."""
    ML.predict(model, classes, read_upload(spark, source, features), features, keep).write.option("header", True).csv(target)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction CSVs: y_pred as text, confidence and p_ columns as numbers, the rest as text."""
    df = spark.read.option("header", True).csv(path)
    number = [c for c in df.columns if c.startswith("p_") or c == "confidence"]
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in number})
