"""Streaming forms: row-local scores and counts need no state; grouped ones get a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.markers import counts
from ..operators.scoring import lite_scores


def read(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def scored(stream: DataFrame, text: str = "text") -> DataFrame:
    return lite_scores(stream, text).drop("lite", "n_common")


def marked(stream: DataFrame, text: str = "text") -> DataFrame:
    return counts(stream, text)


def flagged_by_window(stream: DataFrame, time: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Documents and flagged ones per time window; rows later than the watermark are left out."""
    w = scored(stream).withWatermark(time, late).groupBy(F.window(time, window))
    return w.agg(F.count("*").alias("n_docs"), F.sum(F.col("flagged").cast("long")).alias("n_flagged")).select(F.col("window.start").alias("start"), "n_docs", "n_flagged")
