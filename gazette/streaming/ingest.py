"""An extension: entries that land as files, deduplicated by url within a watermark, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gazette.functions.urls import normalize_url


def landed(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def unique_articles(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """The first article of each normalised url within the watermark's delay."""
    return stream.withColumn("url", normalize_url(stream.url)).withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["url"])
