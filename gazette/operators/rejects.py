"""A side channel for rows that a step can't use: they are kept with the reason, beside the good ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions.staging import free_names
from gazette.storage import fresh


def split(df: DataFrame, fault: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The good rows of df, without the column `fault`, and the rejects, which have a reason there.

    df is computed once and written in one commit, rejects in a folder of their own, so each side reads its own files only
    and neither can be there without the other. Without rows, both are empty.
    """
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    (mark,) = free_names(df.columns, "_rejected")
    marked = df.withColumn(mark, F.col(fault).isNotNull())
    marked.write.partitionBy(mark).parquet(path)
    rows = spark.read.schema(marked.schema).parquet(path)
    return rows.where(~F.col(mark)).drop(mark, fault), rows.where(F.col(mark)).drop(mark)
