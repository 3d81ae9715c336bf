"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tonelake.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once,
    and nothing is lost with an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column_or_null(df: DataFrame, name: str, kind: str):
    """The column as ``kind``."""
    return df[name].cast(kind)
