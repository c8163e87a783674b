"""Tables in folders of the shared storage that jobs add to."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or one without rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replaced(df: DataFrame, path: str, schema: str) -> None:
    """Write a folder of a table whole; whatever an attempt that crashed left there goes."""
    df.to(df.sparkSession.createDataFrame([], schema).schema).write.mode("overwrite").parquet(path)


def folder_name(name: str) -> str:
    """A name that can stand in a folder's name as it is."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        raise ValueError(f"name {name!r} must consist of letters, digits, '_', '.' and '-'")
    return name
