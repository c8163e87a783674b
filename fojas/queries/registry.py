"""Registered queries: a name, a Spark plan over the given tables, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


TEXT_TABLES = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as its files are split. A session whose text tables lie in too few splits, such as a
    test's, says in ``fojas.text.partitions`` over how many partitions they are dealt."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    partitions = spark.conf.get("fojas.text.partitions", "")
    return df.repartition(int(partitions)) if partitions and name in TEXT_TABLES else df


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files, whether it is one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")  # a pattern may stand for a file, a path may not
