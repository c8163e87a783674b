"""The price table."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession

from fojas import fixed, schemas


def listed_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.PRICES_USD_PER_MILLION), schemas.PRICES)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Prices from a TOML file: one table per model with input, cache_write, cache_read and output."""
    with open(path, "rb") as f:
        rates = tomllib.load(f)
    fields = ("input", "cache_write", "cache_read", "output")
    return spark.createDataFrame([(m, *[float(r[k]) for k in fields]) for m, r in rates.items()], schemas.PRICES)
