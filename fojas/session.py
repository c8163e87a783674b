"""Sessions for local work. On a cluster the job's own session is used as it is."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(
    name: str, cores: int | str = "*", shuffle_partitions: int = 8, checkpoint_dir: str | None = None,
    memory: str = "8g",
) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        .config("fojas.text.partitions", str(shuffle_partitions * 2))
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in local tests, a temporary folder of this machine stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
    return tempfile.mkdtemp(prefix="fojas-")
