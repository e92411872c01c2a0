"""One place for the session settings and the table loader."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "procweave", cpus: int | None = None, **conf: str) -> SparkSession:
    """Return a local session with the settings that queries and tests assume (UTC, AQE on)."""
    cores = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table through Spark, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows out to all cores if their scan has fewer parts than that; a larger scan stays as it is, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dealt(texts: DataFrame, key: str) -> DataFrame:
    """Deal texts by key before they become rows of tokens or lines: all rows of one text then stand together, and windows over them need no
    shuffle of those rows, which are many times larger than the texts."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
