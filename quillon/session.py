"""Session settings and table access."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(master: str = "local[*]", partitions: int = 8, **settings: str) -> SparkSession:
    """A session with UTC times, adaptive plans and the given settings (dots written as __)."""
    builder = (
        SparkSession.builder.master(master).appName("quillon")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return ready(builder.getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where it lies; on a cluster, ship it with --py-files."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
