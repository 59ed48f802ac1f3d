"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this host import the package wherever the driver was started; executors with it installed need nothing."""
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        environment["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT
    return spark
