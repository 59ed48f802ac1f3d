"""A/B assignment and analysis (CFG-04, CFG-05, AGG-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import fnv32a


def bucket(user: Column, test: Column) -> Column:
    """0 to 1 from the FNV-1a hash of user and test."""
    return fnv32a(F.concat(user, test)).cast("double") / 4294967296.0


def variant(user: Column, test: Column, split: float) -> Column:
    return F.when(bucket(user, test) < split, "experiment").otherwise("control")


def analysis(results: DataFrame, least: int = 100) -> DataFrame:
    """variant, sample_size, success_rate, mean_response, error_rate of results (test_id, variant, success, response_time), by test."""
    n = F.count("*")
    rate = F.count_if("success").cast("double") / n.cast("double")
    return results.groupBy("test_id", "variant").agg(n.alias("sample_size"), rate.alias("success_rate"), (F.sum("response_time") / n).alias("mean_response"), (1 - rate).alias("error_rate"))


def recommendation(analysed: DataFrame, least: int = 100) -> DataFrame:
    """The variant of the highest success rate (ties by name), and whether the test has enough results."""
    best = analysed.groupBy("test_id").agg(F.count("*").alias("variants"), F.sum("sample_size").alias("n"), F.max(F.struct("success_rate", F.col("variant"))).alias("b"))
    said = F.when(F.col("variants") < 2, "Insufficient data for recommendation").otherwise(F.concat(F.lit("Recommend using variant '"), F.col("b.variant"), F.lit("'")))
    return best.select("test_id", (F.col("n") >= least).alias("significant"), said.alias("recommendation"))
