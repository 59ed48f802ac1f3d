"""Connected components of an edge table, and joins that withstand hot keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import materialise


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label (smallest member) of each of n nodes under the links a[i]-b[i]."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    return label


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node that links reach) for every node of `edges` (a long, b long).

    Rounds of the smallest neighbouring label and a pointer jump, each written to the shared folder; the number
    of rounds grows with the logarithm of the longest chain.  Only a count of changes comes to the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        told = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = told.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = materialise(told.join(jump, "label").select("node", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("was")).alias("moved")))
        changed = after.filter("moved").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def salted_lookup(rows: DataFrame, few: DataFrame, key: list[str], by: str, salts: int = 32) -> DataFrame:
    """Left join of `rows` with `few` (one row for a key, hot keys only), dealt by key and a salt of column `by`."""
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(few, [*key, "_salt"], "left").drop("_salt")
