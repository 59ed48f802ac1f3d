"""Positions, neighbours and running sums within groups, also where one group holds most rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder.

    Where spark.checkpoint.dir is unset, a local session (tests) gets a temporary folder; a cluster gets an error, as its machines share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="pagequarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pagequarry-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df plus `name`: 1, 2, ... within each group by `order` (ties count in no set order), for groups too large for one task.

    Rows are dealt by range of (group, order); a range's rows of a group are numbered on their own, and the counts of the ranges
    before it (ranges x groups numbers at most) are added.
    """
    dealt = written(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_before")
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    rows = dealt.withColumn("_own", own).join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return rows.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_g", "_r", "_range")


#: a group of more rows than this is scanned in ranges; smaller ones are sorted as they are
MOST_ROWS = 1 << 20


def _same(left: str, right: str):
    return F.col(left).eqNullSafe(F.col(right))


def in_ranges(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df plus _range, its rows dealt by range of (group, order): each range in one partition, and about as many rows in each partition, whatever the sizes of groups."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(4 * n, *group, *order).withColumn("_range", F.spark_partition_id()))
    # few ranges to a partition; what is dealt by _range needs no other exchange for windows over (group, _range)
    return dealt.repartitionByRange(n, "_range")


def _carried(df: DataFrame, group: list[str], order: list[str], name: str, own, fold, carry, merge) -> DataFrame:
    """A segmented scan.  own: the scan within a range, a window expression of its order; fold: an aggregate of a range's rows of a group; carry: what the folds of the group's
    other ranges (in `fold`, ordered by _range) bring to a range; merge: of both.  There is a fold for each group and range that meet, so about as many as groups and ranges.
    """
    most = df.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= MOST_ROWS:
        return df.withColumn(name, merge(own(Window.partitionBy(*group).orderBy(*order)), None))
    rows = in_ranges(df, group, order)
    folds = rows.groupBy(*group, "_range").agg(fold.alias("_fold"))
    folds = folds.withColumn("_carry", carry(Window.partitionBy(*group).orderBy("_range")))
    folds = folds.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_range").alias("_r"), "_carry")
    rows = rows.withColumn("_own", own(Window.partitionBy(*group, "_range").orderBy(*order)))
    met = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        met = met & _same(c, f"_g{i}")
    joined = rows.join(folds, met, "left").withColumn(name, merge(F.col("_own"), F.col("_carry")))
    return joined.select(*df.columns, name)


def beside(df: DataFrame, group: list[str], order: list[str], column: str, name: str, ahead: bool = False) -> DataFrame:
    """df plus `name`: `column` of the row before (or after, with ahead) in the group's order; null for the first (last).  Rows of equal order stand in no set order."""
    step = F.lead if ahead else F.lag
    at = F.min_by if ahead else F.max_by
    value = F.struct(F.col(column).alias("v"))
    merge = lambda own, carried: (own if carried is None else F.coalesce(own, carried))["v"]
    return _carried(df, group, order, name, lambda w: step(value).over(w), at(value, F.struct(*order)), lambda w: step("_fold").over(w), merge)


def sum_before(df: DataFrame, group: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """df plus `name`: the sum of `column` over the rows before in the group's order, 0 for the first."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    merge = lambda own, carried: (own if carried is None else own + F.coalesce(carried, F.lit(0))).cast("long")
    return _carried(df, group, order, name, lambda w: total(column, w), F.coalesce(F.sum(column), F.lit(0)), lambda w: total("_fold", w), merge)
