"""python -m pagequarry PAGES OUT: processes a Parquet table of raw pages (page_id, url, html) and writes JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pagequarry.operators import process
from pagequarry.plans.session import prepare


def main() -> None:
    args = argparse.ArgumentParser(prog="pagequarry", description=__doc__)
    args.add_argument("pages")
    args.add_argument("out")
    given = args.parse_args()
    spark = prepare(SparkSession.builder.appName("pagequarry").getOrCreate())
    process.processed(spark.read.parquet(given.pages)).write.mode("overwrite").json(given.out)


if __name__ == "__main__":
    main()
