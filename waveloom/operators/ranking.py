"""Global order by a hash without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, key: Column, *ties: str, name: str = "rank", total: str | None = None, digits: int = 3) -> DataFrame:
    """``df`` with the rank (from 0) of each row in the order of md5(key), then the ``ties``; and the number of rows as
    ``total`` if that is asked for.

    The first ``digits`` hex digits cut the rows into even ranges, 4096 of them by three; rows are ranked within their
    range, and a range starts after the rows of those before it, a table of as many counts. A range is sorted by one task:
    take four digits from some 10^11 rows on.
    """
    keyed = df.withColumn("_hash", F.md5(key)).withColumn("_range", F.substring("_hash", 1, digits))
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    every = [F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total)] if total else []
    first = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_first"), *every)
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", *ties))
    ranked = keyed.withColumn("_within", within).join(F.broadcast(first), "_range")
    return ranked.withColumn(name, F.col("_first") + F.col("_within") - 1).drop("_hash", "_range", "_within", "_first")
