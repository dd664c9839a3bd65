"""Each row's successor in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.session import written


def successors(keys: DataFrame, columns: list[str], order: list[Column], prefix: str = "next_") -> DataFrame:
    """`keys` (distinct rows of `columns`) with the columns of the next row; the last gets the first.

    Rows are dealt into ranges of the order and stored with the number of their range. Within a
    range a window finds the successor; only the first row of each range is looked at across
    ranges, which are as many as the job has partitions. One row is its own successor.
    """
    ranged = keys.select(*columns).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    row = F.struct(*columns)
    inside = Window.partitionBy("range").orderBy(*order)
    numbered = ranged.withColumn("next", F.lead(row).over(inside)).withColumn(
        "first", F.row_number().over(inside) == 1
    )
    firsts = numbered.where("first").select("range", row.alias("row"))
    ranges = Window.orderBy("range")
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select(
        "range", F.coalesce(F.lead("row").over(ranges), F.first("row").over(whole)).alias("following")
    )
    joined = numbered.join(following, "range").withColumn("next", F.coalesce("next", "following"))
    return joined.select(*columns, *(F.col(f"next.{c}").alias(f"{prefix}{c}") for c in columns))
