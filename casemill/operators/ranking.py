"""Exact numbering and running totals that never put a whole group into one task.

A window over a group needs all rows of the group in one task. Here rows are first split into
buckets that respect the order; a window numbers the rows inside each (group, bucket), and a small
table of bucket sizes gives the offset. Groups of any size stay spread over their buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 3  # 4096 buckets
ROWS_PER_BUCKET = 1 << 16


def number_rows(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column], out: str
) -> DataFrame:
    """Add the 1-based position of each row in its group.

    `bucket` must be non-decreasing along `order` within a group.
    """
    df = df.withColumn("_bucket", bucket)
    offsets = bucket_offsets(df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")), keys, ["_n"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inside))
    joined = null_safe_join(numbered, offsets.drop("_n"), [*keys, "_bucket"])
    return joined.withColumn(out, (F.col("_inside") + F.col("_n_before")).cast("long")).drop(
        "_bucket", "_inside", "_n_before"
    )


def bucket_offsets(sums: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per bucket, the totals of all earlier buckets of the group as `<value>_before`."""
    earlier = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return sums.withColumns(
        {f"{v}_before": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values}
    )


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join that also pairs null keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on]
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in on])


def hash_bucket(digest: Column, digits: int = HASH_DIGITS) -> Column:
    """Buckets for an order by hex digest."""
    return F.substring(digest, 1, digits)


def sequence_bucket(position: Column) -> Column:
    """Buckets for an order by a unique row number."""
    return F.floor(position / ROWS_PER_BUCKET)


def value_bucket(df: DataFrame, column: str, buckets: int = 512, out: str = "_bucket") -> DataFrame:
    """Buckets for an order by a numeric column, cut at its approximate quantiles.

    Only the `buckets` cut points reach the driver; the numbering stays exact whatever they are.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(column, shares, 0.5 / buckets)))
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=out).transform(df)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]
) -> DataFrame:
    """Add `cum_<value>`: the inclusive running sum along `order` descending.

    Expects one row per (keys, order) and a `_bucket` column that does not decrease with `order`.
    """
    sums = df.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(v) for v in values])
    later = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("_bucket"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sums.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(v).over(later), F.lit(0)).alias(f"_{v}_before") for v in values],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(F.desc(order)).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
    )
    summed = df.withColumns({f"_{v}_inside": F.sum(v).over(inside) for v in values})
    joined = null_safe_join(summed, offsets, [*keys, "_bucket"])
    return joined.withColumns(
        {f"cum_{v}": F.col(f"_{v}_inside") + F.col(f"_{v}_before") for v in values}
    ).drop(*[f"_{v}_inside" for v in values], *[f"_{v}_before" for v in values])
