"""Global row numbers without sorting a whole relation in one task.

Rows are dealt to buckets that follow the order; each bucket is numbered by itself and
starts where the buckets before it end. Only one row per bucket meets in one task.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.session import written

BUCKETS = 1024


def range_bucket(df: DataFrame, column: str, buckets: int = BUCKETS) -> Column:
    """Equal ranges of a number; nulls first."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or low == high:
        return F.when(F.col(column).isNull(), -1).otherwise(0)
    place = F.floor((F.col(column) - F.lit(low)).cast("double") / F.lit(float(high - low)) * buckets)
    return F.coalesce(F.least(place, F.lit(buckets - 1)).cast("int"), F.lit(-1))


def prefix_bucket(df: DataFrame, column: str) -> Column:
    """The first two characters, in code-point order, after the beginning that all strings of the column share; nulls first."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    shared = len(os.path.commonprefix([low or "", high or ""]))
    c = F.col(column)
    return F.coalesce(F.ascii(F.substring(c, shared + 1, 1)).cast("long") * 1_114_112 + F.ascii(F.substring(c, shared + 2, 1)), F.lit(-1).cast("long"))


def hash_bucket(digest: Column) -> Column:
    """The first three hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def bucket_of(df: DataFrame, column: str) -> Column:
    return prefix_bucket(df, column) if isinstance(df.schema[column].dataType, T.StringType) else range_bucket(df, column)


def numbered(df: DataFrame, bucket: Column, order: list[Column | str], name: str = "rn") -> DataFrame:
    """`df` with 1-based row numbers in the order; `bucket` must never fall along it."""
    marked = df.withColumn("__bucket", bucket)
    sizes = marked.groupBy("__bucket").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__bucket", before.alias("__before"))
    inside = marked.withColumn("__rn", F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)))
    return inside.join(starts, "__bucket").withColumn(name, F.col("__before") + F.col("__rn")).drop("__bucket", "__before", "__rn")


def numbered_by(df: DataFrame, column: str, name: str = "rn") -> DataFrame:
    """Row numbers in ascending order of one number or string column."""
    return numbered(df, bucket_of(df, column), [column], name)


def placed(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """`df` with 1-based places in the order, by sorted partitions and where each begins: no window, whatever the values.

    Rows that tie keep places side by side in any order. The rows are written down, as
    a partition must not change between the count and the numbering.
    """
    at = F.monotonically_increasing_id()
    sorted_ = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    piece, row = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_.groupBy(piece.alias("__piece")).agg(F.count("*").alias("__size"))  # a row a partition
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__piece", before.alias("__before")))
    return sorted_.withColumn("__piece", piece).join(starts, "__piece").withColumn(name, F.col("__before") + row + 1).drop("__at", "__piece", "__before")


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[Column | str], right_order: list[Column | str], name: str = "place") -> DataFrame:
    """Rows of two relations side by side by their places, cut at the end of the shorter; column names must differ."""
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if both:
        raise ValueError(f"columns of both sides: {', '.join(sorted(both))}")
    return placed(left, left_order, name).join(placed(right, right_order, name), name)
