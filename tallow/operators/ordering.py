"""Places and running sums over all rows, without a window that one task would have to hold.

Rows are sorted in ranges and written once, with their place in the range; a
row a range is summed on one task, and every row adds its range's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import scratch

_BITS = 33  # of monotonically_increasing_id() below the partition


def _sorted(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` in ranges of the order, written and read back, with ``_part`` and ``_row``."""
    spark = df.sparkSession
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = scratch(spark, "sorted")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    return rows.withColumns({"_part": F.shiftright("_at", _BITS), "_row": F.col("_at").bitwiseAND((1 << _BITS) - 1)}).drop("_at")


def _offsets(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``_part``, the sums of the ranges before it (``_before_x``) and of all (``total_x``): a row a range."""
    parts = rows.groupBy("_part").agg(*[v.alias(k) for k, v in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = [c for k in sums for c in (F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_before_{k}"), F.sum(k).over(Window.partitionBy()).alias(f"total_{k}"))]
    return parts.select("_part", *each)


def ordered_places(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` with ``place`` (from 0) by an order and the ``total`` of rows."""
    rows = _sorted(df, order)
    offsets = _offsets(rows, {"n": F.count("*")}).withColumnRenamed("total_n", "total")
    return rows.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before_n") + F.col("_row")).drop("_part", "_row", "_before_n")


def grouped_places(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``place`` (from 0) in its group by an order, and the group's ``total``; a group may be of any size.

    Rows are sorted in ranges of group and order; a range adds a group's rows
    in the ranges before it, one number for each range that the group is in.
    """
    rows = _sorted(df, [*[F.col(g) for g in group], *order])
    parts = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("total"))
    return rows.join(parts, [*group, "_part"]).withColumn("place", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def running_sums(df: DataFrame, order: list[str | Column], columns: list[str]) -> DataFrame:
    """``df`` with ``upto_x``, the sum of column x up to and with each row by an order, and ``total_x``."""
    rows = _sorted(df, order)
    offsets = _offsets(rows, {c: F.sum(c) for c in columns})
    inside = Window.partitionBy("_part").orderBy("_row")
    upto = {f"upto_{c}": F.col(f"_before_{c}") + F.sum(c).over(inside) for c in columns}
    return rows.join(F.broadcast(offsets), "_part").withColumns(upto).drop("_part", "_row", *[f"_before_{c}" for c in columns])


def paced(df: DataFrame, group: str, order: str, arrival: str, gap: float) -> DataFrame:
    """``df`` with ``start``, when each request of a group may go out: on arrival, but ``gap`` after the one before it.

    The start of the k-th is k * gap + the largest (arrival - j * gap) of the
    first k requests, so one running maximum replaces the recursion.
    """
    w = Window.partitionBy(group).orderBy(order)
    place = F.row_number().over(w) - 1
    rows = df.withColumn("_k", place)
    ahead = F.max(F.col(arrival) - F.col("_k") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start", ahead + F.col("_k") * gap).drop("_k")
