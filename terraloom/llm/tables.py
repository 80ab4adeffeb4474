"""Distributed running totals over ordered rows, and counts that prove a size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.session import materialize


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over the earlier rows of the same keys, in `order` (which must be unique per key).

    Rows are range-partitioned on keys and order, so a hot key is spread over many tasks; each range adds the totals of
    the ranges before it (one row per range and key) to a window that stays inside the range. Keys must not be null.
    """
    ranged = df.repartitionByRange(parallelism(df), *keys, *order).withColumn("_range", F.spark_partition_id())
    rows = materialize(ranged)
    totals = rows.groupBy("_range", *keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    joined = rows.join(offsets, ["_range", *keys])
    return joined.withColumn(name, (F.col("_offset") + local).cast("bigint")).drop("_range", "_offset")


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, also when `body` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]
