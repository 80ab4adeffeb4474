"""Bring one-row or per-key statistics next to the rows they describe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Add the columns of `stats` to `df`.

    Without keys `stats` has one row and arrives as a scalar subquery. With keys it is an equi-join, which
    Spark turns into a broadcast only when the measured size of `stats` is below its threshold.
    """
    if keys:
        return df.join(stats, keys)
    names = stats.columns
    row = stats.select(F.struct(*names).alias("row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in names])


def expand_by(df: DataFrame, small: DataFrame) -> DataFrame:
    """Every row of `df` with every row of a short table (windows, bands, names).

    The short table travels as one array, so the large side is neither shuffled nor joined.
    """
    names = small.columns
    listed = small.agg(F.collect_list(F.struct(*names)).alias("_rows"))
    tagged = attach(df, listed, []).withColumn("_row", F.explode("_rows"))
    return tagged.select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in names])
