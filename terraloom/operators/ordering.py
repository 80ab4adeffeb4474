"""Order statistics that never sort a large group in one task.

A window over a whole table, or over a group that holds a third of it, would sort that group in one task. That is
the fastest plan for a small table, and it is used there (see `fits_one_task`). Anything larger is written once,
range-partitioned on the keys and the order, so a hot key is spread over as many ranges as its share of the rows.
Work inside a range is a normal window; the totals of the ranges (one row per range and key) are summed up and joined
back. Both plans give the same numbers, bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.session import materialize


def range_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


ONE_TASK_BYTES = 16 * 1024 * 1024
PLAIN_WINDOW_ROWS = 500_000


EXPANSION = 16


def fits_one_task(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate of the input is small enough to sort in a single task.

    The estimate starts from file sizes, which are compressed: at the limit the input may hold tens of millions of short
    rows, which a window sorts with spilling. It multiplies at joins and takes no account of exploded arrays: plans with a
    generator are charged EXPANSION times as much. No job is run.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if "Generate " in plan.toString():
        size *= EXPANSION
    return size <= ONE_TASK_BYTES


def settled(df: DataFrame) -> tuple[DataFrame, bool]:
    """(df, plain): small inputs as they are; others stored in the shared folder and counted.

    Storing means the cuts, the bucket totals and the ranks all read finished rows instead of repeating the plan.
    """
    if fits_one_task(df):
        return df, True
    stored = materialize(df)
    return stored, stored.count() <= PLAIN_WINDOW_ROWS


def _ranged(df: DataFrame, by: list[str], order: list[str], ranges: int | None) -> DataFrame:
    """`df` stored in ranges of (keys, order), each row with the number of its range."""
    return materialize(df.repartitionByRange(ranges or range_count(df), *by, *order).withColumn("_range", F.spark_partition_id()))


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])


def running_totals(df: DataFrame, keys: list[str], order: str, sums: list[str], buckets: int | None = None) -> DataFrame:
    """Add `before_<c>` (sum of c over smaller `order` values of the key) and `total_<c>` for each c.

    `order` must be numeric and unique within the key: aggregate ties first.
    """
    cols = df.columns
    df, plain = settled(df)
    df, by = _keyed(df, keys)
    if plain:
        past = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*by)
        return df.select(*cols, *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"before_{c}") for c in sums],
                         *[F.sum(c).over(whole).alias(f"total_{c}") for c in sums])
    rows = _ranged(df, by, [order], buckets)
    totals = rows.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        "_range", *by,
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    inside = Window.partitionBy("_range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in sums])
    joined = local.join(offsets, ["_range", *by])
    return joined.select(
        *cols,
        *[(F.col(f"_off_{c}") + F.col(f"_in_{c}")).alias(f"before_{c}") for c in sums],
        *[F.col(f"total_{c}") for c in sums],
    )


def _plain_ranks(df: DataFrame, keys: list[str], lead: Column, tie: Column, rank: str, size: str | None) -> DataFrame:
    cols = df.columns
    df, by = _keyed(df, keys)
    out = [*cols, F.row_number().over(Window.partitionBy(*by).orderBy(lead, tie)).cast("bigint").alias(rank)]
    return df.select(*out, *([F.count(F.lit(1)).over(Window.partitionBy(*by)).alias(size)] if size else []))


def ranked_rows(
    df: DataFrame, keys: list[str], lead: Column, tie: Column, rank: str = "rank", size: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Exact row number of every row in (lead, tie) order within its key, both numeric, tie unique.

    A lead value that many rows share is spread over several ranges by `tie`.
    """
    if fits_one_task(df):
        return _plain_ranks(df, keys, lead, tie, rank, size)
    cols = df.columns
    df, by = _keyed(df, keys)
    rows = _ranged(df.withColumn("_lead", lead).withColumn("_tie", tie), by, ["_lead", "_tie"], buckets)
    totals = rows.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *by, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_skip"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("_whole"),
    )
    inside = Window.partitionBy("_range", *by).orderBy("_lead", "_tie")
    joined = rows.withColumn("_in", F.row_number().over(inside)).join(offsets, ["_range", *by])
    out = [*cols, (F.col("_skip") + F.col("_in")).cast("bigint").alias(rank)]
    return joined.select(*out, *([F.col("_whole").alias(size)] if size else []))


def ranked_summary(
    df: DataFrame, keys: list[str], lead: Column, tie: Column, rank: str = "rank", size: str | None = None
) -> DataFrame:
    """`ranked_rows` for a summary table, one row per block or tile, whose estimate is often far too large."""
    df, plain = settled(df)
    return (_plain_ranks if plain else ranked_rows)(df, keys, lead, tie, rank, size)


def _plain_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None) -> DataFrame:
    ends = F.percentile(value, F.array(*[F.lit(float(q)) for q in probs.values()]), *([F.col(weight)] if weight else []))
    grouped = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(ends.alias("_e"))
    return grouped.select(*keys, *[F.col("_e")[i].alias(name) for i, name in enumerate(probs)])


def _ranged_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], buckets: int | None, weight: str | None) -> DataFrame:
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(size.alias("_n"))
    run = running_totals(counts, keys, value, ["_n"], buckets)
    first, after = F.col("before__n"), F.col("before__n") + F.col("_n")
    picks = []
    for i, q in enumerate(probs.values()):
        spot = (F.col("total__n") - 1) * F.lit(float(q))
        low, high = F.floor(spot), F.ceil(spot)
        picks += [
            F.max(F.when((first <= low) & (low < after), F.col(value))).alias(f"_lo{i}"),
            F.max(F.when((first <= high) & (high < after), F.col(value))).alias(f"_hi{i}"),
            F.max(spot - low).alias(f"_f{i}"), F.max(high - spot).alias(f"_g{i}"),
        ]
    agg = run.groupBy(*keys).agg(*picks)

    def mixed(i: int) -> Column:
        """The built-in percentile's own steps, so that both plans agree to the last bit: equal ends are not mixed at all."""
        low, high = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        return F.when(low == high, low).otherwise(F.col(f"_g{i}") * low + F.col(f"_f{i}") * high)

    return agg.select(*keys, *[mixed(i).alias(name) for i, name in enumerate(probs)])


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], buckets: int | None = None, weight: str | None = None
) -> DataFrame:
    """Interpolated quantiles per key, one output column per entry of `probs`; nulls are ignored.

    With `weight` each row stands for that many equal values (a stored histogram). Small inputs, and keys of a large input
    with at most PLAIN_WINDOW_ROWS rows, take the built-in percentile; only keys counted above that are cut into ranges.
    """
    if fits_one_task(df):
        return _plain_quantiles(df, keys, value, probs, weight)
    if not keys:
        return _ranged_quantiles(df, keys, value, probs, buckets, weight)
    stored = materialize(df.select(*keys, value, *([weight] if weight else [])))
    heavy = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > PLAIN_WINDOW_ROWS).drop("_rows")
    heavy = materialize(heavy)  # at most rows / PLAIN_WINDOW_ROWS keys
    if heavy.isEmpty():
        return _plain_quantiles(stored, keys, value, probs, weight)
    marked = heavy.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)]
    many, few = (stored.join(marked, same, how) for how in ("left_semi", "left_anti"))
    return _plain_quantiles(few, keys, value, probs, weight).unionByName(_ranged_quantiles(many, keys, value, probs, buckets, weight))


def summary_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Ungrouped `exact_quantiles` for a summary table whose estimate is often far too large."""
    stored, plain = settled(df.select(value))
    if not plain:
        return exact_quantiles(stored, [], value, probs)
    ends = stored.agg(F.percentile(value, F.array(*[F.lit(float(q)) for q in probs.values()])).alias("_e"))
    return ends.select(*[F.col("_e")[i].alias(name) for i, name in enumerate(probs)])


SALTS = 64


def top_rows(df: DataFrame, keys: list[str], lead: Column, tie: Column, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key in (lead, tie) order.

    For small k Spark trims every map-side partition to k rows per key before the shuffle (window group limit).
    A hot key of a large table still meets k rows from every partition, so there the key is first trimmed inside
    SALTS slices; one task then sees at most SALTS * k rows of it. Beyond the limit the exact rank of all rows is used.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        return ranked_rows(df, keys, lead, tie, rank).where(F.col(rank) <= k)
    first = lambda rows, by: rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(lead, tie))).where(F.col(rank) <= k)
    if not fits_one_task(df):
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(SALTS)))
        df = first(salted, [*keys, "_salt"]).drop("_salt", rank)
    return first(df, keys or [F.lit(1)]).withColumn(rank, F.col(rank).cast("bigint"))


def mid_ranks(df: DataFrame, keys: list[str], value: str, extra: list[Column] | None = None) -> DataFrame:
    """One row per (key, distinct value): tie count `n`, average rank `mid_rank`, group size `total`."""
    grouped = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *(extra or []))
    run = running_totals(grouped, keys, value, ["n"])
    return run.withColumn("mid_rank", F.col("before_n") + (F.col("n") + 1) / 2.0).withColumnRenamed(
        "total_n", "total").drop("before_n")
