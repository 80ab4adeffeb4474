"""Window joins and composites of dated observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.attach import attach, expand_by
from terraloom.operators.ordering import exact_quantiles

# fixed values: scene-class codes excluded by the point and by the tile mask
POINT_MASK = (3, 8, 9, 10, 11)
TILE_MASK = (0, 1, 3, 7, 8, 9, 10, 11)


def clear_pixels(df: DataFrame, scene_class: str, excluded: tuple[int, ...] = POINT_MASK) -> DataFrame:
    return df.where(~F.col(scene_class).isin(*excluded))


def usable_scenes(df: DataFrame, cloud: str, limit: float, modes: list[str], mode: str, polarisations: str) -> DataFrame:
    """Cloud share within the limit, an accepted mode, and both polarisations present."""
    return df.where((F.col(cloud) <= limit) & F.col(mode).isin(modes)
                    & F.array_contains(polarisations, "VV") & F.array_contains(polarisations, "VH"))


def interval_join(df: DataFrame, at: str, windows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows with start <= at < end; windows may overlap, so a row can match several.

    Windows are spread over the days they touch and joined on the day, with the exact bounds as residual. The
    short side is broadcast if its measured size allows, and a long list of windows still joins by hash.
    """
    last = F.to_date(F.col(end) - F.expr("INTERVAL '0.000001' SECOND"))
    days = windows.withColumn("_day", F.explode(F.sequence(F.to_date(start), last)))
    hit = df.withColumn("_day", F.to_date(at)).join(days, "_day")
    return hit.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_day")


def with_month(df: DataFrame, at: str) -> DataFrame:
    """Calendar-month window [first of month, first of next month)."""
    start = F.date_trunc("month", F.col(at).cast("timestamp")).cast("timestamp_ntz")
    return df.withColumn("month_start", start).withColumn("month_end", F.add_months(F.to_date("month_start"), 1).cast("timestamp_ntz"))


def median_composite(df: DataFrame, keys: list[str], bands: dict[str, Column]) -> DataFrame:
    """Exact interpolated median per key and band, long form (keys, band, value)."""
    values = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), c.cast("double").alias("v")) for b, c in bands.items()]))
    long = df.select(*keys, values.alias("_b")).select(*keys, "_b.band", "_b.v")
    return exact_quantiles(long, [*keys, "band"], "v", {"value": 0.5})


def pivot_bands(composite: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    return composite.groupBy(*keys).agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands])


def window_counts(df: DataFrame, location: str, windows: DataFrame, value: str, matched: DataFrame) -> DataFrame:
    """Observation count and validity flag for every (location, window); zero where nothing was observed."""
    frame = expand_by(df.select(location).distinct(), windows.select("tag"))
    counts = matched.groupBy(location, "tag").agg(F.count(value).alias("n_obs"))
    joined = frame.join(counts, [location, "tag"], "left")
    n = F.coalesce("n_obs", F.lit(0)).cast("bigint")
    return joined.select(location, "tag", n.alias("n_obs"), (n > 0).cast("bigint").alias("valid"))


def temporal_mode(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most frequent label per key, the lowest label on ties; both steps combine map-side."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max(F.struct(F.col("_n"), (-F.col(label)).alias("_l")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b._l")).alias(label), F.col("_b._n").alias("n"))


def series_array(composite: DataFrame, keys: list[str], tag: str, value: str) -> DataFrame:
    """Values ordered by window tag as one array; its length is the number of windows."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(tag), F.col(value))))
    return composite.groupBy(*keys).agg(F.transform(packed, lambda s: s[value]).alias("series"))


def train_medians(df: DataFrame, train: Column, vector: str, length: int) -> DataFrame:
    """One row with an array of per-position medians over the training rows; positions never observed get 0."""
    long = df.where(train).select(F.posexplode(vector).alias("_i", "_v"))
    medians = exact_quantiles(long, ["_i"], "_v", {"_m": 0.5})
    packed = medians.agg(F.map_from_entries(F.collect_list(F.struct("_i", "_m"))).alias("_map"))
    values = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0.0)))
    return packed.select(values.alias("medians"))


def impute(df: DataFrame, medians: DataFrame, vector: str) -> DataFrame:
    filled = F.zip_with(vector, "medians", lambda v, m: F.coalesce(v, m))
    return attach(df, medians, []).withColumn(vector, filled).drop("medians")


def train_scaling(df: DataFrame, train: Column, vector: str) -> DataFrame:
    """One row: arrays of training mean and population deviation (deviations below 1e-6 become 1)."""
    long = df.where(train).select(F.posexplode(vector).alias("_i", "_v"))
    stats = long.groupBy("_i").agg(F.avg("_v").alias("m"), F.stddev_pop("_v").alias("s"))
    stats = stats.withColumn("s", F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s")))
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("_i", "m", "s"))).alias("_p"))
    return packed.select(F.transform("_p", lambda e: e["m"]).alias("means"), F.transform("_p", lambda e: e["s"]).alias("deviations"))


def standardize(df: DataFrame, scaling: DataFrame, vector: str) -> DataFrame:
    centred = F.zip_with(vector, "means", lambda v, m: v - m)
    scaled = F.zip_with(centred, "deviations", lambda v, s: v / s)
    return attach(df, scaling, []).withColumn(vector, scaled).drop("means", "deviations")


def validity(flag: Column, sentinel_ok: Column) -> dict[str, Column]:
    """Conservative validity and the disagreement of the two signals."""
    return {"valid": (flag & sentinel_ok).cast("bigint"), "disagree": (flag != sentinel_ok).cast("bigint")}
