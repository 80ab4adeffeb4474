"""Bindings from the driver's generic tables to the domain tables the operators expect.

Each binding exists twice: as a DataFrame and as a SQL common table expression for the check queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions.hashing import hash_unit, md5_int

GRID_WIDTH = 150
SEEDS = (42, 43, 44)
WINDOW_ANCHORS = ("2024-01-05", "2024-01-09", "2024-01-17", "2024-01-20", "2024-01-28")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table whose files yield fewer scan tasks than there are cores.

    The test tables are single row groups, so every derived column would be computed in one task. Tables with
    enough splits are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < min(cores, 64) else df


def sql_md5(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS UBIGINT)::BIGINT"


def sql_md5_wide(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 13)) AS UBIGINT)::BIGINT"


def pool(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate rows for the samplers: sample_id, class_id, block, p."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("sample_id"), (md5_int("y", key) % 3 == 0).cast("bigint").alias("class_id"),
        (F.col("o_custkey") % 60).alias("block"), (F.col("o_totalprice") / 500000.0).alias("p"))


POOL = f"""pool AS (SELECT o_orderkey AS sample_id, CAST({sql_md5("'y:' || o_orderkey")} % 3 = 0 AS BIGINT) AS class_id,
  o_custkey % 60 AS block, o_totalprice / 500000e0 AS p FROM orders)"""


# ---- labelled samples -------------------------------------------------------------------------------

def samples(spark: SparkSession, folder: str) -> DataFrame:
    block = F.col("vec_id") % 25
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"), (F.col("label") >= 5).cast("bigint").alias("class_id"),
        block.alias("block"), F.when(block < 10, "source").otherwise("target").alias("region"),
        split_of(block).alias("split"), F.col("embedding").cast("array<double>").alias("x"),
    )


def split_of(block: Column) -> Column:
    return (
        F.when(block <= 5, "source_train").when(block <= 7, "source_val").when(block <= 9, "source_test")
        .when(block <= 19, "target_pool").otherwise("target_val")
    )


SAMPLES = """samples AS (
  SELECT vec_id AS sample_id, CAST(label >= 5 AS BIGINT) AS class_id, vec_id % 25 AS block,
    CASE WHEN vec_id % 25 < 10 THEN 'source' ELSE 'target' END AS region,
    CASE WHEN vec_id % 25 <= 5 THEN 'source_train' WHEN vec_id % 25 <= 7 THEN 'source_val'
         WHEN vec_id % 25 <= 9 THEN 'source_test' WHEN vec_id % 25 <= 19 THEN 'target_pool'
         ELSE 'target_val' END AS split,
    CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings)"""


# ---- scored predictions (long over representation and seed) -----------------------------------------

def scored(spark: SparkSession, folder: str, reps=("a",), seeds=SEEDS) -> DataFrame:
    """rep, seed, sample_id, block, y, p, risk. p and risk sit on a 1/1000 grid, so ties are common."""
    base = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(
        F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % 36).alias("block"),
        (md5_int("y", F.col("o_orderkey")) % 3 == 0).cast("bigint").alias("y"),
        (F.floor(hash_unit("risk", F.col("o_orderkey")) * 1000.0) / 1000.0).alias("risk"),
        F.explode(F.array(*[F.struct(F.lit(rep).alias("rep"), F.lit(seed).cast("bigint").alias("seed"))
                            for rep in reps for seed in seeds])).alias("run"),
    )
    u = hash_unit(F.col("run.rep"), F.col("run.seed"), F.col("sample_id"))
    return base.select(
        "run.rep", "run.seed", "sample_id", "block", "y",
        (F.floor((F.lit(0.7) * u + F.lit(0.3) * F.col("y")) * 1000.0) / 1000.0).alias("p"), "risk",
    )


def scored_sql(reps=("a",), seeds=SEEDS) -> str:
    runs = ", ".join(f"('{rep}', {seed}::BIGINT)" for rep in reps for seed in seeds)
    return f"""scored AS (
  SELECT rep, seed, sample_id, block, y,
    floor((0.7e0 * ({sql_md5("concat_ws(':', rep, seed, sample_id)")} / 4294967296e0) + 0.3e0 * y) * 1000e0) / 1000e0 AS p, risk
  FROM (SELECT o_orderkey AS sample_id, o_custkey % 36 AS block,
          CAST({sql_md5("'y:' || o_orderkey")} % 3 = 0 AS BIGINT) AS y,
          floor({sql_md5("'risk:' || o_orderkey")} / 4294967296e0 * 1000e0) / 1000e0 AS risk
        FROM orders), (VALUES {runs}) AS runs(rep, seed))"""


# ---- pixel grids ------------------------------------------------------------------------------------

def grid20(spark: SparkSession, folder: str) -> DataFrame:
    """20 m pixel table: row, col, p (null = nodata), ref, lc (land-cover code)."""
    return table(spark, folder, "orders").select(
        F.floor(F.col("o_orderkey") / GRID_WIDTH).cast("bigint").alias("row"),
        (F.col("o_orderkey") % GRID_WIDTH).alias("col"),
        F.when(F.col("o_custkey") % 17 != 0, F.col("o_totalprice") / 500000.0).alias("p"),
        (F.col("o_custkey") % 3 == 0).cast("bigint").alias("ref"),
        (md5_int("lc", F.col("o_orderkey")) % 9).alias("lc"),
    ).withColumn("lcw", _patchy_cover())


def _patchy_cover() -> Column:
    """Land cover that is mostly constant inside 7 x 11 patches, with code 4 over-represented."""
    key = F.col("row") * GRID_WIDTH + F.col("col")
    patch = md5_int("patch", F.floor(F.col("row") / 7), F.floor(F.col("col") / 11)) % 12
    return F.when(md5_int("mix", key) % 100 < 75, F.when(patch > 8, 4).otherwise(patch)).otherwise(F.col("lc")).cast("bigint")


_KEY = f"(row * {GRID_WIDTH} + col)"
_PATCH = sql_md5("concat_ws(':', 'patch', row // 7, col // 11)") + " % 12"
GRID20 = f"""grid20 AS (
  SELECT *, CAST(CASE WHEN {sql_md5(f"'mix:' || {_KEY}")} % 100 < 75 THEN CASE WHEN {_PATCH} > 8 THEN 4 ELSE {_PATCH} END ELSE lc END AS BIGINT) AS lcw FROM (
  SELECT o_orderkey // {GRID_WIDTH} AS row, o_orderkey % {GRID_WIDTH} AS col,
    CASE WHEN o_custkey % 17 <> 0 THEN o_totalprice / 500000e0 END AS p,
    CAST(o_custkey % 3 = 0 AS BIGINT) AS ref, {sql_md5("'lc:' || o_orderkey")} % 9 AS lc
  FROM orders))"""


def grid10(spark: SparkSession, folder: str) -> DataFrame:
    """10 m land-cover pixels, four per 20 m pixel: row, col, lc."""
    return table(spark, folder, "orders").select(
        "o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sub")
    ).select(
        (F.floor(F.col("o_orderkey") / GRID_WIDTH) * 2 + F.floor(F.col("sub") / 2)).cast("bigint").alias("row"),
        ((F.col("o_orderkey") % GRID_WIDTH) * 2 + F.col("sub") % 2).cast("bigint").alias("col"),
        (md5_int("lc10", F.col("o_orderkey"), F.col("sub")) % 9).alias("lc"),
    )


GRID10 = f"""grid10 AS (
  SELECT CAST((o_orderkey // {GRID_WIDTH}) * 2 + sub // 2 AS BIGINT) AS row,
    CAST((o_orderkey % {GRID_WIDTH}) * 2 + sub % 2 AS BIGINT) AS col,
    {sql_md5("concat_ws(':', 'lc10', o_orderkey, sub)")} % 9 AS lc
  FROM orders, range(0, 4) AS s(sub))"""


# ---- parcels as cell sets ---------------------------------------------------------------------------

def parcel_cells(spark: SparkSession, folder: str) -> DataFrame:
    """parcel_id, tile, row, col: two shifted tilings of 7 x 11 cells, so A and B parcels overlap.

    Tiles are 25 x 50 cores; every B parcel is filed under the tile one step to the right.
    """
    pixel = grid20(spark, folder).select("row", "col")
    versions = F.explode(F.array(
        F.struct(F.lit("A").alias("v"), F.lit(0).alias("dr"), F.lit(0).alias("dc"), F.lit(0).alias("dt")),
        F.struct(F.lit("B").alias("v"), F.lit(3).alias("dr"), F.lit(5).alias("dc"), F.lit(1).alias("dt"))))
    pr, pc = F.floor((F.col("row") + F.col("s.dr")) / 7), F.floor((F.col("col") + F.col("s.dc")) / 11)
    cells = pixel.withColumn("s", versions).select(
        "row", "col", F.concat_ws("_", F.col("s.v"), pr.cast("string"), pc.cast("string")).alias("parcel_id"),
        F.concat_ws("_", F.floor(pr * 7 / 25).cast("string"), (F.floor(pc * 11 / 50) + F.col("s.dt")).cast("string")).alias("tile"))
    return cells.select("parcel_id", "tile", "row", "col")


PARCEL_CELLS = """parcel_cells AS (
  SELECT v || '_' || ((row + dr) // 7) || '_' || ((col + dc) // 11) AS parcel_id,
    (((row + dr) // 7) * 7 // 25) || '_' || (((col + dc) // 11) * 11 // 50 + dt) AS tile, row, col
  FROM grid20, (VALUES ('A', 0, 0, 0), ('B', 3, 5, 1)) AS s(v, dr, dc, dt))"""


def rings(spark: SparkSession, folder: str) -> DataFrame:
    """parcel_id and a closed ring of (x, y) vertices: rectangles turned by s_nationkey degrees."""
    key, angle = F.col("s_suppkey"), F.radians(F.col("s_nationkey").cast("double"))
    cx, cy = (key % 10) * 15 + F.lit(7.3), F.floor(key / 10) * 10 + F.lit(5.2)
    corner = lambda dx, dy: F.struct(
        (cx + F.lit(dx) * F.cos(angle) - F.lit(dy) * F.sin(angle)).alias("x"),
        (cy + F.lit(dx) * F.sin(angle) + F.lit(dy) * F.cos(angle)).alias("y"))
    corners = [corner(-6.1, -4.2), corner(6.1, -4.2), corner(6.1, 4.2), corner(-6.1, 4.2), corner(-6.1, -4.2)]
    return table(spark, folder, "supplier").select(key.alias("ring_id"), F.array(*corners).alias("ring"))


def _ring_sql() -> str:
    points = [(-6.1, -4.2), (6.1, -4.2), (6.1, 4.2), (-6.1, 4.2), (-6.1, -4.2)]
    cx, cy, a = "((s_suppkey % 10) * 15 + 7.3e0)", "((s_suppkey // 10) * 10 + 5.2e0)", "radians(s_nationkey::DOUBLE)"
    vertex = [
        f"{{'x': {cx} + ({dx}e0) * cos({a}) - ({dy}e0) * sin({a}), 'y': {cy} + ({dx}e0) * sin({a}) + ({dy}e0) * cos({a})}}"
        for dx, dy in points]
    return f"rings AS (SELECT s_suppkey AS ring_id, [{', '.join(vertex)}] AS ring FROM supplier)"


RINGS = _ring_sql()


# ---- observations and windows -----------------------------------------------------------------------

def observations(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("location"), "ts", F.col("value").alias("red"),
        (F.col("value") + k).alias("nir"), (-F.col("value") / 20.0).alias("vv"), (-F.col("value") / 15.0).alias("vh"),
        k.alias("cloud"), (F.col("event_id") % 12).alias("scl"), F.col("event_type").alias("mode"),
    )


OBSERVATIONS = """observations AS (
  SELECT event_id, user_id AS location, ts, value AS red, value + CAST(props->>'$.k' AS BIGINT) AS nir,
    -value / 20e0 AS vv, -value / 15e0 AS vh, CAST(props->>'$.k' AS BIGINT) AS cloud, event_id % 12 AS scl,
    event_type AS mode
  FROM events)"""


def windows(spark: SparkSession) -> DataFrame:
    """17-day windows [anchor - 8 d, anchor + 9 d) with their tags."""
    tagged = F.explode(F.array(*[
        F.struct(F.lit(f"t{i + 1:02d}").alias("tag"), F.lit(day).alias("anchor")) for i, day in enumerate(WINDOW_ANCHORS)]))
    days = spark.range(1).select(tagged.alias("w")).select("w.tag", F.to_date("w.anchor").alias("anchor"))
    return days.select(
        "tag", F.date_sub("anchor", 8).cast("timestamp_ntz").alias("start"),
        F.date_add("anchor", 9).cast("timestamp_ntz").alias("end"))


WINDOWS = "windows AS (SELECT tag, CAST(anchor::DATE - 8 AS TIMESTAMP) AS start_ts, CAST(anchor::DATE + 9 AS TIMESTAMP) AS end_ts FROM (VALUES " + ", ".join(
    f"('t{i + 1:02d}', '{day}')" for i, day in enumerate(WINDOW_ANCHORS)) + ") AS w(tag, anchor))"


# ---- manifest and chunks ----------------------------------------------------------------------------

def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Sample manifest from the customer table: string key, region, class, coordinates."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("s"), key.cast("string")).alias("sample_id"), F.when(key % 10 == 0, "source").otherwise("target").alias("region"),
        (md5_int("class", key) % 2).alias("class_id"), (F.lit(115.0) + 8.0 * hash_unit("lon", key)).alias("longitude"),
        (F.lit(27.0) + 6.0 * hash_unit("lat", key)).alias("latitude"), F.col("c_mktsegment").alias("label_source"), key.alias("manifest_row"),
    )


MANIFEST = f"""manifest AS (
  SELECT 's' || c_custkey AS sample_id, CASE WHEN c_custkey % 10 = 0 THEN 'source' ELSE 'target' END AS region,
    {sql_md5("'class:' || c_custkey")} % 2 AS class_id,
    115e0 + 8e0 * ({sql_md5("'lon:' || c_custkey")} / 4294967296e0) AS longitude,
    27e0 + 6e0 * ({sql_md5("'lat:' || c_custkey")} / 4294967296e0) AS latitude,
    c_mktsegment AS label_source, c_custkey AS manifest_row
  FROM customer)"""
