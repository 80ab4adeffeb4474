"""Readers and writers with explicit contracts: typed CSV, chunk folders, GeoJSON lines, partitioned pixel tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.functions.hashing import row_digest, table_digest
from terraloom.session import application_folder

MANIFEST_SCHEMA = T.StructType([
    T.StructField("sample_id", T.StringType()), T.StructField("region", T.StringType()), T.StructField("class_id", T.LongType()),
    T.StructField("longitude", T.DoubleType()), T.StructField("latitude", T.DoubleType()), T.StructField("label_source", T.StringType()),
    T.StructField("manifest_row", T.LongType()),
])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's shared folder, which `clear_materialized` deletes."""
    return f"{application_folder(spark)}/{name}-{uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with an explicit schema; a header that differs in names or order is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_sorted(df: DataFrame, path: str, order: list[str], form: str = "parquet") -> None:
    """Range-partitioned, sorted output; CSV gets a header."""
    writer = df.orderBy(*order).write.mode("overwrite")
    (writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path))


def parse_points(df: DataFrame, column: str = ".geo") -> DataFrame:
    """Longitude and latitude from a GeoJSON point column."""
    if column not in df.columns:
        raise ValueError(f"no {column} column with point geometry")
    text = F.col(f"`{column}`")
    part = lambda i: F.get_json_object(text, f"$.coordinates[{i}]").cast("double")
    return df.withColumn("longitude", part(0)).withColumn("latitude", part(1))


def write_features(df: DataFrame, path: str, x: str, y: str) -> None:
    """One GeoJSON point feature per line with every other column as property."""
    rest = [c for c in df.columns if c not in (x, y)]
    point = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str, properties: T.StructType, x: str, y: str) -> DataFrame:
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("geometry", geometry), T.StructField("properties", properties)])
    f = spark.read.schema(schema).json(path)
    return f.select("properties.*", F.col("geometry.coordinates")[0].alias(x), F.col("geometry.coordinates")[1].alias(y))


def write_chunks(df: DataFrame, path: str, row: str, size: int, mode: str = "overwrite") -> None:
    """CSV chunks of `size` consecutive rows, one folder chunk=cNNN each."""
    token = F.format_string("c%03d", F.floor(F.col(row) / size))
    keyed = df.withColumn("chunk", token)
    keyed.repartitionByRange("chunk").sortWithinPartitions("chunk", row).write.mode(mode).option("header", True).partitionBy("chunk").csv(path)


def read_chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Union of the chunk files with the token taken from the file path."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("recursiveFileLookup", True).csv(path)
    token = F.regexp_extract(F.col("_metadata.file_path"), r"chunk=(c\d+)", 1)
    return df.withColumn("chunk", token)


def chunk_inventory(df: DataFrame, row: str, size: int) -> DataFrame:
    """Rows, bounds, misplaced rows and content digest per chunk."""
    expected = F.format_string("c%03d", F.floor(F.col(row) / size))
    stats = df.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.min(row).alias("first_row"), F.max(row).alias("last_row"),
                                    F.count_if(F.col("chunk") != expected).alias("misplaced"))
    digest = table_digest(df, ["chunk"], row_digest(*[c for c in df.columns if c != "chunk"])).select("chunk", "digest")
    return stats.join(digest, "chunk")


def chunk_plan(df: DataFrame, row: str, size: int) -> DataFrame:
    """Contiguous row ranges of fixed size with deterministic names."""
    index = F.floor(F.col(row) / size)
    plan = df.groupBy(index.alias("chunk_index")).agg(F.count(F.lit(1)).alias("rows"), F.min(row).alias("start"), (F.max(row) + 1).alias("stop"))
    return plan.withColumn("name", F.format_string("points_c%03d_%05d_%05d", "chunk_index", "start", "stop"))


def write_pixels(df: DataFrame, path: str, core_rows: int, core_cols: int) -> None:
    """Pixel table partitioned by tile and sorted by (row, col), so windows prune files and focal steps stay local."""
    tile = F.format_string("r%02dc%02d", F.floor(F.col("row") / core_rows), F.floor(F.col("col") / core_cols))
    df.withColumn("tile", tile).repartition("tile").sortWithinPartitions("tile", "row", "col").write.mode("overwrite").partitionBy("tile").parquet(path)


def read_pixels(spark: SparkSession, path: str, bands: list[str], window: Column | None = None, tiles: list[str] | None = None) -> DataFrame:
    """Selected bands of selected tiles; the tile filter prunes folders and the window filter reaches the scan."""
    df = spark.read.parquet(path)
    if tiles:
        df = df.where(F.col("tile").isin(tiles))
    if window is not None:
        df = df.where(window)
    return df.select("row", "col", *bands)


def band_columns(tags: DataFrame, bands: DataFrame) -> DataFrame:
    """Ordered column names for every (tag, band): position, name."""
    from terraloom.operators.attach import expand_by
    from terraloom.operators.ordering import ranked_summary

    pairs = expand_by(tags, bands).select("tag", "tag_order", "band", "band_order")
    ranked = ranked_summary(pairs, [], F.col("tag_order"), F.col("band_order"), "_k")
    return ranked.select((F.col("_k") - 1).alias("position"), F.concat_ws("_", F.lower("band"), "tag").alias("name"))


def feature_groups(names: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(group, name, suffix) of columns by prefix, ordered by numeric suffix."""
    group = F.coalesce(*[F.when(F.col("name").startswith(p), g) for p, g in prefixes.items()])
    return names.select(group.alias("group"), "name", F.regexp_extract("name", r"t(\d+)$", 1).alias("_s")).where(
        "group IS NOT NULL AND _s <> ''").select("group", "name", F.col("_s").cast("bigint").alias("suffix"))


def matching_files(listing: DataFrame, path: str, place: str, year: str, fallback_word: str) -> DataFrame:
    """Images of a place and year; if there are none, the yearly archive."""
    from terraloom.operators.attach import attach

    low = F.lower(path)
    image = low.contains(place) & low.contains(year) & low.rlike(r"\.tiff?$")
    archive = low.contains(year) & low.contains(fallback_word) & low.endswith(".zip")
    found = listing.agg(F.count_if(image).alias("_images"))
    return attach(listing, found, []).where(F.when(F.col("_images") > 0, image).otherwise(archive)).drop("_images")


def single_match(candidates: DataFrame) -> DataFrame:
    """Fail unless exactly one candidate remains."""
    from terraloom.operators.attach import attach

    n = candidates.agg(F.count(F.lit(1)).alias("_n"))
    ok = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("expected exactly one matching file")).cast("boolean"))
    return attach(candidates, n, []).where(ok).drop("_n")


def asset_states(registry: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state, length, digest) of every registered path and every file: MISSING / OK / REBUILT / PRESENT / FOREIGN.

    `registry` has (path, expected), where a null digest asks for presence only; `files` has (path, length, digest).
    Digests are compared case-insensitively. A file that nobody registered is FOREIGN.
    """
    joined = registry.withColumn("_known", F.lit(True)).join(files.select("path", "length", "digest"), "path", "full_outer")
    same = F.lower("expected") == F.lower("digest")
    state = F.when(F.col("_known").isNull(), "FOREIGN").when(F.col("digest").isNull(), "MISSING").when(F.col("expected").isNull(), "PRESENT").when(same, "OK").otherwise("REBUILT")
    return joined.select("path", state.alias("state"), "length", "digest")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """sha-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("digest"))


def project_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the requested columns that exist, in the requested order."""
    return df.select(*[c for c in columns if c in df.columns])


def artifact_metadata(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Row count, bounds, columns and content digest of each named table (given with its x and y columns)."""
    from terraloom.operators.contracts import union_all

    rows = []
    for name, (df, x, y) in tables.items():
        stats = df.agg(F.count(F.lit(1)).alias("n"), F.min(x).cast("double").alias("min_x"), F.max(x).cast("double").alias("max_x"),
                       F.min(y).cast("double").alias("min_y"), F.max(y).cast("double").alias("max_y"))
        rows.append(stats.select(F.lit(name).alias("artifact"), "*", F.lit(",".join(df.columns)).alias("columns")))
    return union_all(rows)
