"""Structured Streaming: restartable chunk ingest, duplicate rejection, incremental composites."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.functions.hashing import row_digest, table_digest
from terraloom.operators.ordering import exact_quantiles
from terraloom.session import materialize
from terraloom.sources.files import scratch

SLICE_CHUNKS = 64  # chunks whose manifest rows lie in one folder


def ingest_chunks(spark: SparkSession, incoming: str, schema: T.StructType, row: str, size: int, out: str, manifest: DataFrame, region: str = "region",
                  files_per_batch: int = 4_096) -> None:
    """Process every chunk file not seen before, once, and stop; a chunk enters the ledger when it is whole.

    A chunk's files may come in any number of batches and runs: rows are staged by chunk until every key that `manifest`
    (row, region) has for it is there. Then the chunk contract is run on it, its verdict and digest are ledgered, once, and
    its rows land if it is accepted. Rows that come for a chunk already in the ledger are set aside under `late`. The
    checkpoint remembers finished files; a batch writes under its own number with overwrite and looks only at batches
    before it, so a batch repeated after a failure replaces itself. A batch reads the staged rows of the chunks it touches,
    each chunk one file a batch, and the manifest's slices of them; how many files a batch takes changes no result.
    """
    stream = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", files_per_batch).csv(incoming)
    tagged = stream.withColumn("chunk", F.regexp_extract(F.col("_metadata.file_path"), r"chunk=(c\d+)", 1))
    numbers = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name != row]
    staged = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("chunk", T.StringType())])
    ledgered = "chunk string, rows bigint, missing bigint, foreign bigint, duplicate bigint, fractional bigint, wrong_region bigint, not_finite bigint, digest string, accepted boolean, batch bigint"
    tasks = spark.sparkContext.defaultParallelism  # of the writes of one small file a chunk, which adaptive execution would leave to one task
    slice_of = lambda n: F.floor(n / SLICE_CHUNKS).cast("bigint")
    slices: list[str] = []  # folder of the manifest by slice, written by the first batch of a run

    def wanted(of: list[str]) -> DataFrame:
        place = F.floor(F.col(row).cast("double") / size)
        if not slices:
            path = scratch(spark, "manifest")
            cut = manifest.select(F.col(row).cast("double").alias("_k"), F.lower(F.col(region)).alias("_region"), F.format_string("c%03d", place).alias("chunk"), slice_of(place).alias("slice"))
            cut.repartition(tasks, "slice").write.partitionBy("slice").parquet(path)
            slices.append(path)
        numbers = sorted({int(c[1:]) // SLICE_CHUNKS for c in of})
        return spark.read.schema("_k double, _region string, chunk string, slice bigint").parquet(slices[0]).where(F.col("slice").isin(numbers)).drop("slice")

    def land(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        touched = [r[0] for r in batch.where("chunk <> ''").select("chunk").distinct().collect()]  # at most the files of a batch
        names = spark.createDataFrame([(c,) for c in touched], "chunk string")
        batch.withColumn("batch", F.lit(number)).repartition(tasks, "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk", "batch").parquet(f"{out}/staged")
        batch.unpersist()
        # only the folders of these chunks are listed: a listing of all would grow with every batch
        rows = spark.read.schema(staged).option("basePath", f"{out}/staged").parquet(*[f"{out}/staged/chunk={c}" for c in touched]) if touched else spark.createDataFrame([], staged)
        done = _ledger(spark, out, ledgered).where(F.col("batch") < number).select("chunk").distinct()
        rows.where(F.col("batch") == number).join(done, "chunk", "left_semi").select(*schema.names, "chunk").write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        held = rows.where(F.col("batch") <= number).join(done, "chunk", "left_anti").repartition(tasks, "chunk").persist()
        finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
        bad = ~reduce(and_, [finite(c) for c in numbers], F.lit(True))
        keys = held.groupBy("chunk", F.col(row).cast("double").alias("_k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.min(F.lower(F.col(region))).alias("lo"), F.max(F.lower(F.col(region))).alias("hi"))
        met = keys.join(wanted(touched).join(names, "chunk", "left_semi").withColumn("_known", F.lit(True)), ["chunk", "_k"], "full_outer")
        known = F.coalesce("_known", F.lit(False))
        stats = met.groupBy("chunk").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(~known).alias("foreign"), F.count_if(F.col("n") > 1).alias("duplicate"),
            F.count_if(F.col("_k") != F.floor("_k")).alias("fractional"), F.count_if(known & ((F.col("lo") != F.col("_region")) | (F.col("hi") != F.col("_region")))).alias("wrong_region"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("not_finite")).where("rows > 0 AND missing = 0")
        digest = table_digest(held, ["chunk"], row_digest(*schema.names)).select("chunk", "digest")
        fine = " AND ".join(f"{c} = 0" for c in ("foreign", "duplicate", "fractional", "wrong_region", "not_finite"))
        ledger = stats.join(digest, "chunk").withColumn("accepted", F.expr(fine))
        ledger.write.mode("overwrite").parquet(f"{out}/ledger/batch={number}")
        accepted = _ledger(spark, out, ledgered).where((F.col("batch") == number) & F.col("accepted")).select("chunk")
        held.drop("batch").join(accepted, "chunk", "left_semi").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        held.unpersist()

    with _listing_tasks(spark, 4 * tasks):
        tagged.writeStream.foreachBatch(land).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@contextmanager
def _listing_tasks(spark: SparkSession, n: int) -> Iterator[None]:
    """Lists folders in at most `n` tasks meanwhile; as set, each of many small folders gets a task of its own."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _ledger(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The ledger so far; empty before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/ledger")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/ledger")


def reject_duplicates(spark: SparkSession, incoming: str, schema: T.StructType, key: str, at: str, out: str, files_per_batch: int = 64, slices: int = 64) -> DataFrame:
    """First arrival of every key, however late: of the rows of one batch the earliest by `at`, and none that a batch before had.

    Accepted rows are the ledger. They are stored by a hash slice of the key, so a batch reads only the key column of the
    slices that it touches, and under the batch's number with overwrite, so a batch repeated after a failure replaces
    itself and is not taken for its own predecessor.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    stored = T.StructType([*schema.fields, T.StructField("slice", T.IntegerType()), T.StructField("batch", T.LongType())])
    rows = f"{out}/rows"

    def land(batch: DataFrame, number: int) -> None:
        first = batch.groupBy(key).agg(F.min_by(F.struct(*schema.names), F.struct(at, F.xxhash64(*schema.names))).alias("r")).select("r.*")
        first = first.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
        if number:
            first = first.persist()
            touched = [r[0] for r in first.select("slice").distinct().collect()]  # at most `slices` numbers
            earlier = spark.read.schema(stored).parquet(rows).where(F.col("slice").isin(touched) & (F.col("batch") < number)).select(key)
            first = first.join(earlier, key, "left_anti")
        first.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "slice").parquet(rows)
        first.unpersist()

    stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stored).parquet(rows).select(*schema.names)


def incremental_composite(spark: SparkSession, incoming: str, schema: T.StructType, location: str, at: str, value: str, width: str,
                          slide: str, delay: str, out: str, close: bool = True) -> DataFrame:
    """Median and count per (window, location); rows later than the watermark are dropped.

    State is an exact histogram keyed by (window, location, value), so a busy location spreads over many keys instead of
    one growing state row. Medians are read off the stored histogram. With `close` the end of the input closes the windows
    still open: their rows, all of them at or after the watermark less one window, are read again from the input and
    counted beside the stored ones, and a later run with more input counts them anew.
    """
    stream = spark.readStream.schema(schema).parquet(incoming)
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    counted = lambda rows: rows.groupBy(F.window(at, width, slide).alias("w"), location, value).agg(F.count(F.lit(1)).alias("n"))
    flat = counted(timed).select(F.col("w.start").alias("window_start"), location, value, "n")
    flat.writeStream.format("parquet").outputMode("append").option("path", f"{out}/histogram").option("checkpointLocation", f"{out}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(f"{out}/histogram")
    if close:
        # the last batch of a run without new data evicts up to the latest time seen less the delay
        rows = spark.read.schema(schema).parquet(incoming).withColumn(at, F.col(at).cast("timestamp"))
        mark = rows.agg(F.max(at).alias("latest")).select(F.expr(f"latest - INTERVAL '{delay}'").alias("mark"), F.expr(f"latest - INTERVAL '{delay}' - INTERVAL '{width}'").alias("from")).first()
        if mark.mark is not None:
            open_ = counted(rows.where(F.col(at) >= F.lit(mark["from"]))).where(F.col("w.end") > F.lit(mark.mark))
            stored = stored.unionByName(open_.select(F.col("w.start").alias("window_start"), location, value, "n"))
    stored = materialize(stored)
    keys = ["window_start", location]
    medians = exact_quantiles(stored, keys, value, {"median": 0.5}, weight="n")
    return medians.join(stored.groupBy(*keys).agg(F.sum("n").alias("n_obs")), keys)
