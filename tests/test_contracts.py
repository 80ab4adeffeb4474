import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T
from terraloom.operators import contracts as K
from terraloom.sources import files as IO
from terraloom.streaming.ingest import incremental_composite, ingest_chunks


@pytest.fixture(scope="module")
def manifest(spark):
    return spark.range(100).select(F.col("id").alias("row"), F.when(F.col("id") < 60, "north").otherwise("south").alias("region"), (F.col("id") * 1.0).alias("value"))


def failed(spark, manifest, chunk):
    return {r.check_name for r in K.chunk_contract(chunk, manifest, "row", "region", ["value"], 50, 100).where("NOT ok").collect()}


def test_intact_chunk_passes_in_any_order(spark, manifest):
    assert failed(spark, manifest, manifest.where("row >= 50").orderBy(F.rand(1))) == set()


@pytest.mark.parametrize("damage, check", [
    (lambda c: c.where("row <> 70"), "no_missing_keys"),
    (lambda c: c.unionByName(c.where("row = 70")), "no_duplicate_keys"),
    (lambda c: c.unionByName(c.where("row = 70").withColumn("row", F.lit(7).cast("long"))), "no_foreign_keys"),
    (lambda c: c.withColumn("row", F.when(F.col("row") == 70, 70.5).otherwise(F.col("row").cast("double"))), "integral_keys"),
    (lambda c: c.withColumn("region", F.when(F.col("row") == 70, "north").otherwise(F.col("region"))), "region_identity"),
    (lambda c: c.withColumn("value", F.when(F.col("row") == 70, float("inf")).otherwise(F.col("value"))), "finite_values"),
])
def test_damaged_chunks_are_rejected(spark, manifest, damage, check):
    assert check in failed(spark, manifest, damage(manifest.where("row >= 50")))


def test_enforce_names_the_failure(spark, manifest):
    with pytest.raises(ValueError, match="no_missing_keys"):
        K.enforce(K.chunk_contract(manifest.where("row > 55"), manifest, "row", "region", ["value"], 50, 100))


def test_changed_header_is_an_error(spark, manifest):
    path = IO.scratch(spark, "header")
    manifest.select("region", "row", "value").write.option("header", True).csv(path)
    with pytest.raises(Exception):
        IO.read_csv(spark, path, manifest.schema).collect()


def test_repeated_join_key_is_an_error(spark, manifest):
    with pytest.raises(Exception, match="one to one"):
        K.unique_join(manifest, manifest.unionByName(manifest.limit(1)).select("row", F.col("value").alias("v")), ["row"]).collect()


def test_more_than_one_file_is_an_error(spark):
    listing = spark.createDataFrame([("/x/place_2020_a.tif",), ("/x/place_2020_b.TIFF",), ("/x/words_2020.zip",)], "path string")
    found = IO.matching_files(listing, "path", "place", "2020", "words")
    assert found.count() == 2
    with pytest.raises(Exception, match="exactly one"):
        IO.single_match(found).collect()
    assert IO.single_match(IO.matching_files(listing, "path", "nowhere", "2020", "words")).count() == 1


def test_restarted_ingest_adds_nothing(spark, manifest):
    incoming, out = IO.scratch(spark, "in"), IO.scratch(spark, "out")
    IO.write_chunks(manifest, incoming, "row", 30)
    for _ in range(2):
        ingest_chunks(spark, incoming, manifest.schema, "row", 30, out, manifest, files_per_batch=1)
    assert spark.read.parquet(f"{out}/rows").count() == 100
    ledger = spark.read.parquet(f"{out}/ledger").groupBy("chunk").agg(F.sum("rows").alias("n"), F.count("*").alias("times")).collect()
    assert len(ledger) == 4 and all(r.times == 1 for r in ledger)


def test_a_chunk_split_over_batches_and_runs_is_ledgered_when_whole(spark, manifest):
    incoming, out = IO.scratch(spark, "in"), IO.scratch(spark, "out")
    ledger = lambda: {r.chunk: (r.rows, r.accepted) for r in spark.read.parquet(f"{out}/ledger").collect()}
    run = lambda where, damage=None: (
        IO.write_chunks((damage or (lambda x: x))(manifest.where(where)).coalesce(1), incoming, "row", 30, mode="append"),
        ingest_chunks(spark, incoming, manifest.schema, "row", 30, out, manifest, files_per_batch=1))
    run("row % 2 = 0")
    assert ledger() == {}
    run("row % 2 = 1 AND row < 90 AND row <> 41")
    assert ledger() == {"c000": (30, True), "c002": (30, True)}
    run("row = 41 OR row = 5 OR row >= 90 AND row % 2 = 1", lambda df: df.withColumn("region", F.when(F.col("row") == 93, "elsewhere").otherwise(F.col("region"))))
    assert ledger() == {"c000": (30, True), "c001": (30, True), "c002": (30, True), "c003": (10, False)}
    assert spark.read.parquet(f"{out}/rows").count() == 90
    assert [r.row for r in spark.read.parquet(f"{out}/late").collect()] == [5]


def test_the_end_of_input_closes_the_last_windows_and_late_rows_stay_out(spark):
    incoming, out = IO.scratch(spark, "in"), IO.scratch(spark, "out")
    schema = "u long, t timestamp, v double"
    put = lambda *rows: spark.createDataFrame([(u, t, v) for u, t, v in rows], "u long, t string, v double").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(incoming)
    run = lambda: {(str(r.window_start)[8:10], r.u): (r.median, r.n_obs) for r in incremental_composite(
        spark, incoming, T._parse_datatype_string(schema), "u", "t", "v", "1 day", "1 day", "1 day", out).collect()}
    put((1, "2024-01-01 10:00:00", 1.0), (1, "2024-01-05 10:00:00", 5.0), (1, "2024-01-05 11:00:00", 7.0))
    assert run() == {("01", 1): (1.0, 1), ("05", 1): (6.0, 2)}
    put((1, "2024-01-01 12:00:00", 99.0), (1, "2024-01-05 12:00:00", 9.0), (2, "2024-01-06 00:00:00", 2.0))
    assert run() == {("01", 1): (1.0, 1), ("05", 1): (7.0, 3), ("06", 2): (2.0, 1)}


def test_registry_states(spark):
    registry = spark.createDataFrame([("a", "AB"), ("b", "cd"), ("c", None), ("d", "ef"), ("e", None)], "path string, expected string")
    files = spark.createDataFrame([("a", 1, "ab"), ("b", 2, "xx"), ("c", 3, "yy"), ("z", 4, "zz")], "path string, length long, digest string")
    assert {r.path: r.state for r in IO.asset_states(registry, files).collect()} == {"a": "OK", "b": "REBUILT", "c": "PRESENT", "d": "MISSING", "e": "MISSING", "z": "FOREIGN"}


def test_rows_are_staged_by_chunk_so_that_a_batch_lists_its_own_chunks_only(spark, tmp_path):
    manifest = spark.createDataFrame([(i, "source", 0.5) for i in range(60)], "row long, region string, value double")
    incoming, out = str(tmp_path / "incoming"), str(tmp_path / "out")
    IO.write_chunks(manifest, incoming, "row", 30)
    ingest_chunks(spark, incoming, manifest.schema, "row", 30, out, manifest, files_per_batch=1)
    staged = tmp_path / "out" / "staged"
    assert sorted(p.name for p in staged.iterdir() if p.is_dir()) == ["chunk=c000", "chunk=c001"]
    assert [spark.read.parquet(str(p)).count() for p in sorted(staged.glob("chunk=*"))] == [30, 30]
    assert spark.read.parquet(f"{out}/rows").count() == 60


def test_by_default_a_backlog_of_many_small_files_is_few_batches(spark, tmp_path):
    manifest = spark.createDataFrame([(i, "source", 0.5) for i in range(210)], "row long, region string, value double")
    incoming, out = str(tmp_path / "incoming"), str(tmp_path / "out")
    IO.write_chunks(manifest, incoming, "row", 3)
    assert len(list((tmp_path / "incoming").rglob("*.csv"))) >= 70
    ingest_chunks(spark, incoming, manifest.schema, "row", 3, out, manifest)
    assert [p.name for p in (tmp_path / "out" / "ledger").iterdir() if p.is_dir()] == ["batch=0"]
    ledger = spark.read.parquet(f"{out}/ledger").collect()
    assert len(ledger) == 70 and all(r.rows == 3 and r.accepted for r in ledger) and spark.read.parquet(f"{out}/rows").count() == 210
